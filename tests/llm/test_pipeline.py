import random

import corpus_pipeline as P
from sessionloom.llm import common as C


def corpus():
    r = random.Random(1)
    vocab = ["the", "of", "and", "in"] * 8 + [f"w{i}x" for i in range(800)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = text(60), text(150)
    rows = [(i, text(120)) for i in range(40)]
    rows += [(40, base), (41, base), (42, base + " tail"), (43, text(80) + " " + passage + " " + text(80)), (44, text(80) + " " + passage + " " + text(80))]
    rows += [(45, text(90) + " mail me@site.org now " + text(30)), (46, "JUNK!! " * 90), (47, "short text"), (48, None), (49, "")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], passage


def test_stages(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = {}
    for name, stage in P.STAGES:
        out = C.written(stage(spark, docs, ""), name)
        if name != "packing":
            assert out.schema == docs.schema
            texts[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    clean = set(range(40))
    assert set(texts["quality_rules"]) == clean | {40, 41, 42, 43, 44, 45}
    assert set(texts["near_copies"]) == clean | {40, 43, 44, 45}
    assert passage in texts["substring_dedup"][43] and passage not in texts["substring_dedup"][44]
    assert all(texts["substring_dedup"][i] == dict((r[0], r[1]) for r in rows)[i] for i in clean)
    assert "[EMAIL]" in texts["pii"][45] and "me@site.org" not in texts["pii"][45]
    assert sum(r.length for r in docs.collect()) == sum(len(t.split()) for t in texts["pii"].values())


def test_run_and_empty(spark, tmp_path):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    assert {r.doc_id for r in P.run(spark, f"file://{tmp_path}/a").collect()} == set(range(41)) | {43, 44, 45}
    assert P.run(spark, f"file://{tmp_path}/b").count() == 0


def odd(spark):
    """Null ids, nulls in every column, repeated rows, a very long text, a very long word, and columns with names that operators use inside."""
    r = random.Random(9)
    vocab = ["the", "of", "and", "in"] * 8 + [f"w{i}x" for i in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    lines, long = text(90).replace(" the ", "\n the\t"), text(30_000)
    rows = [(None, text(100)), (None, text(100)), (1, lines), (1, lines), (1, lines), (2, long), (3, text(60) + " " + "q" * 200_000), (4, None), (None, None), (5, text(80) + " call a@b.org"), (6, long + " end"), (None, lines + " tail")]
    names = ["_", "row", "body", "words", "rest", "spans", "doc_key", "comp", "symbols", "_key", "so.urce"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, None if t is None else len(t), *[None if k == 3 else f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], schema).repartition(3), rows


def test_odd_rows_and_columns(spark):
    docs, rows = odd(spark)
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = C.written(stage(spark, docs, ""), name)
        assert docs.columns == columns
        kept[name] = docs.collect()
        assert all(x.n_chars is None or x.n_chars == len(x.text) for x in kept[name])
    assert len(kept["quality_rules"]) == 10 and all(x.text for x in kept["quality_rules"])
    ids = sorted((x.doc_id for x in kept["near_copies"]), key=str)
    # The row without an id that is lines + tail comes before document 1, whose repeated rows go with it.
    assert ids == [2, 3, 5, None, None, None]
    same = {x.text for x in kept["near_copies"]}
    assert {x.text for x in kept["substring_dedup"]} == same  # nothing else repeats, so line breaks stay
    assert {x.text for x in kept["pii"]} == {t.replace("a@b.org", "[EMAIL]") for t in same}
    out = P.STAGES[-1][1](spark, docs, "").collect()
    assert sum(x.length for x in out) == sum(len(t.split()) for t in same) and len({x.piece for x in out if x.doc_id == 2}) == 8


def test_repeated_rows_become_one(spark):
    r = random.Random(2)
    text = " ".join(["the"] * 9 + [f"w{r.randrange(10**6)}" for _ in range(80)])
    docs = spark.createDataFrame([(7, text, "en")] * 5 + [(8, text + " x", "en"), (None, text[4:], "de"), (None, text[4:], "de")], "doc_id long, text string, lang string")
    assert [(x.doc_id, x.lang) for x in P.near_copies_stage(spark, docs, "").collect()] == [(None, "de")]


def test_earlier_tables_go(spark, tmp_path):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mine = C.made_so_far()
    for name, stage in P.STAGES[:-1]:
        mark = len(C.made_since(mine))
        out = stage(spark, docs, "")
        assert mark == 0 or len(C.made_since(mine)) < mark + 60
        out.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert len(C.made_since(mine)) <= 1 and docs.count() > 40  # only what the last stage wrote for itself
