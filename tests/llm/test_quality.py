import random
import re

from sessionloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def corpus():
    r = random.Random(1)
    vocab = ["the", "of", "and", "a"] * 6 + ["".join(r.choice("abcdeé😀") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(150):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 40, 50, 120, 300]))]
        kind = i % 10
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words = [w + "***" for w in words]
        if kind == 3:
            words = words[:10] * 12
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t"]) for w in words)
        rows.append((i, text))
    return rows + [(900, None), (901, ""), (902, " \n \n"), (903, "a\nb\na\n\na "), (None, "x " * 60), (904, "word " * 50000)]


def test_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    out = {r.doc_id: r for r in Q.quality_verdicts(docs).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.kept and r.base_failed)
        if isinstance(i, int) and i < 150 and not r.base_failed and i % 10 != 2:
            assert r.kept == (i % 10 != 1), (i, r)
    left = {r.doc_id for r in Q.quality_filtered(docs).collect()}
    assert left == {i for i in out if out[i].kept}


def test_em_finds_the_unreliable_rule():
    r = random.Random(2)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.7
        votes = tuple((1 if good else -1) if r.random() < p else r.choice([-1, 0, 1]) for p in (0.9, 0.8, 0.8, 0.0))
        counts[votes] = counts.get(votes, 0) + 1
    prior, table = Q.fit(list(counts.items()))
    assert abs(prior - 0.7) < 0.05
    assert table[0][1][0] > 0.85 and abs(table[3][1][0] - table[3][1][1]) < 0.1


def test_one_kind_only(spark):
    docs = spark.createDataFrame([(i, " ".join(f"the w{j}{i}" for j in range(60))) for i in range(5)], "doc_id long, text string")
    assert all(r.kept for r in Q.quality_verdicts(docs).collect())
    assert Q.quality_verdicts(docs.limit(0)).count() == 0
