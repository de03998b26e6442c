"""Transcripts end to end, episodes, stores, convergence, and every query against its oracle."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F
from sessionloom.operators import converge, labeling, mine, store, trust
from sessionloom.operators import episodes as E
from sessionloom.plans import drafting, evidencing, judging, mining, structure  # noqa: F401
from sessionloom.plans.registry import ORACLES, QUERIES
from sessionloom.sources import transcripts as S
from sessionloom.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def event(kind, content=None, **more):
    return json.dumps({"type": kind, **({"message": {"content": content}} if content is not None else {}), **more})


def test_transcripts(spark, tmp_path):
    use = [{"type": "text", "text": "I look"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "pytest"}}]
    lines = [
        event("user", "do it well please", timestamp="2024-01-01T00:00:00Z", cwd="/a/b"), "{broken", "", event("assistant", use),
        event("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "2 failed"}]), event("user", "<envelope>"), event("user", "meta", isMeta=True),
        event("user", [{"type": "text", "text": " a"}, {"type": "image"}, {"type": "text", "text": "b "}]), event("user", "x", toolUseResult={"stdout": "y"}), "[1]",
    ]
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "s1.jsonl").write_text("\n".join(lines))
    x = S.read_events(spark, f"file://{tmp_path}")
    assert [r.event_index for r in x.orderBy("event_index").collect()] == [0, 3, 4, 5, 6, 7, 8]
    human = x.where(S.is_human_turn()).orderBy("event_index").select("event_index", S.user_text(F.col("parts")).alias("t"), S.n_images(F.col("parts")).alias("n")).collect()
    assert [tuple(r) for r in human] == [(0, "do it well please", 0), (7, "ab", 1)]
    calls = S.tool_calls(x).join(S.tool_results(x), ["session_id", "id"], "left").collect()
    assert [(c.name, c.command, c.result) for c in calls] == [("Bash", "pytest", "2 failed")]


def test_forks_and_candidates(spark, tmp_path):
    sub = tmp_path / "p" / "s1" / "subagents"
    sub.mkdir(parents=True)
    (sub / "agent-1.jsonl").write_text(event("assistant", [{"type": "text", "text": "done"}]))
    (sub / "agent-2.jsonl").write_text(event("assistant", [{"type": "tool_use", "name": "Read"}]))
    (sub / "agent-3.jsonl").write_text(event("assistant", [{"type": "text", "text": "x"}]) + "\n" + event("system", subtype="api_error"))
    assert {r.agent_id: (r.outcome, r.tool_count) for r in S.read_forks(spark, f"file://{tmp_path}").collect()} == {"1": ("done", 0), "2": ("mid_call", 1), "3": ("api_error", 0)}
    one = {"cluster_id": "fix", "label": "bug fix", "dominant_pattern": "read>edit", "frequency": 3, "recommended_intervention": "skill"}
    (tmp_path / "candidates_a.json").write_text(json.dumps({"machine_id": "A", "candidates": [one, {**one, "cluster_id": "docs", "label": "write manual", "dominant_pattern": None}]}))
    (tmp_path / "candidates_b.json").write_text(json.dumps({"candidates": [{**one, "frequency": 4}]}))
    (tmp_path / "candidates_c.json").write_text("{")
    rows = {r.label: r for r in converge.converge(S.read_candidates(spark, f"file://{tmp_path}")).collect()}
    assert (rows["bug fix"].machines, rows["bug fix"].total_frequency, rows["bug fix"].cross_validated, rows["bug fix"].agreement) == ("A,b", 7, True, 1.0)
    assert rows["write manual"].n_machines == 1


def test_segmentation_properties(spark):
    rows = [("a", i, k) for i, k in enumerate("hthhth")] + [("b", i, "h") for i in range(3)] + [("c", i, "x") for i in range(3)]
    x = E.segment(spark.createDataFrame(rows, "session_id string, event_index long, k string"), F.col("k") == "t", F.col("k").isin("h", "t"))
    got = {s: [r.idx for r in x.where(F.col("session_id") == s).orderBy("event_index").collect()] for s in "abc"}
    assert got == {"a": [0, 0, 0, 0, 1, 1], "b": [0, 0, 0], "c": []}


def test_sequence_cap_and_elision(spark):
    calls = spark.createDataFrame([("s", 0, i, n) for i, n in enumerate("ab" * 30)] + [("t", 0, i, "a") for i in range(50)], "session_id string, idx long, event_index long, name string")
    out = {r.session_id: r.tool_sequence for r in E.tool_sequence(calls).collect()}
    assert out["t"] == "a" and out["s"] == ">".join("ab" * 20) + ">…"
    x = spark.createDataFrame([("b" * 50, "end"), ("b" * 500, "end"), ("b", "e" * 300)], "body string, more string")
    fit = [r[0] for r in x.select(E.fit_within_cap(F.col("body"), F.col("more"), 100)).collect()]
    assert fit[0] == "b" * 50 + "\n\nend" and len(fit[1]) <= 100 and "chars elided" in fit[1] and fit[1].endswith("\n\nend") and len(fit[2]) == 100


def test_labels_are_redacted_and_retried(spark):
    episodes = spark.createDataFrame([(1, "token = abc123"), (2, "plain")], "episode_id long, rendered string")
    seen = labeling.label(episodes, labeling.stand_in).collect()
    assert all(r.errors == [] for r in seen) and len(seen) == 2

    def echo(frames):
        for f in frames:
            yield f.rename(columns={"prompt": "answer"}).assign(answer=lambda x: "{" + x["answer"] + "}")

    bad = {r.episode_id: r for r in labeling.label(episodes, echo).collect()}
    assert "abc123" not in bad[1].label and len(bad[1].errors) == 12
    assert labeling.estimated_cost(10, 100, True) == pytest.approx(48)


def test_a_caller_is_asked_once_for_each_prompt(spark, tmp_path):
    episodes = spark.createDataFrame([(i, "x" * i) for i in range(12)], "episode_id long, rendered string").repartition(3)
    log = str(tmp_path)

    def counting(name):
        def run(frames):
            import json
            import os

            for f in frames:
                out = []
                for k, p in zip(f["episode_id"], f["prompt"], strict=True):
                    again = labeling.NUDGE in p
                    open(os.path.join(log, f"{name}-{k}-{int(again)}"), "x").close()  # a second time would raise
                    if name == "outcome":
                        ok = json.dumps({"task_type": "t", "task_difficulty": "hard", "outcome": "success", "outcome_confidence": 1, "workflow_pattern": [], "good_practices": [], "friction_points": [], "root_cause": "", "outcome_evidence": [], "skill_opportunity": {"worth_codifying": True, "type": "none", "rationale": ""}})
                        out.append("no" if k == 3 and not again or k == 4 else ok)
                    else:
                        out.append(json.dumps({"score": 2, "rationale": "", "evidence": []}))
                yield f.assign(answer=out)[["episode_id", "answer"]]

        return run

    rubrics = labeling.Rubrics("a", "b", "c", "d")
    got = {r.episode_id: r for r in labeling.panel(episodes, {n: counting(n) for n in ("outcome", "efficiency", "quality")}, rubrics).collect()}
    assert len(got) == 12 and {k for k, r in got.items() if r.errors} == {4}
    assert all(got[k].label.outcome == "partial" and got[k].label.outcome_confidence == 0.6 and got[k].quality.score == 2 for k in range(12) if k != 4)
    files = {p.name for p in tmp_path.iterdir() if p.name[0] != "."}
    assert len(files) == 12 + 2 + 11 + 11 and {"outcome-3-1", "outcome-4-1"} <= files
    assert len({labeling.prompt_hash(rubrics), labeling.prompt_hash(rubrics, "2"), labeling.panel_hash(rubrics, ["m"]), labeling.panel_hash(rubrics, ["n"])}) == 4


def test_risks_over_line_ends(spark, monkeypatch):
    monkeypatch.setattr(mine, "RUN", 4)
    rows = [("a", 2, "please git"), ("a", 3, "  "), ("a", 4, None), ("a", 5, "push"), ("a", 9, "origin prod"), ("b", 1, "git"), ("b", 2, "x"), ("b", 3, "push to prod"), ("c", 1, "rm"), ("d", 1, "drop"), ("d", 100, "fine"), ("e", 1, "x")]
    x = spark.createDataFrame([(*r, None, 6 if r[0] == "e" else 0, 1) for r in rows], "cluster_id string, ord long, first_prompt string, tool_sequence string, n_files_edited int, n_files_read int")
    said = spark.createDataFrame([("c", 1, "\n -rf /"), ("d", 1, "table t")], "cluster_id string, ord long, text string")
    got = {r.cluster_id: r.risk_flags for r in mine.risk_flags(x, said).collect()}
    assert got == {"a": "destructive: deploy", "b": "", "c": "destructive: rm -rf", "d": "", "e": "write-heavy (edits >> reads)"}


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k long, v string, w int")
    for _ in range(2):  # a second run changes nothing
        old = store.upsert(old, new, ["k"])
    assert {tuple(r) for r in old.collect()} == {(1, "a", None), (2, "c", 1), (3, "d", 2)}
    q = spark.createDataFrame([("success", 0.95, 2), ("success", 0.95, 4), ("failed", 0.9, 1), ("success", 0.5, None)], "o string, c double, q int")
    assert [tuple(r) for r in q.select(*store.consolidate(F.col("o"), F.col("c"), F.col("q"))).collect()] == [("partial", 0.6), ("success", 0.95), ("failed", 0.9), ("success", 0.5)]


def test_draw_is_fixed_and_without_repeats(spark):
    rows = [(i, k, "ABC"[k]) for i in range(60) for k in range(3) if i % (k + 1) == 0]
    members = spark.createDataFrame(rows, "episode_id long, stratum_k int, stratum string")
    one = [tuple(r) for r in trust.stratified_draw(members, 15, 3).collect()]
    assert one == [tuple(r) for r in trust.stratified_draw(members.repartition(5), 15, 3).collect()]
    assert len({i for i, _ in one}) == 15 and {s for _, s in one} == set("ABC")


def test_median_of_nothing(spark):
    rows = spark.createDataFrame([("c", 1, 1, "success", 0, 0, None, None, None)], "cluster_id string, session_id long, ord long, outcome string, n_corrections long, n_interruptions long, duration_s double, efficiency int, quality int")
    assert mine.components(rows).first().est_effort_s == 0
    assert mine.panel_medians(rows).first().median_quality is None


def test_streaming(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([("a", 0, "t"), ("b", 0, "h")], "session_id string, event_index long, k string").write.parquet(f"{base}/in/1")
    got = {}
    rebuild = lambda x: E.segment(x, F.col("k") == "t", F.lit(True)).groupBy("session_id").agg(F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))
    run = lambda: incremental.maintain(spark, f"{base}/in/*", "session_id string, event_index long, k string", f"{base}/kept", f"{base}/cp", rebuild, lambda x: got.update({r.session_id: (r["last"], r.n) for r in x.collect()})).awaitTermination()
    run()
    spark.createDataFrame([("a", 1, "t")], "session_id string, event_index long, k string").write.parquet(f"{base}/in/2")
    run()
    assert got == {"a": (1, 2), "b": (0, 1)}


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want
