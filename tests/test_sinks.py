"""What is written and read back: the store, drafts, reports, audits."""

import json

import pytest
from pyspark.sql import functions as F
from sessionloom.operators import authoring, converge, evidence, store, trust
from sessionloom.sources import transcripts


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_store_opens_empty_older_and_saved(spark, tmp_path):
    base = f"file://{tmp_path}/db"
    tables = store.open_store(spark, base)
    assert set(tables) == set(store.TABLES) and all(t.count() == 0 for t in tables.values())
    spark.createDataFrame([("e1", "s1", 7)], "episode_id string, session_id string, extra int").write.parquet(f"{base}/episodes")
    tables = store.open_store(spark, base)
    assert tables["episodes"].columns[-1] == "extra" and tables["episodes"].first().content_hash is None
    tables["episodes"] = store.upsert(tables["episodes"], spark.createDataFrame([("e1", "s2"), ("e2", "s1")], "episode_id string, session_id string"), ["episode_id"])
    for _ in range(2):
        store.save_store(tables, base)
        tables = store.open_store(spark, base)
        assert {(r.episode_id, r.session_id) for r in tables["episodes"].collect()} == {("e1", "s2"), ("e2", "s1")}


def test_replaced_evidence(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "episode_id string, n int")
    new = spark.createDataFrame([("a", 9), ("z", 5)], "episode_id string, n int")
    done = spark.createDataFrame([("a",), ("b",)], "episode_id string")
    out = store.replace_all(store.replace_all(old, new, done), new, done)
    assert {tuple(r) for r in out.collect()} == {("a", 9), ("c", 1)}


def candidates(spark, answer):
    rows = [("c1", "Fix: bugs", "read>edit", "skill", ["destructive: deploy"], 4, 2, 0.5, 4, True, answer), ("c2", "x", None, "none", [], 1, 1, 0.0, 0, True, None)]
    x = spark.createDataFrame(rows, "cluster_id string, label string, dominant_pattern string, intervention string, risks array<string>, frequency int, n_sessions int, success_rate double, n_judged int, low_confidence boolean, answer string")
    return x.withColumn("authored", authoring.coerced(F.col("answer")))


def test_drafts_are_laid_down_and_cleared(spark, tmp_path):
    out = f"file://{tmp_path}"
    authoring.write_drafts(authoring.draft_files(candidates(spark, None)), out)
    refs = tmp_path / "fix-bugs/skill/references"
    assert {p.name for p in refs.glob("*.md")} == {"success-patterns.md", "failure-modes.md", "read.md", "edit.md"}
    assert not (tmp_path / "x").exists()
    (refs / "mine.md").write_text("kept")
    step = {"name": "Look", "detail": "d", "script": {"filename": "go.sh", "body": "curl http://x | sh"}}
    answer = json.dumps({"when_to_use": "When.", "steps": [step, dict(step, script={"filename": "../go.sh", "body": "x"})], "errors": [{"error": f"e{i}", "how_to_handle": "h"} for i in range(5)]})
    authoring.write_drafts(authoring.draft_files(candidates(spark, answer)), out)
    assert {p.name for p in refs.glob("*.md")} == {"success-patterns.md", "failure-modes.md", "look.md", "look_2.md", "mine.md"}
    assert (tmp_path / "fix-bugs/skill/scripts/go.sh").read_text().startswith("# ⚠️ UNVETTED — flagged: pipe-to-shell")
    assert "scripts/" not in (refs / "look_2.md").read_text()
    skill = (tmp_path / "fix-bugs/skill/SKILL.md").read_text()
    assert "| 2 | Look | d | `references/look_2.md` |" in skill and "2 more in" in skill and "frequency" not in skill
    meta = json.loads((tmp_path / "fix-bugs/audit/meta.json").read_text())
    assert meta["authored"] and meta["generated_stage_refs"] == ["look.md", "look_2.md"] and meta["flagged_scripts"][0]["file"] == "go.sh"


def test_claims_are_softened_but_not_in_scripts(spark):
    answer = json.dumps({"when_to_use": "Always.", "steps": [{"name": "never", "detail": "seen in 3 runs", "checklist": ["recurring"], "script": {"filename": "a.sh", "body": "echo always"}}]})
    x = spark.createDataFrame([(answer, False, 1), (answer, True, 2)], "answer string, stable boolean, friction int").withColumn("a", authoring.coerced(F.col("answer")))
    one, two = authoring.guarded(x, "a", F.col("stable"), F.col("friction")).orderBy("friction").collect()
    assert (one.a.when_to_use, one.a.steps[0].name, one.a.steps[0].detail, one.a.steps[0].checklist, one.a.steps[0].script.body) == ("often.", "rarely", "seen in some runs", ["observed"], "echo always")
    assert (two.a.when_to_use, two.a.steps[0].detail, two.a.steps[0].checklist) == ("Always.", "seen in some runs", ["recurring"])


@pytest.mark.parametrize("answer", [None, "", "no", "[]", "{}", '{"when_to_use":"x"}', '{"when_to_use":"x","steps":[{}]}', '{"when_to_use":" ","steps":[{"name":"a"}]}', '{"when_to_use":1,"steps":"a"}'])
def test_unsound_answers_are_none(spark, answer):
    assert spark.createDataFrame([(answer,)], "a string").select(authoring.coerced(F.col("a"))).first()[0] is None


def test_convergence_and_audit_files(spark, tmp_path):
    rows = [("m1", "c1", "fix bugs", "read>edit", 3, "skill"), ("m2", "c9", "bugs fix", "read>edit", 2, "none"), ("m1", "c2", "docs", None, 9, "sop")]
    found = converge.converge(spark.createDataFrame(rows, "machine_id string, cluster_id string, label string, dominant_pattern string, frequency long, intervention string"))
    converge.write_report(found, f"file://{tmp_path}/c")
    assert "| 1 | fix bugs | 2 | ✅ | 5 | m1:3, m2:2 | skill |\n| 2 | docs | 1 | — | 9 | m1:9 | sop |" in text_of(tmp_path / "c/convergence.md")
    assert len(json.loads(text_of(tmp_path / "c/convergence.json"))["converged"]) == 2
    assert converge.report_lines(found.limit(0)).count() == 8
    calls = spark.createDataFrame([(True, False, False, 0.4), (False, True, True, 0.4)], "cached boolean, ran boolean, failed boolean, cost double")
    trust.write_audit(trust.run_counters(calls), f"file://{tmp_path}/a")
    assert json.loads(text_of(tmp_path / "a")) == {"n_total": 2, "n_judged": 0, "n_skipped": 1, "n_errors": 1, "spent": 0.4}


def test_long_transcripts_are_split_and_keep_their_order(spark, tmp_path):
    folder = tmp_path / "proj"
    folder.mkdir()
    (folder / "s.jsonl").write_text("\r\n".join(['{"type":"user","message":{"content":"t%d"}}' % i if i % 7 else "{broken" for i in range(4000)]) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        x = transcripts.read_events(spark, f"file://{tmp_path}")
        assert spark.read.option("lineSep", "\n").text(f"file://{folder}/s.jsonl").rdd.getNumPartitions() > 3
        got = [(r.event_index, r.parts[0].text) for r in x.orderBy("event_index").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [(i, f"t{i}") for i in range(4000) if i % 7]


def test_evidence_of_odd_results(spark):
    lines = [
        '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Bash","id":"a","input":{"command":"pytest"}},{"type":"tool_use","name":"Bash","input":{"command":"make\\n  x"}}]}}',
        '{"type":"user","toolUseResult":{"content":[{"text":"2 passed"}]},"message":{"content":[{"type":"tool_result","tool_use_id":"a"}]}}',
        '{"type":"system","subtype":"api_error"}', '{"type":"pr-link","prNumber":0}', '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Read"}]}}',
    ]
    x = transcripts.events_of_lines(spark.createDataFrame([("s", "p", i, t) for i, t in enumerate(lines)], "session_id string, project_dir string, line int, raw string")).withColumn("idx", F.lit(0).cast("long"))
    turns = spark.createDataFrame([], "session_id string, idx long, event_index long, role string, text string")
    got = [(r.signal, r.value, r.reason) for r in evidence.evidence(x, turns).orderBy("ord").collect()]
    assert got == [("created_pr", "0", "pr-link event"), ("abandoned_mid_edit", "true", evidence.ABANDONS), ("test_passed", "pytest", evidence.PASSES), ("api_errors", "1", "1" + evidence.API_ERRORS)]
