"""Queries of authored drafts: parts stand in for candidates, their names for what an author returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authoring as A
from ..operators.store import once, spread
from . import bindings as D
from .registry import oracle, query


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, p_name, p_brand, answer): objects with fields of the wrong kind, without a purpose, without steps."""
    k = F.col("p_partkey")
    n = k.cast("string")
    step = F.concat(
        F.lit('{"name":"Read '), n, F.lit('","detail":'), F.when(k % 5 == 0, F.lit("7")).otherwise('" look | see "'), F.lit(',"how_to":"","inputs_needed":["a",3," "],"ask_user":"mail x@site.org","steps_detail":['), F.when(k % 2 == 0, '"one","two"').otherwise(""),
        F.lit('],"examples":[{"good":"use it"},{"bad":"no good"},{"good":"l1\\nl2 `x`","bad":"b","note":"n"}],"checklist":["done"]'), F.when(k % 3 == 0, ',"script":{"filename":"run.sh","body":"rm -rf /tmp/x","purpose":"p"}').when(k % 3 == 1, ',"script":{"filename":"../run.sh","body":"x"}').otherwise(""), F.lit("}"),
    )
    more = F.when(k % 4 == 0, ',{"name":"Read %","detail":"again"}').when(k % 4 == 1, ',"text",{"name":" "}').otherwise("")
    errors = F.when(k % 6 == 0, '[{"error":"e1","how_to_handle":"h1"},{"error":""},{"error":"e2"},{"error":"e3"},{"error":"e4"}]').otherwise("{}")
    text = F.concat(
        F.lit('{"when_to_use":'), F.when(k % 13 == 0, '"  "').otherwise(F.concat(F.lit('" Use '), "p_name", F.lit('. Then more "'))), F.lit(',"steps":'), F.when(k % 17 == 0, '[{"x":1}]').otherwise(F.concat(F.lit("["), step, F.replace(more, F.lit("%"), n), F.lit("]"))),
        F.lit(',"errors":'), errors, F.lit(',"triggers":["t1",2],"constraints":{"must_do":["m"]},"checklist":"none","references":{"failure_modes_md":"F"}}'),
    )
    return spread(D.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")).select("p_partkey", "p_name", "p_brand", F.when(k % 19 == 0, "no answer").otherwise(F.concat(F.lit("so:\n"), text)).alias("answer"))


_OK = "p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0"
_STEP = """'# Read ' || k || chr(10) || CASE WHEN k % 5 = 0 THEN '' ELSE chr(10) || 'look | see' END || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || '## How to do it' || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' ELSE '' END
  || chr(10) || chr(10) || '## Examples' || chr(10) || chr(10) || '- **✅ Good:** use it' || chr(10) || chr(10) || '**✅ Good**' || chr(10) || chr(10) || '```' || chr(10) || 'l1' || chr(10) || 'l2 `x`' || chr(10) || '```' || chr(10) || chr(10) || '- **❌ Bad:** b' || chr(10) || '- _Note: n_'
  || chr(10) || chr(10) || '## Inputs needed' || chr(10) || chr(10) || '- a' || chr(10) || chr(10) || '## When to ask the user' || chr(10) || chr(10) || 'mail [EMAIL]'
  || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || '## Script' || chr(10) || chr(10) || '`scripts/run.sh` — p' ELSE '' END || chr(10) || chr(10) || '## Checklist' || chr(10) || chr(10) || '- [ ] done' || chr(10)"""


@query
def authored_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each answer."""
    a = _answers(spark, sf).withColumn("a", A.coerced(F.col("answer")))
    s = F.col("a.steps")
    return a.select(
        "p_partkey", F.col("a.description").alias("description"), F.col("a.when_to_use").alias("purpose"), F.array_join(F.transform(s, lambda x: x["name"]), "|").alias("steps"), F.array_join(s[0]["inputs_needed"], "|").alias("inputs"),
        F.size(s[0]["examples"]).alias("n_examples"), s[0]["script"]["filename"].alias("script"), F.array_join(F.transform("a.errors", lambda e: F.concat_ws(":", e["error"], e["how_to_handle"])), "|").alias("errors"),
        F.array_join("a.triggers", "|").alias("triggers"), F.size("a.checklist").alias("n_checks"), F.col("a.references.failure_modes_md").alias("failures"),
    )


oracle(
    "authored_coerce",
    f"""WITH x AS (SELECT p_partkey, p_partkey AS k, p_name, {_OK} AS ok FROM part)
    SELECT p_partkey, CASE WHEN ok THEN 'Use ' || p_name || '.' END AS description, CASE WHEN ok THEN 'Use ' || p_name || '. Then more' END AS purpose, CASE WHEN ok THEN 'Read ' || k || CASE WHEN k % 4 = 0 THEN '|Read ' || k ELSE '' END END AS steps,
    CASE WHEN ok THEN 'a' END AS inputs, CASE WHEN ok THEN 2 END AS n_examples, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 'run.sh' WHEN 1 THEN '../run.sh' END END AS script,
    CASE WHEN ok THEN CASE WHEN k % 6 = 0 THEN 'e1:h1|e2:|e3:|e4:' ELSE '' END END AS errors, CASE WHEN ok THEN 't1' END AS triggers, CASE WHEN ok THEN 0 END AS n_checks, CASE WHEN ok THEN 'F' END AS failures FROM x""",
)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    x = _answers(spark, sf).select(
        k.cast("string").alias("cluster_id"), F.concat_ws(" ", F.lit("Task"), k.cast("string"), F.lit("by a@b.org")).alias("label"), F.when(k % 3 == 0, "read>edit>Read").alias("dominant_pattern"), F.when(k % 7 == 0, "none").when(k % 2 == 0, "script").otherwise("skill").alias("intervention"),
        F.when(k % 8 == 0, F.array(F.lit("destructive: deploy"))).otherwise(F.array().cast("array<string>")).alias("risks"), k.alias("frequency"), F.lit(2).alias("n_sessions"), F.lit(0.5).alias("success_rate"), (k % 9).alias("n_judged"), (k % 9 < 5).alias("low_confidence"),
        A.coerced(F.col("answer")).alias("authored"),
    )
    return A.draft_files(x)


@query
def draft_stage_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stage files and scripts of all drafts."""
    return _files(spark, sf).where("path like 'skill/references/read%' or path like 'skill/scripts/%' or path like 'skill/references/edit%' or path like 'skill/references/explore%' or path like 'skill/references/verify%'")


_LATER = "'_Written when evidence of labelled episodes is available._'"
_STUB = " || ".join(f"chr(10) || '## {h}' || chr(10) || {_LATER} || chr(10)" for h in ("How to do it", "Examples", "Edge cases", "Common mistakes", "Error handling", "Checklist"))
oracle(
    "draft_stage_files",
    f"""WITH x AS (SELECT p_partkey AS k, {_OK} AS ok, 'task-' || p_partkey || '-by-email' AS slug FROM part WHERE p_partkey % 7 <> 0),
    st AS (SELECT k, slug, unnest(CASE WHEN k % 3 = 0 THEN ['read', 'edit', 'Read'] ELSE ['explore', 'edit', 'verify'] END) AS name, unnest(CASE WHEN k % 3 = 0 THEN ['read', 'edit', 'read_2'] ELSE ['explore', 'edit', 'verify'] END) AS file FROM x WHERE NOT ok)
    SELECT slug, 'skill/references/read_' || k || '.md' AS path, {_STEP} AS content FROM x WHERE ok
    UNION ALL SELECT slug, 'skill/references/read_' || k || '_2.md', '# Read ' || k || chr(10) || chr(10) || 'again' || chr(10) FROM x WHERE ok AND k % 4 = 0
    UNION ALL SELECT slug, 'skill/scripts/run.sh', '# ⚠️ UNVETTED — flagged: rm -rf; review before running' || chr(10) || 'rm -rf /tmp/x' FROM x WHERE ok AND k % 3 = 0
    UNION ALL SELECT slug, 'skill/references/' || file || '.md', '# ' || name || chr(10) || {_STUB} FROM st""",
)


@query
def draft_tree(spark: SparkSession, sf: str) -> DataFrame:
    """All paths of the drafts and, of the published head and the audit, the first lines."""
    x = _files(spark, sf)
    head = F.when(F.col("path") == "skill/SKILL.md", F.array_join(F.slice(F.split("content", "\n"), 1, 14), "\n")).when(F.col("path") == "audit/evidence.md", F.col("content"))
    return x.select("slug", "path", head.alias("head"))


oracle(
    "draft_tree",
    f"""WITH x AS (SELECT p_partkey AS k, p_name, {_OK} AS ok, 'task-' || p_partkey || '-by-email' AS slug, 'Task ' || p_partkey || ' by [EMAIL]' AS label FROM part WHERE p_partkey % 7 <> 0),
    f AS (SELECT k, unnest(['skill/SKILL.md', 'skill/references/success-patterns.md', 'skill/references/failure-modes.md', 'audit/evidence.md', 'audit/meta.json']) AS path FROM x
      UNION ALL SELECT k, unnest(CASE WHEN ok THEN ['skill/references/read_' || k || '.md'] WHEN k % 3 = 0 THEN ['skill/references/read.md', 'skill/references/edit.md', 'skill/references/read_2.md'] ELSE ['skill/references/explore.md', 'skill/references/edit.md', 'skill/references/verify.md'] END) FROM x
      UNION ALL SELECT k, 'skill/references/read_' || k || '_2.md' FROM x WHERE ok AND k % 4 = 0 UNION ALL SELECT k, 'skill/scripts/run.sh' FROM x WHERE ok AND k % 3 = 0)
    SELECT slug, path, CASE path WHEN 'skill/SKILL.md' THEN array_to_string(['---', 'name: "' || slug || '"', 'description: "' || CASE WHEN ok THEN 'Use ' || p_name || '.' ELSE 'Automate the recurring workflow \\"' || label || '\\".' END || '"', 'license: "MIT"', 'metadata:', '  version: "0.1.0"',
      '  auto_generated: true', '  domain: "software-engineering"', '  role: "' || CASE WHEN x.k % 2 = 0 THEN 'automation' ELSE 'implementer' END || '"', '  triggers:', '    - "' || CASE WHEN ok THEN 't1' ELSE label END || '"', '  privacy_rules_version: "1"', '---', ''], chr(10))
    WHEN 'audit/evidence.md' THEN '# Evidence — ' || label || chr(10) || chr(10) || array_to_string(['- frequency: ' || x.k, '- n_sessions: 2', '- success_rate: 0.5', '- n_judged: ' || x.k % 9, '- low_confidence: ' || (x.k % 9 < 5), '- evidence_strength: ' || CASE WHEN x.k % 9 >= 5 THEN 'strong' ELSE 'weak' END], chr(10)) || chr(10) END AS head
    FROM x JOIN f ON x.k = f.k""",
)


@query
def draft_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Stage files that an earlier draft, the scaffold of every candidate, left and the present one does not have."""
    files = once(_files(spark, sf).select("slug", "path"))
    before = files.select("slug").distinct().select("slug", F.lit('{"generated_stage_refs":["explore.md","edit.md","my.md","failure-modes.md"]}').alias("meta"))
    return A.stale_files(before, files)


oracle(
    "draft_stale",
    f"""WITH x AS (SELECT p_partkey AS k, {_OK} AS ok, 'task-' || p_partkey || '-by-email' AS slug FROM part WHERE p_partkey % 7 <> 0)
    SELECT slug, 'skill/references/my.md' AS path FROM x UNION ALL SELECT slug, 'skill/references/explore.md' FROM x WHERE ok OR k % 3 = 0 UNION ALL SELECT slug, 'skill/references/edit.md' FROM x WHERE ok""",
)
