"""Authored drafts: lenient coercion of what an author returns, cleaning of nested texts, Markdown, and the files of a draft.

An author is a caller as in operators.labeling: it returns one JSON object for a prompt. All
that is not of the kind a field asks for is dropped, an object without a purpose or without a
step counts as none, and then the deterministic scaffold stands.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.privacy import RULES, SOME
from ..functions.text import bound, js_trim, slugify
from .draft import clamp_description, draft_role, draft_steps, evidence_strength, first_sentence, is_draftable, overclaim_guard, safe_script_name, script_risks, stage_files, table_cell, yaml_scalar
from .labeling import answered, is_object, kind_of

#: Files of a draft that are never cleaned away, and headings.
FIXED_REFS = ("success-patterns.md", "failure-modes.md")
DOMAIN, LICENSE, PRIVACY_VERSION = "software-engineering", "MIT", "1"
SAFETY = "## Safety\nCommit, push, open or merge pull requests, deploy, publish or rewrite history only when the user asks for it in this conversation. Prefer steps that are local and can be undone."
UNVETTED = "# ⚠️ UNVETTED — flagged: "
HOT_ERRORS = 3
LATER = "_Written when evidence of labelled episodes is available._"


# ------------------------------------------------------------- coercion


def _text(v: Column, path: str, trim: bool = True) -> Column:
    """A text; what is none is empty."""
    x = F.when(kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(""))
    return js_trim(x) if trim else x


def _texts(v: Column, path: str) -> Column:
    """The texts of a list that are not blank, trimmed."""
    own = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: _text(x, "$"))
    return F.coalesce(F.filter(own, lambda x: x != ""), F.array().cast("array<string>"))


def _objects(v: Column, path: str, made: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Objects of a list, each made by made(), that keep() holds for."""
    own = F.filter(F.try_variant_get(v, path, "array<variant>"), is_object)
    return F.filter(F.transform(own, made), keep)


def _example(v: Column) -> Column:
    return F.struct(*[_text(v, f"$.{n}").alias(n) for n in ("good", "bad", "note")])


def _script(v: Column) -> Column:
    language = F.coalesce(F.nullif(_text(v, "$.script.language"), F.lit("")), F.lit("sh"))
    made = F.struct(_text(v, "$.script.filename").alias("filename"), language.alias("language"), _text(v, "$.script.purpose").alias("purpose"), _text(v, "$.script.body", trim=False).alias("body"))
    return bound(made, lambda s: F.when((s["filename"] != "") & (js_trim(s["body"]) != ""), s))


def _step(v: Column) -> Column:
    plain = [_text(v, f"$.{n}").alias(n) for n in ("name", "detail", "how_to", "ask_user", "web_search", "error_handling")]
    lists = [_texts(v, f"$.{n}").alias(n) for n in ("inputs_needed", "steps_detail", "edge_cases", "common_mistakes", "checklist")]
    examples = F.coalesce(_objects(v, "$.examples", _example, lambda e: e["good"] != ""), F.array().cast("array<struct<good:string,bad:string,note:string>>"))
    return F.struct(*plain, *lists, examples.alias("examples"), _script(v).alias("script"))


def coerced(answer: Column) -> Column:
    """An author's answer as a struct; null without a when_to_use and at least one step that has a name or a detail."""

    def made(v: Column) -> Column:
        purpose = _text(v, "$.when_to_use")
        steps = _objects(v, "$.steps", _step, lambda s: (s["name"] != "") | (s["detail"] != ""))
        return bound(F.when(is_object(v), F.struct(purpose.alias("purpose"), steps.alias("steps"))), lambda known: used(v, known["purpose"], known["steps"]))

    def used(v: Column, purpose: Column, steps: Column) -> Column:
        described = F.coalesce(F.nullif(_text(v, "$.description"), F.lit("")), first_sentence(purpose))
        errors = _objects(v, "$.errors", lambda e: F.struct(_text(e, "$.error").alias("error"), _text(e, "$.how_to_handle").alias("how_to_handle")), lambda e: e["error"] != "")
        out = F.struct(
            described.alias("description"), purpose.alias("when_to_use"), F.nullif(_text(v, "$.optimal_workflow"), F.lit("")).alias("optimal_workflow"), _texts(v, "$.checklist").alias("checklist"), steps.alias("steps"),
            F.coalesce(errors, F.array().cast("array<struct<error:string,how_to_handle:string>>")).alias("errors"), _text(v, "$.success_patterns_summary").alias("summary"),
            _texts(v, "$.triggers").alias("triggers"), _text(v, "$.domain").alias("domain"), _text(v, "$.role").alias("role"),
            F.struct(_texts(v, "$.constraints.must_do").alias("must_do"), _texts(v, "$.constraints.must_not").alias("must_not")).alias("constraints"),
            F.struct(*[_text(v, f"$.references.{n}").alias(n) for n in ("success_patterns_md", "failure_modes_md", "evidence_md")]).alias("references"),
        )
        return F.when((purpose != "") & (F.coalesce(F.size(steps), F.lit(0)) > 0), out)

    return bound(answered(answer), made)


# ------------------------------------------------------------- cleaning


def clean(x: Column) -> Column:
    """A text after all rules of the privacy gate; these run on texts that hold what some rule needs."""
    ruled = lambda t: reduce(lambda y, rule: F.regexp_replace(y, rule[1], rule[2].replace("$", r"\$")), RULES, t)
    return bound(x, lambda t: F.when(t.rlike(SOME), ruled(t)).otherwise(t))


def each_text(x: Column, kind: T.DataType, f: Callable[[Column], Column], but: tuple[str, ...] = ()) -> Column:
    """x with f applied to every text in it, however deep, but in the fields named."""
    if isinstance(kind, T.StringType):
        return f(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: each_text(e, kind.elementType, f, but))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[(x[c.name] if c.name in but else each_text(x[c.name], c.dataType, f, but)).alias(c.name) for c in kind.fields]))
    return x


def guarded(rows: DataFrame, column: str, stable: Column, max_friction: Column) -> DataFrame:
    """rows with claims softened that the evidence does not carry, in every text of an authored column but its scripts."""
    return rows.withColumn(column, each_text(F.col(column), rows.schema[column].dataType, lambda x: overclaim_guard(x, stable, max_friction), ("script",)))


def cleaned(rows: DataFrame, column: str) -> DataFrame:
    """rows with every text of a nested column cleaned."""
    return rows.withColumn(column, each_text(F.col(column), rows.schema[column].dataType, clean))


# ------------------------------------------------------------- Markdown


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _section(heading: str, lines: Column) -> Column:
    """The lines under their heading, behind a blank line; nothing where there are none."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n## {heading}\n\n"), _join(lines))).otherwise(F.lit(""))


def _said(heading: str, x: Column) -> Column:
    return F.when(x != "", F.concat(F.lit(f"\n\n## {heading}\n\n"), x)).otherwise(F.lit(""))


def _bullets(items: Column, mark: str = "- ") -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(mark), x))


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def fence(body: Column) -> Column:
    """A code fence longer than any run of backticks in the body."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("`+"), 0), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def _example_text(e: Column) -> Column:
    def side(mark: str, x: Column) -> Column:
        block = F.concat(F.lit(f"**{mark}**\n\n"), fence(x), F.lit("\n"), x, F.lit("\n"), fence(x), F.lit("\n"))
        return F.when(x == "", None).when(x.contains("\n"), block).otherwise(F.concat(F.lit(f"- **{mark}:** "), x))

    return F.concat_ws("\n", side("✅ Good", e["good"]), side("❌ Bad", e["bad"]), F.when(e["note"] != "", F.concat(F.lit("- _Note: "), e["note"], F.lit("_"))))


def stage_markdown(s: Column) -> Column:
    """The file of an authored stage: a section for each field that is there."""
    intro = F.coalesce(F.nullif(s["how_to"], F.lit("")), s["detail"])
    script = F.when(s["script"].isNotNull(), F.concat(F.lit("`scripts/"), s["script"]["filename"], F.lit("` — "), s["script"]["purpose"])).otherwise(F.lit(""))
    return F.concat(
        F.lit("# "), F.coalesce(F.nullif(s["name"], F.lit("")), F.lit("Stage")), F.lit("\n"), F.when(intro != "", F.concat(F.lit("\n"), intro)).otherwise(F.lit("")),
        _section("How to do it", _numbered(s["steps_detail"])), F.when(F.size(s["examples"]) > 0, F.concat(F.lit("\n\n## Examples\n\n"), F.array_join(F.transform(s["examples"], _example_text), "\n\n"))).otherwise(F.lit("")),
        _section("Edge cases", _bullets(s["edge_cases"])), _section("Common mistakes", _bullets(s["common_mistakes"])), _section("Inputs needed", _bullets(s["inputs_needed"])),
        _said("When to ask the user", s["ask_user"]), _said("When to search the web", s["web_search"]), _said("Error handling", s["error_handling"]), _said("Script", script),
        _section("Checklist", _bullets(s["checklist"], "- [ ] ")), F.lit("\n"),
    )


def stage_scaffold(name: Column) -> Column:
    """The file of a stage that nobody authored."""
    heads = ["How to do it", "Examples", "Edge cases", "Common mistakes", "Error handling", "Checklist"]
    return F.concat(F.lit("# "), F.coalesce(F.nullif(name, F.lit("")), F.lit("Stage")), F.lit("\n" + "".join(f"\n## {h}\n{LATER}\n" for h in heads)))


def frontmatter(slug: Column, description: Column, triggers: Column, domain: Column, role: Column) -> Column:
    """The YAML head of a published draft: no mined counts, every scalar quoted, triggers as a block list."""
    some = F.filter(triggers, lambda t: F.trim(t) != "")
    listed = F.when(F.size(some) > 0, F.concat(F.lit("\n"), _join(F.transform(some, lambda t: F.concat(F.lit("    - "), yaml_scalar(t)))))).otherwise(F.lit(" []"))
    return F.concat(
        F.lit("---\nname: "), yaml_scalar(slug), F.lit("\ndescription: "), yaml_scalar(description), F.lit(f'\nlicense: "{LICENSE}"\nmetadata:\n  version: "0.1.0"\n  auto_generated: true\n  domain: '), yaml_scalar(domain),
        F.lit("\n  role: "), yaml_scalar(role), F.lit("\n  triggers:"), listed, F.lit(f'\n  privacy_rules_version: "{PRIVACY_VERSION}"\n---'),
    )


def _scaffold(slug: Column, stages: Column) -> Column:
    label = F.col("label")
    head = frontmatter(slug, F.concat(F.lit('Automate the recurring workflow "'), label, F.lit('".')), F.array(label), F.lit(DOMAIN), draft_role(F.col("intervention")))
    lines = F.transform(stages, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". **"), s["name"], F.lit("** — see `references/"), s["file_name"], F.lit("`.")))
    risks = F.when(F.size("risks") > 0, F.array_join("risks", ", ")).otherwise(F.lit("none recorded"))
    return F.concat(
        head, F.lit("\n\n# "), label, F.lit('\n\n## When to use\nUse this skill for the recurring task "'), label, F.lit('".\n\n## Workflow\n'), _join(lines), F.lit(f"\n\n{SAFETY}\n\n## Errors & handling\nSee `references/failure-modes.md`. Risk signals: "),
        risks, F.lit(".\n"),
    )


def _written(slug: Column, stages: Column) -> Column:
    a, label = F.col("authored"), F.col("label")
    or_else = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)
    triggers = F.when(F.size(a["triggers"]) > 0, a["triggers"]).otherwise(F.array(label))
    head = frontmatter(slug, clamp_description(a["description"]), triggers, or_else(a["domain"], F.lit(DOMAIN)), or_else(a["role"], draft_role(F.col("intervention"))))
    row = lambda s, i: F.concat(F.lit("| "), F.concat_ws(" | ", (i + 1).cast("string"), table_cell(s["name"]), table_cell(s["detail"]), F.concat(F.lit("`references/"), s["file_name"], F.lit("`"))), F.lit(" |"))
    guide = lambda s: F.concat(F.lit("| `references/"), s["file_name"], F.lit("` | "), table_cell(s["name"]), F.when(s["detail"] != "", F.concat(F.lit(" — "), table_cell(s["detail"]))).otherwise(F.lit("")), F.lit(" |"))
    halves = [F.when(F.size(a["constraints"][n]) > 0, F.concat(F.lit(f"\n**{t}**\n"), _join(_bullets(a["constraints"][n])), F.lit("\n"))).otherwise(F.lit("")) for n, t in (("must_do", "MUST DO"), ("must_not", "MUST NOT"))]
    bound_by = F.when((F.size(a["constraints"]["must_do"]) > 0) | (F.size(a["constraints"]["must_not"]) > 0), F.concat(F.lit("\n## Constraints\n"), *halves)).otherwise(F.lit(""))
    checks = F.when(F.size(a["checklist"]) > 0, F.concat(F.lit("\n## Quick checklist\n"), _join(_bullets(a["checklist"], "- [ ] ")), F.lit("\n"))).otherwise(F.lit(""))
    handled = _join(F.transform(F.slice(a["errors"], 1, HOT_ERRORS), lambda e: F.concat(F.lit("- **"), e["error"], F.lit("** → "), e["how_to_handle"])))
    more = F.when(F.size(a["errors"]) > HOT_ERRORS, F.concat(F.lit("\n- _…"), (F.size(a["errors"]) - HOT_ERRORS).cast("string"), F.lit(" more in `references/failure-modes.md`._"))).otherwise(F.lit(""))
    errors = F.when(F.size(a["errors"]) == 0, F.lit("_See `references/failure-modes.md`._")).otherwise(F.concat(handled, more))
    fixed = "\n| `references/success-patterns.md` | Recommended workflow and what worked |\n| `references/failure-modes.md` | Failure modes and how to handle them |\n"
    return F.concat(
        head, F.lit("\n\n# "), label, F.lit("\n\n## When to use\n"), a["when_to_use"], F.lit("\n"), checks, F.lit("\n## Workflow\n| # | Step | What it does | Reference |\n| --- | --- | --- | --- |\n"), _join(F.transform(stages, row)), F.lit("\n"),
        bound_by, F.lit(f"\n{SAFETY}\n\n## Errors & handling\n"), errors, F.lit("\n\n## Reference guide\n| Reference | Read when |\n| --- | --- |\n"), _join(F.transform(stages, guide)), F.lit(fixed),
    )


def _references() -> dict[str, Column]:
    a, label = F.col("authored"), F.col("label")
    failures = F.array_join(F.transform(a["errors"], lambda e: F.concat(F.lit("### "), e["error"], F.lit("\n"), e["how_to_handle"])), "\n\n")
    or_none = lambda x, none: F.coalesce(F.nullif(x, F.lit("")), F.lit(none))
    good = F.concat(F.lit("\n\n## Recommended workflow\n"), or_none(a["optimal_workflow"], "_(none written)_"), F.lit("\n\n## What worked\n"), or_none(a["summary"], "_(none written)_"), F.lit("\n\n"), a["references"]["success_patterns_md"], F.lit("\n"))
    bad = F.concat(F.lit("\n\n"), or_none(a["references"]["failure_modes_md"], "_(none written)_"), F.lit("\n\n## Errors & handling\n"), or_none(failures, "_(none written)_"), F.lit("\n"))
    pattern = F.concat(F.lit("\n\nWorkflow stages: `"), F.coalesce(F.nullif(F.col("dominant_pattern"), F.lit("")), F.lit("explore>edit>verify")), F.lit(f"`.\n\n{LATER}\n"))
    risks = F.concat(F.lit("\n\nRisk signals:\n"), or_none(_join(_bullets(F.col("risks"))), "_none recorded_"), F.lit(f"\n\n{LATER}\n"))
    return {
        "success-patterns.md": F.concat(F.lit("# Success patterns — "), label, F.when(a.isNotNull(), good).otherwise(pattern)),
        "failure-modes.md": F.concat(F.lit("# Failure modes & handling — "), label, F.when(a.isNotNull(), bad).otherwise(risks)),
    }


def _audit(slug: Column) -> dict[str, Column]:
    """Mined counts, which are never published."""
    count = lambda n: F.concat(F.lit(f"- {n}: "), F.col(n).cast("string"))
    strength = evidence_strength(F.col("low_confidence"), F.col("n_judged"))
    lines = F.concat_ws("\n", *[count(n) for n in ("frequency", "n_sessions", "success_rate", "n_judged", "low_confidence")], F.concat(F.lit("- evidence_strength: "), strength))
    flagged = F.transform(F.filter("files", lambda f: f["reason"] != ""), lambda f: F.struct(F.element_at(F.split(f["path"], "/"), -1).alias("file"), f["reason"].alias("reason")))
    meta = F.struct(
        slug.alias("slug"), "cluster_id", "label", "intervention", "success_rate", "frequency", "n_judged", "low_confidence", strength.alias("evidence_strength"), F.lit(PRIVACY_VERSION).alias("privacy_rules_version"),
        F.col("authored").isNotNull().alias("authored"), F.transform("stages", lambda s: s["file_name"]).alias("generated_stage_refs"), flagged.alias("flagged_scripts"),
    )
    return {"evidence.md": F.concat(F.lit("# Evidence — "), F.col("label"), F.lit("\n\n"), lines, F.lit("\n")), "meta.json": F.to_json(meta)}


def draft_files(candidates: DataFrame) -> DataFrame:
    """(slug, path, content) of every file of the drafts of draftable candidates.

    candidates: cluster_id, label, dominant_pattern, intervention, risks, frequency, n_sessions,
    success_rate, n_judged, low_confidence, and authored (see coerced; null: the scaffold). Its
    texts are cleaned here. Scripts whose name could leave their folder are left out with their
    link; flagged ones carry a warning. Candidates of one slug would share files: their labels tell them apart.
    """
    x = cleaned(cleaned(candidates.where(is_draftable(F.col("intervention"))), "authored"), "label").withColumn("slug", slugify(F.col("label")))
    kind = x.schema["authored"].dataType["steps"].dataType.elementType

    def safe(s: Column) -> Column:
        name = safe_script_name(s["script"]["filename"])
        script = F.when(name.isNotNull(), s["script"].withField("filename", name))
        return F.struct(*[(script if f == "script" else s[f]).alias(f) for f in kind.names])

    named = lambda n: F.struct(n.alias("name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields if f.name != "name"])
    plain = F.transform(draft_steps(F.col("dominant_pattern")), lambda s: named(clean(s)))
    none = F.lit("")

    def files_of(s: Column, written: Callable[[Column], Column]) -> Column:
        """A stage's file and its script, if it has one."""

        def script(reasons: Column) -> Column:
            body = F.concat(F.when(reasons != "", F.concat(F.lit(UNVETTED), reasons, F.lit("; review before running\n"))).otherwise(none), s["script"]["body"])
            return F.struct(F.concat(F.lit("skill/scripts/"), s["script"]["filename"]).alias("path"), body.alias("content"), reasons.alias("reason"))

        own = F.struct(F.concat(F.lit("skill/references/"), s["file_name"]).alias("path"), written(s).alias("content"), none.alias("reason"))
        return F.when(s["script"].isNull(), F.array(own)).otherwise(F.array(own, bound(F.array_join(script_risks(s["script"]["body"]), "; "), script)))

    # A candidate's steps, which are few, stay in its row: nothing is shuffled, and no candidate is made twice.
    authored = F.col("authored").isNotNull()
    x = x.withColumn("_steps", F.when(authored, F.transform("authored.steps", safe)).otherwise(plain))
    x = x.withColumn("_names", stage_files(F.transform("_steps", lambda s: s["name"])))
    x = x.withColumn("stages", F.zip_with("_steps", "_names", lambda s, n: F.struct(*[s[f].alias(f) for f in kind.names if f != "detail"], F.coalesce(s["detail"], none).alias("detail"), n.alias("file_name")))).drop("_steps", "_names")
    x = x.withColumn("files", F.flatten(F.when(authored, F.transform("stages", lambda s: files_of(s, stage_markdown))).otherwise(F.transform("stages", lambda s: files_of(s, lambda t: stage_scaffold(t["name"]))))))
    slug, stages = F.col("slug"), F.col("stages")
    fixed = {"skill/SKILL.md": F.when(F.col("authored").isNotNull(), _written(slug, stages)).otherwise(_scaffold(slug, stages))}
    fixed |= {f"skill/references/{n}": c for n, c in _references().items()} | {f"audit/{n}": c for n, c in _audit(slug).items()}
    every = F.concat(F.array(*[F.struct(F.lit(p).alias("path"), c.alias("content"), none.alias("reason")) for p, c in fixed.items()]), F.col("files"))
    # An explode() would have Spark make all files a second time, in a filter pushed down to the scan, to leave out candidates without any.
    some = F.when(F.size("stages") > 0, every)
    return x.select("slug", F.explode_outer(some).alias("f")).where("f is not null").select("slug", "f.path", "f.content")


def stale_files(before: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, path) of generated stage files that the drafts now leave out. before: slug, meta (the JSON of an earlier audit/meta.json).

    Only what an earlier manifest lists can go: fixed references and files that people added stay.
    """
    listed = before.select("slug", F.explode(F.from_json(F.get_json_object("meta", "$.generated_stage_refs"), "array<string>")).alias("n")).where(~F.col("n").isin(*FIXED_REFS))
    old = listed.select("slug", F.concat(F.lit("skill/references/"), "n").alias("path"))
    now = files.groupBy("slug").agg(F.collect_set("path").alias("_now"))  # a draft's files: few
    return old.join(now, "slug").where(~F.array_contains("_now", F.col("path"))).select("slug", "path").distinct()


def write_drafts(files: DataFrame, path: str) -> None:
    """Lay the files of the drafts down below path and clear away their stale stage files. Drafts are few: the driver writes them one by one."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{path}/{p}")
    fs = at("").getFileSystem(conf)
    rows = files.collect()
    for slug in sorted({r.slug for r in rows}):
        meta = at(f"{slug}/audit/meta.json")
        if fs.exists(meta):
            text = spark.read.text(meta.toString(), wholetext=True).first()[0]
            now = {r.path for r in rows if r.slug == slug}
            for name in json.loads(text).get("generated_stage_refs", []):
                if name not in FIXED_REFS and f"skill/references/{name}" not in now:
                    fs.delete(at(f"{slug}/skill/references/{name}"), False)
    for r in rows:
        out = fs.create(at(f"{r.slug}/{r.path}"), True)
        out.write(bytearray(r.content.encode()))
        out.close()
