"""Guards on drafted prose and scripts, and small text parsers of the command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import B, bound
from .mine import DESTRUCTIVE

#: Words for absolutes, count phrases and what replaces them, patterns of unsafe scripts.
ABSOLUTES = [("always", "often"), ("never", "rarely"), ("consistently", "frequently"), ("reliably", "frequently"), ("guaranteed", "observed"), ("every time", "in observed runs")]
COUNTS = [
    (rf"(?i){B}[0-9]+\s+of\s+[0-9]+\s+(runs?|sessions?|episodes?|cases?|times?){B}", "some $1"),
    (rf"(?i){B}(observed|seen|appeared|occurred|happened|found)\s+in\s+[0-9]+(?:\s*[-–]\s*[0-9]+)?\s+(runs?|sessions?|episodes?|cases?|times?){B}", "$1 in some $2"),
    (rf"(?i){B}in\s+[0-9]+\s+(runs?|sessions?|episodes?|cases?){B}", "in some $1"),
    (rf"(?i){B}[0-9]+\s*[×x]{B}", "multiple times"),
    (rf"(?i){B}[0-9]+\s+(runs?|sessions?|episodes?|cases?){B}", "several $1"),
]
UNSAFE = [
    (rf"(?i){B}(?:curl|wget){B}[^\n|]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh){B}", "pipe-to-shell (curl|wget … | sh)"),
    (rf"(?i)(?:cat|cp|scp|less|source|\.)\s+[^\n]*(?:~/\.ssh|/\.ssh/|\.aws/credentials|(?:^|[\s/])\.env{B})", "credential-file read (.ssh/.env/.aws)"),
    (rf"(?i){B}(?:npm|pnpm|yarn|pip|pip3)\s+(?:install|add|i){B}", "arbitrary package install"),
    (rf"(?i){B}git\s+(?:rebase|filter-branch|filter-repo){B}|{B}git\s+reset\s+--hard{B}", "git history-rewrite (rebase/filter-branch/reset --hard)"),
]


def soften_absolutes(x: Column) -> Column:
    for word, other in ABSOLUTES:
        x = F.regexp_replace(x, f"(?i){B}{word}{B}", other)
    return x


def strip_counts(x: Column) -> Column:
    for pattern, other in COUNTS:
        x = F.regexp_replace(x, pattern, other)
    return x


def overclaim_guard(x: Column, stable: Column, max_friction: Column) -> Column:
    """Counts become vague; without a stable pattern absolutes soften; `recurring` needs friction seen twice."""
    out = strip_counts(x)
    out = F.when(stable, out).otherwise(soften_absolutes(out))
    return F.when(max_friction < 2, F.regexp_replace(out, rf"(?i){B}recurring{B}", "observed")).otherwise(out)


def script_risks(body: Column) -> Column:
    """Reasons why a script is flagged, in order."""
    named = [*DESTRUCTIVE, *UNSAFE]
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(n)) for p, n in named]))


def clamp_description(x: Column, most: int = 180) -> Column:
    """One line of at most `most` characters: cut behind a sentence that ends past 40, else between words with an ellipsis."""

    def clamped(t: Column) -> Column:
        end = F.regexp_instr(F.left(t, F.lit(most + 1)), F.lit(r"[.!?](?:\s|$)"))
        cut = F.left(t, F.lit(most))
        words = F.regexp_replace(cut, r" [^ ]*$", "")
        short = F.concat(F.trim(F.when(F.length(words) > 40, words).otherwise(cut)), F.lit("…"))
        return F.when(F.length(t) <= most, t).when(end > 40, F.trim(F.left(t, end))).otherwise(short)

    return bound(F.trim(F.regexp_replace(x, r"\s+", " ")), clamped)


def selection(x: Column, most: Column) -> Column:
    """`1,3,5-8` as sorted distinct numbers from 1 to most; parts that are no number or range are skipped."""

    def numbers(part: Column) -> Column:
        low, high = (F.regexp_extract(part, r"^\s*([0-9]{1,9})\s*(?:-\s*([0-9]{1,9})\s*)?$", k) for k in (1, 2))
        a = F.nullif(low, F.lit("")).cast("int")
        b = F.coalesce(F.nullif(high, F.lit("")).cast("int"), a)
        top = F.least(b, most)
        return F.when(a <= top, F.sequence(a, top)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(x, ","), lambda p: F.coalesce(numbers(p), F.array().cast("array<int>")))), lambda n: (n >= 1) & (n <= most))))


def is_draftable(kind: Column) -> Column:
    return F.coalesce(kind.isin("skill", "script", "sop"), F.lit(False))


def safe_script_name(raw: Column) -> Column:
    """The trimmed name, or null if it could leave its folder or hide."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    bad = (name == "") | name.rlike(r"[/\\]|\.\.|^\.|^[a-zA-Z]:")
    return F.when(~bad, name)


def _stage_base(name: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(base, F.lit(48)), F.lit("")), F.lit("stage"))


def _numbered_file(base: Column, n: Column) -> Column:
    return F.concat(base, F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".md"))


def stage_file_names(steps: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """steps with file_name: a slug of the name, numbered from the second of its kind on."""
    steps = steps.withColumn("_base", _stage_base(F.col(name)))
    n = F.row_number().over(Window.partitionBy(*keys, "_base").orderBy(order))
    return steps.withColumn("file_name", _numbered_file(F.col("_base"), n)).drop("_base")


def stage_files(names: Column) -> Column:
    """The file names of one candidate's stage names, an array, as stage_file_names gives them."""

    def named(bases: Column) -> Column:
        return F.transform(bases, lambda b, i: _numbered_file(b, F.size(F.filter(F.slice(bases, F.lit(1), i + 1), lambda o: o == b))))

    return bound(F.transform(names, _stage_base), named)


def first_sentence(x: Column, most: int = 180) -> Column:
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    first = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"^(.+?[.!?])(?:\s|$)", 1), F.lit("")), t)
    return clamp_description(bound(t, first), most)


def yaml_scalar(x: Column) -> Column:
    """A double-quoted YAML scalar."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), F.regexp_replace(x, r"[\x00-\x1f]", " "), F.lit('"'))


def table_cell(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(x, F.lit("|"), F.lit("\\|")), r"(?:\r?\n)+", " "))


def business_note(label: Column, risks: Column, context: Column) -> Column:
    """The note that stands where no business note was supplied."""
    none = F.lit("No business context supplied — business angle skipped to preserve independent evaluation.")
    flagged = F.when(F.size(risks) > 0, F.concat(F.lit(" Note risk flags: "), F.array_join(risks, ", "), F.lit("."))).otherwise("")
    some = F.concat(F.lit('Relate "'), label, F.lit('" to: "'), F.left(F.trim(context), F.lit(80)), F.lit('". A domain owner must confirm it matches the real process before codifying.'), flagged)
    return F.when(F.trim(context) == "", none).otherwise(some)


def with_notes(candidates: DataFrame, notes: DataFrame, context: str) -> DataFrame:
    """Candidates with their supplied business note, or the deterministic one."""
    own = business_note(F.col("label"), F.col("risks"), F.lit(context))
    return candidates.join(notes.select("cluster_id", "note"), "cluster_id", "left").withColumn("note", F.coalesce("note", own))


def evidence_strength(low_confidence: Column, n_judged: Column) -> Column:
    return F.when(~low_confidence & (F.coalesce(n_judged, F.lit(0)) >= 5), "strong").otherwise("weak")


def draft_steps(pattern: Column) -> Column:
    """Steps of the dominant pattern; explore, edit, verify where there is none."""
    own = F.filter(F.transform(F.split(pattern, ">"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.coalesce(pattern, F.lit("")) != "", own).otherwise(F.array(F.lit("explore"), F.lit("edit"), F.lit("verify")))


def draft_role(kind: Column) -> Column:
    return F.when(kind == "script", "automation").when(kind == "sop", "practitioner").otherwise("implementer")


def parse_exports(lines: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """(keys, name, value) of shell assignments - export, set, $env: or plain, quoted or not; the last of a name wins."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("text"), r"^export\s+", ""), r"^set\s+", ""), r"^\$env:", "")
    s = F.when(s.rlike(r'^".*=.*"$'), F.regexp_extract(s, r'^"(.*)"$', 1)).otherwise(s)
    found = lines.where(~F.trim("text").startswith("#")).withColumn("_s", s).where(F.col("_s").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*="))
    value = F.trim(F.regexp_extract("_s", r"^[^=]*=(.*)$", 1))
    value = F.when(value.rlike(r"""^(?:'.*'|".*")$""") & (F.length(value) >= 2), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    found = found.withColumn("name", F.trim(F.regexp_extract("_s", r"^([^=]*)=", 1))).withColumn("value", value)
    return found.groupBy(*keys, "name").agg(F.max_by("value", order).alias("value"))


def write_draft(files: DataFrame, path: str) -> None:
    """A draft's files, one folder each: (file_name, content)."""
    files.select(F.col("content").alias("value"), "file_name").write.mode("overwrite").partitionBy("file_name").text(path)
