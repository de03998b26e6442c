"""Clusters of labelled episodes: components, patterns, interventions, risks, contrast, exemplars, totals.

Labelled episodes carry: episode_id, session_id, ord (their order where ties are broken by
first seen), task_type, outcome, signature, n_corrections, n_interruptions, duration_s,
n_files_read, n_files_edited, first_prompt, tool_sequence, worth_codifying, skill_type,
efficiency, quality. Each result is one aggregation by cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_PATTERN_N, MIN_CONFIDENT_N, MIN_CODIFY_VOTES, MIN_JUDGED, MIN_RATE = 3, 5, 2, 3, 0.34
JUDGED = ["success", "partial", "failed", "abandoned"]
#: Risk patterns and their labels.
DESTRUCTIVE = [
    (r"(?i)rm\s+-rf|rm\s+-fr|rm\s+-[a-z]*r[a-z]*f", "rm -rf"),
    (rf"(?i)push\s+--force|force[- ]push|push\s+-f{T.B}|--force-with-lease", "force-push"),
    (rf"(?i){T.B}drop\s+(?:table|database|schema|index|column){T.B}", "DROP (SQL)"),
    (rf"(?i){T.B}deploy(?:ment|ing|ed)?{T.B}|{T.B}git\s+push\s+.*prod|{T.B}vercel\s+--prod|{T.B}kubectl\s+apply", "deploy"),
    (rf"(?i){T.B}truncate\s+table{T.B}", "TRUNCATE (SQL)"),
]
SENSITIVE = [
    (rf"(?i){T.B}(?:api[_-]?key|secret[_-]?key|access[_-]?token|private[_-]?key){T.B}", "secrets/credentials"),
    (rf"(?i){T.B}sk-[a-z0-9]{{16,}}{T.B}", "secret-like token"),
    (r"AKIA[0-9A-Z]{12,}", "AWS access key"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key material"),
    (rf"{T.B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{T.B}", "PII (SSN-like)"),
]
#: What a text must hold for any of these to match.
SOME = r"(?i)rm\s|push|force|drop|deploy|vercel|kubectl|truncate|key|token|sk-|AKIA|[0-9]-[0-9]"


def clustered(episodes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Judged episodes with cluster label and cluster_id; groups (task_type, grouped) may rename labels, else they stay."""
    known = episodes.where(F.col("task_type").isNotNull()).withColumn("label", T.normalize_task_type(F.col("task_type")))
    if groups is not None:
        known = known.join(groups.select(F.col("task_type").alias("label"), "grouped"), "label", "left").withColumn("label", F.coalesce("grouped", "label")).drop("grouped")
    return known.withColumn("cluster_id", T.slugify(F.col("label")))


def judged() -> Column:
    return F.col("outcome").isin(JUDGED)


def _rate() -> Column:
    return F.when(F.col("n_judged") > 0, F.col("n_success") / F.col("n_judged")).otherwise(0.0)


def medians(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, a column for each of values): exact medians over the rows that have a value; null where none has.

    Distinct values are counted before they are ranked, and the running count spills, so no
    task holds the values of a large cluster in memory.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]))
    each = rows.select(key, named.alias("x")).where("x.value is not null").groupBy(key, "x.name", "x.value").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(key, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    totals = each.groupBy(key, "name").agg(F.sum("n").alias("total"))
    x = each.withColumn("upto", F.sum("n").over(own)).join(totals, [key, "name"])
    low, high = (F.min(F.when(test, F.col("value"))) for test in (2 * F.col("upto") >= F.col("total"), 2 * F.col("upto") > F.col("total")))
    x = x.groupBy(key, "name").agg(((low + high) / 2).alias("median"))
    return x.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in values])


def components(rows: DataFrame) -> DataFrame:
    """Frequency, success rates, friction and effort of each cluster."""
    friction = F.col("n_corrections") + F.col("n_interruptions")
    out = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.count_if(judged()).alias("n_judged"),
        F.count_if(F.col("outcome") == "success").alias("n_success"),
    )
    out = out.join(medians(rows, "cluster_id", {"_friction": friction, "_duration": F.col("duration_s")}), "cluster_id", "left")
    out = out.withColumns({"median_friction": F.coalesce("_friction", F.lit(0.0)), "_duration": F.coalesce("_duration", F.lit(0.0))})
    return out.select(
        "cluster_id", "frequency", "n_sessions", "n_judged",
        F.round(_rate(), 4).alias("success_rate"),
        F.round((F.col("n_success") + 1) / (F.col("n_judged") + 2), 4).alias("laplace_rate"),
        (F.col("n_judged") < MIN_CONFIDENT_N).alias("low_confidence"),
        "median_friction",
        F.round(F.col("_duration") * F.col("frequency")).cast("bigint").alias("est_effort_s"),
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """Most frequent first, then by success rate; of equals the smaller cluster_id."""
    return candidates.orderBy(F.desc("frequency"), F.desc("success_rate"), "cluster_id")


def dominant_pattern(rows: DataFrame) -> DataFrame:
    """The most frequent non-empty signature of a cluster's successes (ties: first seen) and whether it is stable."""
    some = rows.where((F.col("outcome") == "success") & (F.col("signature") != ""))
    each = some.groupBy("cluster_id", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = F.max_by("signature", F.struct(F.col("n"), -F.col("first")))
    out = each.groupBy("cluster_id").agg(best.alias("dominant_pattern"), F.max("n").alias("pattern_n"), F.sum("n").alias("n_patterns"))
    stable = (F.col("n_patterns") >= MIN_PATTERN_N) & (F.col("pattern_n") / F.col("n_patterns") >= 0.5)
    return out.select("cluster_id", "dominant_pattern", "pattern_n", "n_patterns", stable.alias("stable"))


def intervention(rows: DataFrame) -> DataFrame:
    """Recommended intervention: none for thin or failing clusters or under two votes, else the plurality, first seen on ties."""
    vote = F.col("worth_codifying") & F.col("skill_type").isin("skill", "script", "sop")
    by = rows.groupBy("cluster_id", F.when(vote, F.col("skill_type")).alias("vote")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.count_if(judged()).alias("j"), F.count_if(F.col("outcome") == "success").alias("s")
    )
    concrete = F.col("vote").isNotNull()
    out = by.groupBy("cluster_id").agg(
        F.sum("j").alias("n_judged"),
        F.sum("s").alias("n_success"),
        F.coalesce(F.sum(F.when(concrete, F.col("n"))), F.lit(0)).cast("bigint").alias("votes"),
        F.max_by("vote", F.when(concrete, F.struct(F.col("n"), -F.col("first")))).alias("best"),
    )
    thin = (F.col("n_judged") < MIN_JUDGED) | (_rate() < MIN_RATE) | (F.col("votes") < MIN_CODIFY_VOTES)
    return out.select("cluster_id", "votes", F.when(thin, "none").otherwise(F.col("best")).alias("intervention"))


def _flags(blob: Column) -> list[tuple[str, Column]]:
    named = [(p, f"destructive: {n}") for p, n in DESTRUCTIVE] + [(p, f"sensitive: {n}") for p, n in SENSITIVE]
    return [(n, blob.rlike(p)) for p, n in named]


#: Places of a cluster's texts that are looked at together; a cluster is never in one place as a whole.
RUN = 4096


def risk_flags(rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Ordered risk labels of each cluster, from its prompts, tool sequences and evidence texts in order, and its edit share.

    rows: cluster_id, ord, first_prompt, tool_sequence, n_files_edited, n_files_read; evidence:
    cluster_id, ord, text, behind the rows. All texts of a cluster, joined by line feeds, are one
    text to the patterns. These run over a line's end only where they allow white space, twice
    at most, so a text is read with the two behind it that are not blank: first within runs of
    RUN places (ord is a running number), then over the ends of runs, of which a cluster has few.
    """
    part = F.concat_ws("\n", F.nullif("first_prompt", F.lit("")), F.nullif("tool_sequence", F.lit("")))
    texts = rows.select("cluster_id", F.lit(0).alias("_kind"), "ord", part.alias("_part"))
    if evidence is not None:
        texts = texts.unionByName(evidence.select("cluster_id", F.lit(1).alias("_kind"), "ord", F.col("text").alias("_part")))
    texts = texts.where(F.col("_part").rlike(r"\S")).withColumn("_run", F.floor(F.col("ord") / RUN))
    run = ["cluster_id", "_kind", "_run"]
    up = Window.partitionBy(*run).orderBy("ord")
    texts = texts.withColumns({"_next1": F.lead("_part", 1).over(up), "_next2": F.lead("_part", 2).over(up), "_first": F.row_number().over(up)})
    texts = texts.withColumn("_last", F.when(F.col("_next1").isNull(), 1).when(F.col("_next2").isNull(), 2)).withColumn("_near", F.concat_ws("\n", "_part", "_next1", "_next2"))
    texts = texts.withColumn("_some", F.col("_near").rlike(SOME))
    names = _flags(F.col("_near"))
    marks = [F.coalesce(F.bool_or(F.when(F.col("_some"), c)), F.lit(False)).alias(f"_f{i}") for i, (_, c) in enumerate(names)]
    ends = [F.max(F.when(F.col(place) == k, F.col("_part"))).alias(f"{place}{k}") for place in ("_first", "_last") for k in (1, 2)]
    runs = texts.groupBy(*run).agg(*marks, *ends)
    order = Window.partitionBy("cluster_id").orderBy("_kind", "_run")
    heads = [F.lead(f"_first{k}", n).over(order) for n in (1, 2) for k in (1, 2)]
    runs = runs.withColumn("_near", F.concat_ws("\n", "_last2", "_last1", *heads))
    found = runs.groupBy("cluster_id").agg(*[F.bool_or(F.col(f"_f{i}") | c).alias(f"_f{i}") for i, (_, c) in enumerate(names)])
    out = rows.groupBy("cluster_id").agg(F.sum("n_files_edited").alias("edited"), F.sum("n_files_read").alias("read")).join(found, "cluster_id", "left")
    heavy = F.when((F.col("edited") >= 5) & (F.col("edited") > 2 * F.coalesce("read", F.lit(0))), "write-heavy (edits >> reads)")
    return out.select("cluster_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_f{i}"), F.lit(n)) for i, (n, _) in enumerate(names)], heavy)), "; ").alias("risk_flags"))


def panel_medians(rows: DataFrame) -> DataFrame:
    """Median axes over the episodes that have them (null if none has), and how many have either."""
    either = F.col("efficiency").isNotNull() | F.col("quality").isNotNull()
    counts = rows.groupBy("cluster_id").agg(F.count_if(either).alias("n_panel"))
    axes = medians(rows, "cluster_id", {"median_efficiency": F.col("efficiency"), "median_quality": F.col("quality")})
    return counts.join(axes, "cluster_id", "left").select("cluster_id", "median_efficiency", "median_quality", "n_panel")


def contrast(rows: DataFrame, most: int | None = None) -> DataFrame:
    """How often each signature stands behind success and behind failure in a cluster; the most frequent of either first."""
    side = F.when(F.col("outcome") == "success", "success").when(F.col("outcome").isin("failed", "abandoned", "partial"), "fail")
    counts = rows.withColumn("side", side).where("side is not null and signature <> ''").groupBy("cluster_id", "side", "signature").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster_id", "side").orderBy(F.desc("n"), "signature")).cast("bigint")
    counts = counts.withColumn("place", place)
    return counts.where(F.col("place") <= most) if most else counts


def exemplars(rows: DataFrame) -> DataFrame:
    """The success of least friction, and of the others the worst: failed or abandoned, then partial, then any friction."""
    friction = F.col("n_corrections") + F.col("n_interruptions")
    good = rows.where("outcome = 'success'").groupBy("cluster_id").agg(F.min_by("episode_id", F.struct(friction, "ord")).alias("good"))
    x = rows.join(F.broadcast(good), "cluster_id", "left").where(~F.col("episode_id").eqNullSafe(F.col("good")))
    tier = F.when(F.col("outcome").isin("failed", "abandoned"), 0).when(F.col("outcome") == "partial", 1).when(friction > 0, 2)
    bad = x.withColumn("tier", tier).where("tier is not null").groupBy("cluster_id").agg(F.min_by("episode_id", F.struct("tier", -friction, "ord")).alias("bad"))
    return rows.select("cluster_id").distinct().join(good, "cluster_id", "left").join(bad, "cluster_id", "left")


def thin_split(candidates: DataFrame) -> DataFrame:
    """Flag candidates of under three episodes or under three judged ones."""
    return candidates.withColumn("thin", (F.col("frequency") < 3) | (F.col("n_judged") < MIN_JUDGED))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("session_id").alias("n_sessions"),
        F.count(F.lit(1)).alias("n_episodes"),
        F.count_if(F.col("task_type").isNotNull()).alias("n_labeled"),
        F.count_if(judged()).alias("n_judged"),
        F.count_if(F.col("outcome") == "success").alias("n_success"),
    ).withColumn("success_rate", F.round(_rate(), 4))


def tally(items: DataFrame, keys: list[str], most: int = 12, examples: int = 3) -> DataFrame:
    """Items counted without regard to case, first casing kept, up to three distinct examples, the top twelve a key.

    items: keys, text, example, ord.
    """
    items = items.withColumn("item", F.lower("text"))
    by = items.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "ord").alias("text"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "item"))
    top = by.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)
    # Examples of the top items only: the first of each, then the first few - both prune before the exchange.
    own = items.join(top.select(*keys, "item"), [*keys, "item"], "left_semi").groupBy(*keys, "item", "example").agg(F.min("ord").alias("ord"))
    nth = F.row_number().over(Window.partitionBy(*keys, "item").orderBy("ord"))
    own = own.withColumn("_nth", nth).where(F.col("_nth") <= examples)
    listed = own.groupBy(*keys, "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "example"))), lambda s: s["example"]), "|").alias("examples"))
    return top.join(listed, [*keys, "item"], "left")
