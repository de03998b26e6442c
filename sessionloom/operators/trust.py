"""Trust in the results: invariant checks, calibration strata and agreement, cross-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import OUTCOMES


def invariant(name: str, bad: DataFrame) -> DataFrame:
    """One row: the name of an invariant and how many rows break it."""
    return bad.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))


def invariants(sessions: DataFrame, turns: DataFrame, episodes: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """The nine checks of the stored tables; each n is 0 in a sound store."""
    counts = episodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    known = episodes.select(F.col("episode_id").alias("_e")).distinct()
    checks = {
        "zero_turn_episodes": episodes.where("n_turns = 0"),
        "empty_first_prompt": episodes.where("coalesce(first_prompt, '') = ''"),
        "empty_content_hash": episodes.where("coalesce(content_hash, '') = ''"),
        "episodes_missing_features": episodes.join(features.select("episode_id").distinct(), "episode_id", "left_anti"),
        "orphan_turns": turns.where("episode_id is not null").join(known, F.col("episode_id") == F.col("_e"), "left_anti"),
        "orphan_episodes": episodes.where("session_id is not null").join(sessions.select("session_id").distinct(), "session_id", "left_anti"),
        "n_episodes_mismatch": sessions.join(counts, "session_id", "left").where("n_episodes <> coalesce(_n, 0)"),
        "negative_durations": features.where("duration_s < 0 or idle_s < 0"),
        "orphan_labels": labels.where("episode_id is not null").join(known, F.col("episode_id") == F.col("_e"), "left_anti"),
    }
    return reduce(DataFrame.unionByName, [invariant(k, v) for k, v in checks.items()])


def drift(value: Column, baseline: float) -> Column:
    """Percent off the baseline, one decimal."""
    return F.round(100 * (value - baseline) / baseline, 1)


def strata(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each stratum that an episode is in; all flags are read in one pass."""
    named = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("k"), F.lit(n).alias("stratum"))) for i, (n, c) in enumerate(flags.items())]))
    return rows.select("*", F.explode(named).alias("_s")).select(*rows.columns, F.col("_s.k").alias("stratum_k"), F.col("_s.stratum").alias("stratum"))


def stratified_draw(members: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n episodes (episode_id, stratum) in turn from the strata without repeats; within a stratum in the order of a hash of id and seed.

    Each turn of a stratum takes its first member that no turn before has taken; strata that have
    run out are passed over. A cursor only ever passes taken members, so the first n of each
    stratum are all that n turns can reach, and the turns fold over n x strata ids at most.
    """
    key = F.md5(F.concat_ws(":", F.col("episode_id").cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("stratum_k").orderBy("_h", "episode_id")
    top = members.withColumn("_h", key).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    lists = top.groupBy("stratum_k", "stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "episode_id"))), lambda x: x["episode_id"]).alias("ids"))
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("stratum_k", "stratum", "ids"))).alias("lists"))
    kind = members.schema["episode_id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast("array<string>").alias("by"))

    def turn(acc: Column, i: Column) -> Column:
        own = F.get("lists", i % F.size("lists"))
        pick = F.get(F.array_except(own["ids"], acc["taken"]), F.lit(0))
        more = pick.isNotNull() & (F.size(acc["taken"]) < n)
        return F.when(more, F.struct(F.array_append(acc["taken"], pick).alias("taken"), F.array_append(acc["by"], own["stratum"]).alias("by"))).otherwise(acc)

    drawn = F.aggregate(F.sequence(F.lit(0), F.size("lists") * n - 1), start, turn)
    rows = lists.where(F.size("lists") > 0).select(drawn.alias("d")).select(F.explode(F.arrays_zip(F.col("d.taken").alias("episode_id"), F.col("d.by").alias("stratum"))).alias("x"))
    return rows.select("x.episode_id", "x.stratum")


def sampled(rows: DataFrame) -> DataFrame:
    """Drawn episodes as a reviewer gets them: an outcome that is none, a confidence that is no number and list items of another kind go.

    rows: episode_id, stratum, label (JSON text), first_prompt.
    """
    v = F.try_parse_json("label")
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("missing"))
    outcome = F.try_variant_get(v, "$.outcome", "string")
    steps = F.filter(F.try_variant_get(v, "$.workflow_pattern", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    points = F.when(kind("$.friction_points").startswith("ARRAY"), F.from_json(F.get_json_object("label", "$.friction_points"), "array<struct<what:string,evidence:string>>"))
    return rows.select(
        "episode_id", "stratum", F.when(outcome.isin(OUTCOMES), outcome).alias("outcome"),
        F.when(kind("$.outcome_confidence").rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.outcome_confidence", "double")).alias("confidence"),
        F.coalesce("first_prompt", F.lit("")).alias("first_prompt"),
        F.coalesce(F.transform(steps, lambda x: x.cast("string")), F.array().cast("array<string>")).alias("steps"),
        F.coalesce(points, F.array().cast("array<struct<what:string,evidence:string>>")).alias("friction"),
        F.coalesce(F.when(kind("$.root_cause") == "STRING", F.try_variant_get(v, "$.root_cause", "string")), F.lit("")).alias("root_cause"),
    )


def representatives(episodes: DataFrame, n: int = 3) -> DataFrame:
    """n episodes that show the shapes there are, in order: the longest, the first elided, the first with subagents, the first with a correction, then by turns.

    episodes: episode_id, ord, n_turns, elided, subagents, n_corrections. One episode can stand for several shapes.
    """
    order = F.struct(-F.col("n_turns"), F.col("ord"))
    shapes = [F.min_by("episode_id", order)] + [F.min_by("episode_id", F.when(test, F.col("ord"))) for test in (F.col("elided"), F.col("subagents"), F.col("n_corrections") > 0)]
    firsts = episodes.agg(F.array_distinct(F.array_compact(F.array(*shapes))).alias("ids")).select(F.posexplode("ids").alias("place", "episode_id"))
    # The n + 4 longest fill up whatever the shapes leave.
    longest = episodes.orderBy(F.desc("n_turns"), "ord").limit(n + len(shapes)).select("episode_id", order.alias("_o"))
    rest = longest.join(firsts, "episode_id", "left_anti")
    every = firsts.select("episode_id", F.col("place").cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_b"), F.lit(0).cast("bigint").alias("_c"))
    every = every.unionByName(rest.select("episode_id", F.lit(len(shapes)).cast("bigint").alias("_a"), F.col("_o.col1").cast("bigint").alias("_b"), F.col("_o.ord").cast("bigint").alias("_c")))
    place = (F.row_number().over(Window.orderBy("_a", "_b", "_c")) - 1).cast("bigint")  # n + 8 rows at most
    return every.select("episode_id", place.alias("place")).where(F.col("place") < n)


def selected(episodes: DataFrame, episode_id: str | None = None, session: str | None = None, draw: int = 0, seed: int = 0) -> DataFrame:
    """Episodes by their id, by session or prefix of it, or `draw` of them in an order by hash of id and seed; by turns if nothing is asked for."""
    if episode_id:
        return episodes.where(F.col("episode_id") == episode_id)
    if session:
        return episodes.where(F.col("session_id").startswith(session))
    if draw:
        return episodes.orderBy(F.md5(F.concat_ws(":", F.col("episode_id").cast("string"), F.lit(str(seed)))), "episode_id").limit(draw)
    return episodes.orderBy(F.desc("n_turns"), "episode_id")


def agreement(rows: DataFrame) -> DataFrame:
    """Checked, agreeing and still open calibration rows of each stratum, and of all (stratum `ALL`)."""
    by = rows.rollup("stratum").agg(F.grouping("stratum").alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("agrees")).alias("n_agree"), F.count_if(F.col("agrees").isNull()).alias("n_open"))
    checked = F.col("n") - F.col("n_open")
    return by.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("stratum")).alias("stratum"), "n", "n_agree", "n_open", F.round(F.when(checked > 0, F.col("n_agree") / checked), 4).alias("rate"))


def confusion(calibration: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each judged outcome was given each human outcome."""
    both = calibration.where("human_outcome is not null").join(labels.select("episode_id", "outcome"), "episode_id")
    return both.groupBy("outcome", "human_outcome").agg(F.count(F.lit(1)).alias("n"))


def human_outcome(typed: Column, agrees: Column, judged: Column) -> Column:
    """A typed outcome stands; a blank with agreement is the judge's; a blank with disagreement is unknown."""
    blank = F.coalesce(F.trim(typed), F.lit("")) == ""
    return F.when(~blank, F.trim(typed)).when(agrees, judged)


def cross_check(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Labels that the evidence contradicts, with the signals that do so joined by +."""
    names = ["explicit_user_rejection", "abandoned_mid_edit", "created_pr", "explicit_user_approval"]
    seen = evidence.where(F.col("signal").isin(names)).groupBy("episode_id").agg(*[F.bool_or(F.col("signal") == n).alias(n) for n in names])
    x = labels.join(seen, "episode_id")
    against = F.array_compact(
        F.array(
            *[F.when((F.col("outcome") == "success") & F.col(n), n) for n in names[:2]],
            *[F.when((F.col("outcome") == "failed") & F.col(n), n) for n in names[2:]],
        )
    )
    return x.withColumn("reason", F.array_join(against, "+")).where("reason <> ''").select("episode_id", "outcome", "reason")


def self_consistency(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Of re-judged episodes without an error, how many kept their outcome."""
    both = stored.select("episode_id", "outcome").join(again.select("episode_id", F.col("outcome").alias("_again"), "error"), "episode_id")
    good = F.col("error").isNull()
    return both.agg(F.count_if(good).alias("n_checked"), F.count_if(good & (F.col("outcome") == F.col("_again"))).alias("n_matched"), F.count_if(~good).alias("n_errors"))


def reconstructed(episodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(episode_id, compact): an episode's view rebuilt from stored columns, its evidence ordered by signal.

    episodes: episode_id, first_prompt, workflow (steps joined by >) and friction (array of texts).
    """
    line = F.concat("signal", F.lit(" ("), "direction", "weight", F.lit("): "), F.coalesce("value", F.lit("null")), F.lit(" — "), "reason")
    listed = evidence.withColumn("_line", line).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("signal", "_line"))).alias("_e"))
    x = episodes.join(listed, "episode_id", "left")
    phases = F.when(F.coalesce("workflow", F.lit("")) != "", F.concat(F.lit("OBSERVED WORKFLOW PHASES: "), F.replace("workflow", F.lit(">"), F.lit(" > "))))
    friction = F.when(F.size("friction") > 0, F.concat(F.lit("FRICTION OBSERVED:\n"), F.array_join(F.transform("friction", lambda f: F.concat(F.lit("  - "), f)), "\n")))
    signals = F.coalesce(F.array_join(F.transform("_e", lambda e: e["_line"]), "\n"), F.lit("(none)"))
    note = F.lit("\n(NOTE: compact reconstruction from stored columns — the full transcript was not persisted.)")
    return x.select("episode_id", F.concat_ws("\n", F.concat(F.lit("USER: "), F.coalesce("first_prompt", F.lit(""))), note, phases, friction, F.lit("\n--- EVIDENCE SIGNALS ---"), signals).alias("compact"))


def write_audit(counters: DataFrame, path: str) -> None:
    """A run's counters as one JSON document."""
    counters.select(F.to_json(F.struct(*counters.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def run_counters(calls: DataFrame) -> DataFrame:
    """One row of what a run did: all, labelled, skipped by the cache, failed, and dollars spent. calls: cached, ran, failed, cost."""
    ran = F.col("ran")
    return calls.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ran & ~F.col("failed")).alias("n_judged"), F.count_if("cached").alias("n_skipped"),
        F.count_if(ran & F.col("failed")).alias("n_errors"), F.round(F.coalesce(F.sum(F.when(ran, F.col("cost"))), F.lit(0.0)), 2).alias("spent"),
    )
