"""The report: a Markdown section for each cluster, what it rests on, and the clusters with too little evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from .authoring import clean
from .mine import components, contrast, dominant_pattern, exemplars, intervention, panel_medians, risk_flags, thin_split, totals
from .store import once

TOP = 3
PROMPT_CHARS = 120


def percent(x: Column) -> Column:
    return F.concat(F.round(100 * x).cast("bigint").cast("string"), F.lit("%"))


def number(x: Column) -> Column:
    """A number without a needless fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _top(counted: DataFrame, text: str, mark: str) -> DataFrame:
    """(cluster_id, side, listed): the TOP most frequent texts of each side, with their counts."""
    place = F.row_number().over(Window.partitionBy("cluster_id", "side").orderBy(F.desc("n"), text))
    best = counted.withColumn("_p", place).where(F.col("_p") <= TOP)
    shown = F.concat(F.lit(mark), F.col(text), F.lit(f"{mark} (×"), F.col("n").cast("string"), F.lit(")"))
    return best.groupBy("cluster_id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", shown.alias("t")))), lambda x: x["t"]), ", " if mark else "; ").alias("listed"))


def _cited(rows: DataFrame, picks: DataFrame, side: str) -> DataFrame:
    """(cluster_id, side): how an exemplar is cited; its prompt is cleaned."""
    x = picks.select("cluster_id", F.col(side).alias("episode_id"))
    x = rows.select("episode_id", "first_prompt", "outcome", "n_corrections", "n_interruptions").join(F.broadcast(x), "episode_id")
    friction = (F.col("n_corrections") + F.col("n_interruptions")).cast("string")
    text = F.concat(F.lit("`"), F.col("episode_id").cast("string"), F.lit("` : "), clean(one_line(F.coalesce("first_prompt", F.lit("")), PROMPT_CHARS)), F.lit(" _(outcome: "), F.coalesce("outcome", F.lit("unjudged")), F.lit(", friction: "), friction, F.lit(")_"))
    return x.select("cluster_id", text.alias(side))


def sections(rows: DataFrame, friction: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(cluster_id, thin, frequency, success_rate, section) of every cluster of labelled episodes.

    rows are read some twenty times, few columns each time: keep them first (store.kept).
    friction: cluster_id, what, n. notes: cluster_id, note - business notes, joined last.
    """
    x = components(rows).join(dominant_pattern(rows), "cluster_id", "left").join(intervention(rows), "cluster_id").join(risk_flags(rows), "cluster_id").join(panel_medians(rows), "cluster_id")
    x = thin_split(x.join(rows.groupBy("cluster_id").agg(F.min("label").alias("label")), "cluster_id"))
    sides = _top(contrast(rows).drop("place"), "signature", "`")
    for side in ("success", "fail"):
        x = x.join(sides.where(F.col("side") == side).select("cluster_id", F.col("listed").alias(f"_{side}")), "cluster_id", "left")
    x = x.join(_top(friction.withColumn("side", F.lit("")), "what", "").select("cluster_id", F.col("listed").alias("_friction")), "cluster_id", "left")
    picks = once(exemplars(rows))
    for side in ("good", "bad"):
        x = x.join(_cited(rows, picks, side), "cluster_id", "left")
    x = x.join(notes.select("cluster_id", "note"), "cluster_id", "left") if notes is not None else x.withColumn("note", F.lit(None).cast("string"))
    or_none = lambda c, none="_none_": F.coalesce(F.col(c), F.lit(none))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    panel = F.col("median_efficiency").isNotNull() | F.col("median_quality").isNotNull()
    axis = lambda c: F.coalesce(number(F.col(c)), F.lit("—"))
    full = F.concat_ws(
        "\n", say("### ", F.col("label")), F.lit(""),
        say("- Frequency: **", F.col("frequency").cast("string"), "** episodes across **", F.col("n_sessions").cast("string"), "** session(s)"), say("- Success rate: **", percent(F.col("success_rate")), "**"),
        say("- Median friction (corrections + interruptions): **", number(F.col("median_friction")), "**"),
        F.when(panel, say("- Median efficiency / quality (1–5, panel over ", F.col("n_panel").cast("string"), " ep): **", axis("median_efficiency"), "** / **", axis("median_quality"), "**")),
        say("- Stable success pattern: **", F.when(F.col("stable"), "yes").otherwise("no"), "**", F.coalesce(say(" — dominant: `", F.col("dominant_pattern"), "`"), F.lit(""))), say("- Recommended intervention: **", F.col("intervention"), "**"),
        F.when(F.col("risk_flags") != "", say("- Risk flags: `", F.replace("risk_flags", F.lit("; "), F.lit("`, `")), "`")), say("- Est. effort (median duration × frequency): ~", F.col("est_effort_s").cast("string"), "s"), F.lit(""),
        F.lit("**Good vs bad workflow contrast**\n"), say("- Works (success patterns): ", or_none("_success")), say("- Flails (fail/partial patterns): ", or_none("_fail")), F.lit(""),
        say("**Recurring friction:** ", or_none("_friction", "_none recorded_")), F.lit("\n**Exemplars**\n"), say("- Good: ", or_none("good", "_none available_")), say("- Bad: ", or_none("bad", "_none available_")),
        F.when(F.coalesce("note", F.lit("")) != "", say("\n**Business note (sidecar, join-late):** ", F.col("note"))), F.lit(""),
    )
    brief = F.concat_ws(
        "\n", say("- **", F.col("label"), "** — ", F.col("frequency").cast("string"), " ep / ", F.col("n_sessions").cast("string"), " sess, success ", percent(F.col("success_rate")), ", friction ", number(F.col("median_friction")), ", rec: ", F.col("intervention")),
        say("  - good exemplar: ", F.col("good")), say("  - bad exemplar: ", F.col("bad")),
    )
    return x.select("cluster_id", "thin", "frequency", "success_rate", F.when(F.col("thin"), brief).otherwise(full).alias("section"))


def document(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """One row `text`: the report of the sections found, the most frequent clusters first. Clusters are few."""
    order = F.struct((-F.col("frequency")).alias("f"), (-F.col("success_rate")).alias("r"), "cluster_id", "section")
    parts = found.agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("thin") == thin, order))), lambda s: s["section"]), "\n").alias(n) for n, thin in (("some", False), ("few", True))], F.count(F.lit(1)).cast("string").alias("k"))
    t = totals(episodes).join(parts)
    lines = [
        F.lit("# Workflow report\n\n## Corpus\n"), F.concat(F.lit("- Sessions: **"), "n_sessions", F.lit("**")), F.concat(F.lit("- Episodes: **"), "n_episodes", F.lit("**")), F.concat(F.lit("- Judged episodes (success/partial/failed/abandoned): **"), "n_judged", F.lit("**")),
        F.concat(F.lit("- Overall success rate: **"), percent(F.col("success_rate")), F.lit("** (of judged)")), F.concat(F.lit("- Task clusters: **"), "k", F.lit("**")),
        F.lit("\n> Exemplars, not statistics: clusters are often thin and outcomes are judged by a model. Read them as leads.\n\n## Task clusters (sufficient evidence)\n"), F.when(F.col("some") != "", F.col("some")).otherwise(F.lit("_None._\n")),
        F.lit("## Insufficient evidence\n"), F.when(F.col("few") != "", F.col("few")).otherwise(F.lit("_None._")), F.lit(""),
    ]
    return t.select(F.concat_ws("\n", *lines).alias("text"))


def write(doc: DataFrame, path: str) -> None:
    doc.select(F.col("text").alias("value")).coalesce(1).write.mode("overwrite").text(path)
