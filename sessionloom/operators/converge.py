"""Convergence of candidates from several machines.

Candidates are few (clusters x machines), so the order-dependent greedy fold runs on one
sorted array inside the JVM; what comes before and after it is ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLD = 0.4


def signature(label: Column, pattern: Column) -> Column:
    """Label words as l:word and the dominant pattern as p:pattern, distinct, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    own = F.when(F.coalesce(pattern, F.lit("")) != "", F.array(F.concat(F.lit("p:"), F.lower(pattern)))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.transform(words, lambda w: F.concat(F.lit("l:"), w)), own)


def similar_pairs(candidates: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Pairs of candidates of different machines whose signatures are alike, found through a shared token."""
    x = candidates.select("machine_id", "cluster_id", signature(F.col("label"), F.col("dominant_pattern")).alias("sig")).where("size(sig) > 0")
    tokens = x.select("machine_id", "cluster_id", "sig", F.explode("sig").alias("token"))
    a, b = (tokens.select("token", F.col("machine_id").alias(f"machine_{k}"), F.col("cluster_id").alias(f"cluster_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    both = a.join(b, "token").where("machine_a < machine_b").drop("token").distinct()
    both = both.withColumn("similarity", F.round(T.jaccard(F.col("sig_a"), F.col("sig_b")), 4))
    return both.where(F.col("similarity") >= least).drop("sig_a", "sig_b")


def converge(candidates: DataFrame) -> DataFrame:
    """Greedy merge in (machine, label, cluster) order: the most similar earlier seed, the first on ties, else a new one.

    candidates: machine_id, cluster_id, label, dominant_pattern, frequency, intervention.
    """
    sig = signature(F.col("label"), F.col("dominant_pattern"))
    item = F.struct("machine_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("cluster_id", F.lit("")).alias("cluster_id"), sig.alias("sig"), "frequency", "intervention")
    listed = candidates.agg(F.array_sort(F.collect_list(item)).alias("items"), F.count_distinct("machine_id").alias("n_all"))

    def fold(acc: Column, it: Column) -> Column:
        sims = F.transform(acc["seeds"], lambda s: T.jaccard(it["sig"], s))
        best = F.coalesce(F.array_max(sims), F.lit(0.0))
        joins = (best > 0) & (best >= THRESHOLD)
        at = F.when(joins, F.array_position(sims, best).cast("int") - 1).otherwise(F.size(acc["seeds"]))
        seeds = F.when(joins, acc["seeds"]).otherwise(F.array_append(acc["seeds"], it["sig"]))
        return F.struct(seeds.alias("seeds"), F.array_append(acc["at"], at).alias("at"))

    start = F.struct(F.array().cast("array<array<string>>").alias("seeds"), F.array().cast("array<int>").alias("at"))
    placed = listed.select("n_all", F.posexplode(F.arrays_zip("items", F.aggregate("items", start, fold)["at"].alias("at"))).alias("pos", "z"))
    rows = placed.select("n_all", "pos", F.col("z.at").alias("grp"), "z.items.*")
    votes = rows.where("intervention <> 'none'").groupBy("grp", "intervention").agg(F.count(F.lit(1)).alias("v"), F.min("pos").alias("p"))
    votes = votes.groupBy("grp").agg(F.max_by("intervention", F.struct(F.col("v"), -F.col("p"))).alias("recommended"))
    each = rows.groupBy("grp", "machine_id").agg(F.sum("frequency").alias("n"), F.min("pos").alias("p"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("p", "machine_id", "n"))), lambda m: F.concat_ws(":", m["machine_id"], m["n"].cast("string")))
    each = each.groupBy("grp").agg(F.array_join(named, ", ").alias("per_machine"))
    out = rows.groupBy("grp").agg(
        F.min_by("label", "pos").alias("label"),
        F.array_join(F.array_sort(F.collect_set("machine_id")), ",").alias("machines"),
        F.count_distinct("machine_id").alias("n_machines"),
        F.sum("frequency").alias("total_frequency"),
        F.max("n_all").alias("n_all"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "machine_id", "cluster_id"))), lambda m: F.concat_ws(":", m["machine_id"], m["cluster_id"])), ",").alias("clusters"),
    )
    return out.join(each, "grp").join(votes, "grp", "left").select(
        T.hash31(F.concat_ws("|", F.lit("conv"), F.lower("label"), "machines")).alias("converged_id"),
        "label", "machines", "n_machines", "total_frequency", "per_machine", "clusters",
        F.coalesce("recommended", F.lit("none")).alias("intervention"),
        F.round(F.col("n_machines") / F.greatest("n_all", F.lit(1)), 3).alias("agreement"),
        (F.col("n_machines") >= 2).alias("cross_validated"),
    )


def report_lines(converged: DataFrame) -> DataFrame:
    """(place, line) of the convergence report: cross-validated workflows first, then by frequency, then by label."""
    order = F.struct((~F.col("cross_validated")).alias("x"), (-F.col("total_frequency")).alias("f"), F.col("label"), F.col("clusters"), F.col("n_machines"), F.col("per_machine"), F.col("intervention"))
    mark = lambda r: F.when(~r["x"], F.lit("✅")).otherwise(F.lit("—"))

    def line(r: Column, i: Column) -> Column:
        cells = [(i + 1).cast("string"), r["label"], r["n_machines"].cast("string"), mark(r), (-r["f"]).cast("string"), r["per_machine"], r["intervention"]]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    head = F.concat(F.lit("- Converged workflows: **"), F.count(F.lit(1)).cast("string"), F.lit("** · cross-validated (≥2 machines): **"), F.count_if("cross_validated").cast("string"), F.lit("**"))
    doc = converged.agg(head.alias("head"), F.transform(F.array_sort(F.collect_list(order)), line).alias("rows"))  # workflows are few
    fixed = ["# Cross-machine convergence", "", None, "", "| # | Workflow | #Machines | Cross-validated | Total freq | Per-machine | Rec |", "|---|---|---|---|---|---|---|"]
    first = F.array(*[F.col("head") if x is None else F.lit(x) for x in fixed])
    last = F.array(F.lit(""), F.lit("> Cross-validated workflows are the highest-confidence candidates for the org-wide meta phase."))
    return doc.select(F.posexplode(F.concat(first, F.coalesce("rows", F.array().cast("array<string>")), last)).alias("place", "line"))


def write_report(converged: DataFrame, path: str) -> None:
    """The report as Markdown and all converged workflows as one JSON document, below path."""
    lines = report_lines(converged)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    lines.agg(body.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/convergence.md")
    listed = converged.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*converged.columns))).alias("converged"))).alias("value"))
    listed.coalesce(1).write.mode("overwrite").text(f"{path}/convergence.json")
