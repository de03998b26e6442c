"""Tables of the engine: keyed upsert, replacement, pruning, the label cache, budgets and label checks."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE_KEY = ["episode_id", "content_hash", "prompt_hash", "schema_version", "model", "cli_version"]
DIFFICULTIES = ["trivial", "moderate", "hard"]
OUTCOMES = ["success", "partial", "failed", "abandoned", "qa_only"]
SKILL_TYPES = ["skill", "script", "sop", "none"]


def once(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder of spark.checkpoint.dir, so that nothing behind it runs twice."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as once() gives it, but in columns: for wide rows that are read often, a few columns at a time."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints. Where none is set driver and executors must be one local process; its own temporary folder is used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            own = f"/tmp/checkpoints/{context.applicationId}"
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(folder or f"file://{own}")
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores: before costly work on rows, as a file of few row groups is read by few tasks however many rows it has."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; columns only one side has are filled with nulls."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_all(old: DataFrame, new: DataFrame, done: DataFrame, key: str = "episode_id") -> DataFrame:
    """old with all rows of the keys in `done` replaced by those of new, be they fewer or none; a second run changes nothing."""
    return old.join(done.select(key).distinct(), key, "left_anti").unionByName(new.join(done.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


#: Tables of an episode that go with it, and those that only lose the link.
OWNED, LINKED = ("episodes", "features", "evidence", "labels"), ("turns",)


def prune_sessions(tables: dict[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    """All tables after sessions were segmented anew: keep (session_id, episode_id) holds the episodes that there are now.

    Episodes of those sessions that are not in keep go, with their features, evidence and labels,
    and turns lose the link to them; episodes of other sessions, and surviving labels, stay.
    """
    again = keep.select("session_id").distinct()
    gone = tables["episodes"].join(again, "session_id", "left_semi").select("episode_id").join(keep.select("episode_id"), "episode_id", "left_anti").distinct()
    out = {n: t.join(gone, "episode_id", "left_anti") if n in OWNED else t for n, t in tables.items()}
    marked = gone.select(F.col("episode_id").alias("_gone"))
    for n in LINKED:
        t = tables[n].join(marked, tables[n]["episode_id"] == marked["_gone"], "left")
        out[n] = t.withColumn("episode_id", F.when(F.col("_gone").isNull(), F.col("episode_id"))).drop("_gone")
    return out


#: Columns of the stored tables; a store that lacks one, as it is older, gets it as nulls.
TABLES = {
    "sessions": "session_id string, project string, cwd string, started_at string, completed_at string, n_episodes bigint",
    "turns": "session_id string, idx bigint, event_index bigint, episode_id string, role string, classified_by string",
    "episodes": "episode_id string, session_id string, idx bigint, n_turns bigint, first_prompt string, content_hash string",
    "features": "episode_id string, n_tool_calls bigint, duration_s double, idle_s double, tokens bigint",
    "evidence": "episode_id string, signal string, direction string, weight string, value string, reason string",
    "labels": "episode_id string, label string, content_hash string, prompt_hash string, schema_version string, model string, cli_version string",
    "calibration": "episode_id string, stratum string, human_outcome string",
}


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables below path, with today's columns first and any others behind; those that are not there are empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, columns in TABLES.items():
        empty = spark.createDataFrame([], columns)
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = where.getFileSystem(conf).exists(where)
        out[name] = empty.unionByName(spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}"), allowMissingColumns=True) if there else empty
    return out


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables below path; what they read from there is computed before it is overwritten."""
    for name, df in {n: once(t) for n, t in tables.items()}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def stored_labels(episodes: DataFrame, labels: DataFrame, key: list[str] = CACHE_KEY) -> DataFrame:
    """The labels that still hold for episodes: those of equal key."""
    return labels.join(episodes.select(*key).distinct(), key, "left_semi")


def prune(rows: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is in keep."""
    return rows.join(keep.select(*keys).distinct(), keys, "left_semi")


def unlink(rows: DataFrame, keep: DataFrame, column: str) -> DataFrame:
    """rows with `column` null where it refers to nothing in keep."""
    there = keep.select(F.col(column).alias("_k")).where("_k is not null").distinct()
    joined = rows.join(there, rows[column] == there["_k"], "left")
    return joined.withColumn(column, F.col("_k")).drop("_k")


def not_yet_labeled(episodes: DataFrame, labels: DataFrame, key: list[str] = CACHE_KEY) -> DataFrame:
    """Episodes without a label of equal key; nulls are equal to nothing."""
    return episodes.join(labels.select(*key).distinct(), key, "left_anti")


def budgeted(calls: DataFrame, order: list[str], most_episodes: int, most_cost: float, most_failures: int) -> DataFrame:
    """Scan in order with its three stops: episodes are counted before the cache skip, cost after it; failures in a row break.

    calls: the order columns, cached, cost, failed. Returns the first `most_episodes` rows - none
    behind them can run, so the one ordered scan is bounded by that - with `ran` and `spent`
    (cost so far, failures included).
    """
    line = Window.orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    x = calls.orderBy(*order).limit(most_episodes).withColumn("_asked", ~F.col("cached"))
    x = x.withColumn("spent", F.sum(F.when(F.col("_asked"), F.col("cost")).otherwise(0.0)).over(upto))
    x = x.withColumn("_live", F.col("_asked") & (F.col("spent") <= most_cost))
    x = x.withColumn("_good", F.sum((F.col("_live") & ~F.col("failed")).cast("int")).over(upto))
    run = Window.partitionBy("_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_row", F.sum((F.col("_live") & F.col("failed")).cast("int")).over(run))
    x = x.withColumn("_broken", F.coalesce(F.max((F.col("_row") >= most_failures).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("ran", F.col("_live") & (F.col("_broken") == 0))
    return x.drop("_asked", "_live", "_good", "_row", "_broken")


def label_errors(v: Column) -> Column:
    """Every rule that a label, parsed as VARIANT, breaks - as texts, in order."""

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("missing"))

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    number = F.try_variant_get(v, "$.outcome_confidence", "double")
    numeric = kind("$.outcome_confidence").rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
    strings = "^ARRAY<(?:STRING|VOID)>$"
    friction = F.try_variant_get(v, "$.friction_points", "array<variant>")
    sound = lambda p: (F.schema_of_variant(F.try_variant_get(p, "$.what", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get(p, "$.evidence", "variant")) == "STRING")
    rules = [
        ("task_type", (kind("$.task_type") == "STRING") & (F.trim(text("$.task_type")) != "")),
        ("task_difficulty", text("$.task_difficulty").isin(DIFFICULTIES)),
        ("outcome", text("$.outcome").isin(OUTCOMES)),
        ("outcome_confidence", numeric & number.between(0, 1)),
        ("workflow_pattern", kind("$.workflow_pattern").rlike(strings)),
        ("good_practices", kind("$.good_practices").rlike(strings)),
        ("friction_points", kind("$.friction_points").startswith("ARRAY") & F.forall(friction, lambda p: F.coalesce(sound(p), F.lit(False)))),
        ("root_cause", kind("$.root_cause") == "STRING"),
        ("outcome_evidence", kind("$.outcome_evidence").rlike(strings)),
        ("skill_opportunity.worth_codifying", kind("$.skill_opportunity.worth_codifying") == "BOOLEAN"),
        ("skill_opportunity.type", text("$.skill_opportunity.type").isin(SKILL_TYPES)),
        ("skill_opportunity.rationale", kind("$.skill_opportunity.rationale") == "STRING"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def valid_score(v: Column, path: str) -> Column:
    """A whole number from 1 to 5, as written; nothing is rounded."""
    return F.coalesce((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT") & F.try_variant_get(v, path, "int").between(1, 5), F.lit(False))


def consolidate(outcome: Column, confidence: Column, quality: Column) -> tuple[Column, Column]:
    """(outcome, confidence) after the quality veto: a success of quality 2 or less is partial, at 0.6 confidence at most."""
    veto = F.coalesce((quality <= 2) & (outcome == "success"), F.lit(False))
    return F.when(veto, "partial").otherwise(outcome), F.when(veto, F.least(confidence, F.lit(0.6))).otherwise(confidence)
