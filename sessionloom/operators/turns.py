"""Sessions and human turns: spans, filters, gaps, and the classification of turns.

Events carry session_id and event_index (their order in the session); all windows of a
session share the one exchange on session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SHORT_GAP_S, LONG_GAP_S = 600, 1800
SOME_OVERLAP, MUCH_OVERLAP = 0.2, 0.6
SHORT_TEXT = 40


def session_spans(events: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last timestamp of a session in event order - not the least and greatest - and its size."""
    known = F.when(F.col(ts).isNotNull(), F.col("event_index"))
    return events.groupBy("session_id").agg(
        F.min_by(ts, known).alias("started_at"), F.max_by(ts, known).alias("completed_at"), F.count(F.lit(1)).alias("n_events")
    )


def project_name(path: Column) -> Column:
    """Last step of a path without its trailing slashes; empty paths give `unknown`."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.coalesce(F.nullif(F.element_at(F.split(bare, "/"), -1), F.lit("")), F.lit("unknown"))


def decoded_folder(folder: Column) -> Column:
    """The path that a transcript folder's name stands for, as far as it tells."""
    return F.replace(folder, F.lit("-"), F.lit("/"))


def discover(events: DataFrame, project: str | None = None, since: str | None = None, allow: list[str] | None = None, limit: int = 0) -> DataFrame:
    """(session_id, project, project_dir, cwd, started_at, completed_at, n_events): the sessions of transcript events, filtered and the earliest first.

    events: sources.transcripts.read_events, which leaves excluded folders out. cwd is the first
    that a session's events name, else the folder's name decoded; timestamps are texts, empty
    where no event has one.
    """
    cwd = F.min_by("cwd", F.when(F.coalesce("cwd", F.lit("")) != "", F.col("event_index")))
    known = events.withColumn("ts", F.nullif("ts", F.lit("")))
    own = known.groupBy("session_id", "project_dir").agg(cwd.alias("cwd"))
    x = own.join(session_spans(known), "session_id").withColumn("cwd", F.coalesce("cwd", decoded_folder(F.col("project_dir"))))
    x = x.select("session_id", project_name(F.col("cwd")).alias("project"), "project_dir", "cwd", *[F.coalesce(c, F.lit("")).alias(c) for c in ("started_at", "completed_at")], "n_events")
    return filter_sessions(x, project, since, allow, limit)


def filter_sessions(sessions: DataFrame, project: str | None = None, since: str | None = None, allow: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Sessions by project substring, by text order of completed_at, by id or id prefix; the earliest `limit` of them (0: all)."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if project:
        sessions = sessions.where(F.lower("project").contains(project.lower()))
    if since:
        sessions = sessions.where((F.col("completed_at") != "") & (F.col("completed_at") >= since))
    if allow:
        keep = F.lit(False)
        for a in allow:
            keep = keep | F.col("session_id").startswith(a)
        sessions = sessions.where(keep)
    return sessions.orderBy(F.coalesce("started_at", F.lit("")), "session_id").limit(limit) if limit else sessions


def human_turns(events: DataFrame, is_human: Column) -> DataFrame:
    """Human turns with their place among the session's human turns."""
    order = Window.partitionBy("session_id").orderBy("event_index")
    return events.where(is_human).withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))


def with_gaps(turns: DataFrame, seconds: Column) -> DataFrame:
    """gap_s to the session's previous human turn (infinite if either time is unknown), and whether the text repeats it."""
    order = Window.partitionBy("session_id").orderBy("idx")
    gap = seconds - F.lag(seconds).over(order)
    return turns.withColumn("gap_s", F.coalesce(gap.cast("double"), F.lit(float("inf")))).withColumn("repeats", F.coalesce(F.col("text") == F.lag("text").over(order), F.lit(False)))


def classify(turns: DataFrame, context: DataFrame) -> DataFrame:
    """Roles of human turns: heuristics, then the fold over each session's ambiguous turns.

    turns: session_id, idx, event_index, text, n_images, gap_s, repeats. context: session_id,
    event_index, words (an assistant event's keywords). The fold's state is the event of the
    last task boundary and the distinct context words since then; an ambiguous turn is a follow-up
    or opens a task (see SURVEY 2.9). Each turn brings the words between its predecessor and itself.
    """
    known = turns.withColumn("role0", T.heuristic_role(F.col("text"), F.col("n_images"))).select(
        "session_id",
        F.struct(
            "idx", "event_index", "role0", "gap_s", "repeats", F.length("text").alias("chars"),
            T.is_continuation_cue(F.col("text")).alias("cue"), T.keywords(F.col("text")).alias("words"),
        ).alias("t"),
    )
    both = context.select("session_id", "event_index", "words", F.lit(None).cast("bigint").alias("idx")).unionByName(turns.select("session_id", "event_index", F.lit(None).cast("array<string>").alias("words"), "idx"))
    back = Window.partitionBy("session_id").orderBy(F.desc("event_index")).rowsBetween(Window.unboundedPreceding, 0)
    between = both.withColumn("idx", F.last("idx", ignorenulls=True).over(back)).where("words is not null and idx is not null")
    between = between.groupBy("session_id", "idx").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("new"))
    known = known.withColumn("idx", F.col("t.idx")).join(between, ["session_id", "idx"], "left")
    none = F.array().cast("array<string>")
    lists = known.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t.*", F.coalesce("new", none).alias("new")))).alias("turns"))

    def fold(acc: Column, t: Column) -> Column:
        return F.get(F.transform(F.array(F.array_union(acc["seen"], t["new"])), lambda seen: step(acc, t, seen)), F.lit(0))

    def step(acc: Column, t: Column, seen: Column) -> Column:
        last = acc["last"]
        overlap = T.containment(t["words"], seen)
        open_ = last >= 0
        near = (t["gap_s"] < SHORT_GAP_S) & ((overlap >= SOME_OVERLAP) | (t["chars"] <= SHORT_TEXT))
        far = (t["gap_s"] < LONG_GAP_S) & (overlap >= MUCH_OVERLAP)
        follows = open_ & (t["cue"] | (t["repeats"] & (t["chars"] > 0)) | near | far)
        sure = t["role0"] != "new_task"
        role = F.when(sure, t["role0"]).when(follows, "continuation").otherwise("new_task")
        by = F.when(sure | (~follows & open_ & (overlap >= SOME_OVERLAP)), "heuristic").otherwise("signal")
        moved = F.when(role == "new_task", t["event_index"]).otherwise(last)
        made = F.struct(t["idx"].alias("idx"), t["event_index"].alias("event_index"), role.alias("role"), by.alias("classified_by"))
        since = F.when(role == "new_task", none).otherwise(seen)
        return F.struct(moved.cast("bigint").alias("last"), since.alias("seen"), F.array_append(acc["out"], made).alias("out"))

    kind = "array<struct<idx:bigint,event_index:bigint,role:string,classified_by:string>>"
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), none.alias("seen"), F.array().cast(kind).alias("out"))
    out = lists.select("session_id", F.explode(F.aggregate("turns", start, fold)["out"]).alias("o"))
    return out.select("session_id", "o.idx", "o.event_index", "o.role", "o.classified_by")


def overridden(roles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Roles with those of an outside pass put in where it gave one of the three it may give; boundaries are not recomputed."""
    own = overrides.where(F.col("role").isin("new_task", "continuation", "correction")).select("session_id", "idx", F.col("role").alias("_role"))
    x = roles.join(own, ["session_id", "idx"], "left")
    by = F.when(F.col("_role").isNotNull(), "outside").otherwise(F.col("classified_by"))
    return x.withColumn("classified_by", by).withColumn("role", F.coalesce("_role", "role")).drop("_role")


def previous_task(roles: DataFrame) -> DataFrame:
    """roles with the idx of the nearest earlier new_task of the session."""
    before = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return roles.withColumn("task_idx", F.last(F.when(F.col("role") == "new_task", F.col("idx")), ignorenulls=True).over(before))


def checked_number(value: float, name: str, least: float = 0) -> float:
    """A numeric option that fails closed: not a number, or under `least`, raises."""
    number = float(value)
    if not number >= least or number == float("inf"):
        raise ValueError(f"{name} must be a number of at least {least}")
    return number
