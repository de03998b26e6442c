"""Transcript files: one JSON object a line, in files root/<project>/<session>.jsonl.

Malformed lines are dropped, order is kept: files are split like any text, and a line's place is
its rank by the block it was read from and its turn in that block. Message content is a text or a list of parts; both become one list of parts.
The raw line stays beside the typed columns, as hashes and views need it as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim

PART = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"
#: Project folders that are never read, by name or by a part of it; empty unless set.
EXCLUDED_NAMES: tuple[str, ...] = ()
EXCLUDED_PARTS: tuple[str, ...] = ()


def excluded(folder: Column, names: tuple[str, ...] = EXCLUDED_NAMES, parts: tuple[str, ...] = EXCLUDED_PARTS) -> Column:
    out = folder.isin(list(names)) if names else F.lit(False)
    for p in parts:
        out = out | F.lower(folder).contains(p)
    return out


def _parts(raw: Column) -> Column:
    content = F.get_json_object(raw, "$.message.content")
    listed = F.from_json(content, PART)
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")]))
    return F.when(content.isNull(), F.array().cast(PART)).when(js_trim(content).startswith("["), F.coalesce(listed, plain.cast(PART))).otherwise(plain.cast(PART))


def read_events(spark: SparkSession, root: str, glob: str = "*/*.jsonl") -> DataFrame:
    """(session_id, project_dir, event_index, raw, typed columns, parts) of every well-formed line."""
    lines = read_lines(spark, f"{root}/{glob}")
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return events_of_lines(lines.select(name.alias("session_id"), folder.alias("project_dir"), "line", "raw").where(~excluded(F.col("project_dir"))))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw): the lines of text files with their place in the file, from 0."""
    x = spark.read.option("lineSep", "\n").text(path)
    x = x.select(F.regexp_replace("value", "\r$", "").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_turn"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("_block", "_turn")) - 1
    return x.select("path", place.cast("bigint").alias("line"), "raw")


def events_of_lines(lines: DataFrame) -> DataFrame:
    """Typed events of (session_id, project_dir, line, raw) rows."""
    good = lines.where((js_trim(F.col("raw")) != "") & F.try_parse_json("raw").isNotNull() & js_trim(F.col("raw")).startswith("{"))
    raw = F.col("raw")

    def text(path: str) -> Column:
        return F.get_json_object(raw, path)

    return good.select(
        "session_id", "project_dir", F.col("line").cast("bigint").alias("event_index"), "raw",
        text("$.type").alias("type"), text("$.timestamp").alias("ts"), text("$.cwd").alias("cwd"), text("$.subtype").alias("subtype"),
        F.coalesce(text("$.isMeta") == "true", F.lit(False)).alias("is_meta"),
        text("$.toolUseResult").alias("tool_use_result"), text("$.durationMs").cast("double").alias("duration_ms"),
        text("$.message.usage.output_tokens").cast("bigint").alias("output_tokens"), text("$.prUrl").alias("pr_url"), text("$.prNumber").alias("pr_number"),
        _parts(raw).alias("parts"),
    )


def user_text(parts: Column) -> Column:
    """Text parts joined without a separator, trimmed."""
    return js_trim(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def n_images(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: p["type"] == "image"))


def is_human_turn() -> Column:
    """A user event with text or image that is no meta event, tool result or envelope."""
    parts = F.col("parts")
    text = user_text(parts)
    result = F.exists(parts, lambda p: p["type"] == "tool_result")
    return (F.col("type") == "user") & ~F.col("is_meta") & F.col("tool_use_result").isNull() & ~result & ((text != "") | (n_images(parts) > 0)) & ~text.startswith("<")


def tool_calls(events: DataFrame) -> DataFrame:
    """(session_id, event_index, part, name, id, path, command) of each tool use of the assistant, in order."""
    used = events.where("type = 'assistant'").select("session_id", "event_index", F.posexplode("parts").alias("part", "p")).where("p.type = 'tool_use'")
    path = F.coalesce(F.get_json_object("p.input", "$.file_path"), F.get_json_object("p.input", "$.path"))
    return used.select("session_id", "event_index", "part", F.col("p.name").alias("name"), F.col("p.id").alias("id"), path.alias("path"), F.get_json_object("p.input", "$.command").alias("command"))


def tool_results(events: DataFrame) -> DataFrame:
    """(session_id, id, result): the last result of each tool use."""
    found = events.select("session_id", "event_index", F.posexplode("parts").alias("part", "p")).where("p.type = 'tool_result'")
    return found.groupBy("session_id", F.col("p.tool_use_id").alias("id")).agg(F.max_by("p.content", F.struct("event_index", "part")).alias("result"))


def read_forks(spark: SparkSession, root: str, glob: str = "*/*/subagents/agent-*.jsonl") -> DataFrame:
    """Settled state of each forked transcript: api_error before mid_call before done, else unknown; and its tool count."""
    lines = read_lines(spark, f"{root}/{glob}").select(F.regexp_extract("path", r"agent-([^/]+)\.jsonl$", 1).alias("session_id"), F.lit("").alias("project_dir"), "line", "raw")
    x = events_of_lines(lines)
    used = F.exists("parts", lambda p: p["type"] == "tool_use")
    said = F.exists("parts", lambda p: (p["type"] == "text") & (js_trim(F.coalesce(p["text"], F.lit(""))) != ""))
    spoke = F.when(F.col("type") == "assistant", F.col("event_index"))
    out = x.groupBy(F.col("session_id").alias("agent_id")).agg(
        F.max_by(F.col("subtype") == "api_error", "event_index").alias("failed"), F.max_by(used & ~said, spoke).alias("calls"), F.max_by(said, spoke).alias("said"),
        F.sum(F.size(F.filter("parts", lambda p: p["type"] == "tool_use"))).alias("tool_count"),
    )
    state = F.when(F.coalesce("failed", F.lit(False)), "api_error").when(F.col("calls"), "mid_call").when(F.col("said"), "done").otherwise("unknown")
    return out.select("agent_id", state.alias("outcome"), "tool_count")


def read_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of all machines from candidates_<machine>.json files; files that do not parse are skipped."""
    item = "array<struct<cluster_id:string,label:string,dominant_pattern:string,frequency:bigint,recommended_intervention:string>>"
    files = spark.read.text(f"{root}/candidates_*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    own = F.coalesce(F.get_json_object("value", "$.machine_id"), F.regexp_extract("file", r"^candidates_(.*)\.json$", 1))
    rows = files.select(own.alias("machine_id"), F.explode(F.from_json(F.get_json_object("value", "$.candidates"), item)).alias("c"))
    return rows.select("machine_id", "c.cluster_id", "c.label", "c.dominant_pattern", F.coalesce("c.frequency", F.lit(0)).alias("frequency"), F.coalesce("c.recommended_intervention", F.lit("none")).alias("intervention"))


def machine_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def write_candidates(candidates: DataFrame, machine_id: str, path: str) -> None:
    """All candidates of one machine as one JSON document (candidates are few: one a cluster)."""
    listed = candidates.agg(F.array_sort(F.collect_list(F.struct(*candidates.columns))).alias("candidates"))
    doc = F.to_json(F.struct(machine_name(F.lit(machine_id)).alias("machine_id"), "candidates"))
    listed.select(doc.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(candidates: DataFrame, path: str, most: int = 50) -> None:
    """A Markdown table of the most frequent candidates."""
    top = candidates.orderBy(F.desc("frequency"), F.desc("success_rate"), "cluster_id").limit(most)
    cell = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]+", " ") for c in top.columns]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cell), " | "), F.lit(" |"))
    head = "| " + " | ".join(top.columns) + " |\n|" + "---|" * len(top.columns)
    rows = top.select(F.col("frequency").alias("_f"), F.col("cluster_id").alias("_c"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_f")).alias("f"), "_c", "line"))), lambda r: r["line"]), "\n")
    rows.agg(F.concat_ws("\n", F.lit("# Workflow candidates\n"), F.lit(head), body).alias("value")).coalesce(1).write.mode("overwrite").text(path)
