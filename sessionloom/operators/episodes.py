"""Episodes: segmentation, features, evidence, content hash and the compact view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEQUENCE_CAP = 40
RENDER_CAP = 12000
USER_CAP, ASSISTANT_CAP, INPUT_CAP, PROMPT_CAP = 700, 1000, 160, 200
#: Headings and marks of the compact view.
SIGNALS_HEAD, SUBAGENTS_HEAD, IMAGE = "--- EVIDENCE SIGNALS ---", "--- SUBAGENTS ---", "[image attached]"
IDLE_GAP_S = 60
EPISODE = ["session_id", "idx"]
#: Praise and rejection words, and the marks of a test's outcome.
PRAISE = rf"(?i){T.B}(?:perfect|great|awesome|excellent|nice|lgtm|looks good|well done|thanks|thank you|amazing){T.B}"
REJECT = rf"(?i){T.B}(?:wrong|revert|undo|no{T.B}|not right|that's not|incorrect|broke|broken){T.B}"
TEST_COMMAND = rf"(?i){T.B}(?:pytest|jest|vitest|mocha|npm\s+(?:run\s+)?test|yarn\s+test|pnpm\s+(?:run\s+)?test|bun\s+test|go\s+test|cargo\s+test|cargo\s+build|make{T.B}|gradle{T.B}|mvn{T.B}|ctest|tox|rspec|phpunit|dotnet\s+test|python\s+-m\s+pytest|python\s+-m\s+unittest){T.B}"
BARE_TEST = r"(?i)(?:^|\s|&&|\|\||;)test(?:\s|$|&&|\|\||;)"
FAIL = rf"(?i){T.B}(?:failed|failing|failure|failures|traceback|exception|assertionerror|panic|segfault|segmentation fault|fatal error|exit code [1-9]|exit status [1-9]|non-zero){T.B}"
FAIL_COUNT = rf"(?i){T.B}[1-9][0-9]*\s+(?:failed|failing|failures?){T.B}|{T.B}[1-9][0-9]*\s+errors?{T.B}(?!\s+(?:suppressed|ignored|tolerated|expected|allowed|as\s+warnings?|warning))"
PASS = rf"(?i){T.B}(?:pass|passed|passing|ok{T.B}|success|succeeded|all tests passed|[0-9]+\s+passed|exit code 0|exit status 0){T.B}"
PASS_CLEAN = rf"(?i){T.B}(?:0 (?:failed|errors?|failures?)|no errors|no failures|all tests passed|tests passed|build succeeded){T.B}"


def segment(events: DataFrame, is_task: Column, is_human: Column) -> DataFrame:
    """idx of each event's episode: the count of task starts so far, less one; what leads belongs to episode 0.

    Sessions without a human turn have no episode.
    """
    order = Window.partitionBy("session_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("session_id")
    counted = F.sum(is_task.cast("bigint")).over(order) - 1
    marked = events.withColumn("idx", F.greatest(counted, F.lit(0).cast("bigint"))).withColumn("_human", F.max(is_human.cast("int")).over(whole))
    return marked.where("_human = 1").drop("_human")


def turn_counts(turns: DataFrame) -> DataFrame:
    """Turns of each episode by role, their images, and the first prompt. turns: session_id, idx, event_index, role, text, n_images."""
    of = lambda role: F.count_if(F.col("role") == role)
    return turns.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("n_turns"), of("correction").alias("n_corrections"), of("interruption").alias("n_interruptions"), of("approval").alias("n_approvals"),
        F.coalesce(F.sum("n_images"), F.lit(0)).cast("bigint").alias("n_images"), F.left(F.min_by("text", "event_index"), F.lit(PROMPT_CAP)).alias("first_prompt"),
    )


def is_test_command(command: Column) -> Column:
    return command.rlike(TEST_COMMAND) | command.rlike(BARE_TEST)


def test_verdict(result: Column) -> Column:
    """failed, passed or null of a test's output; a clean-pass mark vetoes a failure, but only a word of passing passes."""
    failed = (result.rlike(FAIL) | result.rlike(FAIL_COUNT)) & ~result.rlike(PASS_CLEAN)
    return F.when(failed, "failed").when(result.rlike(PASS), "passed")


def tool_sequence(calls: DataFrame, keys: list[str] = EPISODE) -> DataFrame:
    """Names of the calls in order, immediate repeats collapsed, at most SEQUENCE_CAP and then an ellipsis."""
    before = F.lag("name").over(Window.partitionBy(*keys).orderBy("event_index"))
    kept = calls.withColumn("_before", before).where(~F.col("name").eqNullSafe(F.col("_before")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("event_index", "name"))), lambda s: s["name"])
    cut = F.when(F.size("_n") > SEQUENCE_CAP, F.array_append(F.slice("_n", 1, SEQUENCE_CAP), F.lit("…"))).otherwise(F.col("_n"))
    return kept.groupBy(*keys).agg(names.alias("_n")).select(*keys, F.array_join(cut, ">").alias("tool_sequence"))


def features(events: DataFrame) -> DataFrame:
    """Counts, distinct files, duration, idle time and tokens of each episode.

    events: session_id, idx, event_index, s (seconds), human, name (tool or null), path, test,
    turn_s (own duration or null), tokens. Duration is the sum of the turns' own where there is
    any, else the span in event order, never negative.
    """
    gaps = events.where("human and s is not null").withColumn("_gap", F.col("s") - F.lag("s").over(Window.partitionBy(*EPISODE).orderBy("s", "event_index")))
    idle = gaps.groupBy(*EPISODE).agg(F.coalesce(F.sum(F.when(F.col("_gap") > IDLE_GAP_S, F.col("_gap"))), F.lit(0.0)).alias("_idle"))
    at = F.when(F.col("s").isNotNull(), F.col("event_index"))
    out = events.groupBy(*EPISODE).agg(
        F.count("name").alias("n_tool_calls"),
        F.count_distinct(F.when(F.col("name") == "Read", F.col("path"))).alias("n_files_read"),
        F.count_distinct(F.when(F.col("name").isin("Edit", "Write"), F.col("path"))).alias("n_files_edited"),
        F.count_if("test").alias("n_test_runs"),
        F.sum("turn_s").alias("_own"),
        (F.max_by("s", at) - F.min_by("s", at)).alias("_span"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    )
    out = out.join(idle, EPISODE, "left")
    duration = F.coalesce(F.col("_own"), F.greatest(F.col("_span"), F.lit(0.0)), F.lit(0.0))
    idle_s = F.greatest(F.coalesce("_idle", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0)), F.lit(0.0))
    return out.select(*EPISODE, "n_tool_calls", "n_files_read", "n_files_edited", "n_test_runs", F.round(duration, 2).alias("duration_s"), F.round(idle_s, 2).alias("idle_s"), "tokens")


def read_before_edit(calls: DataFrame) -> DataFrame:
    """The first edit of each episode whose path was read earlier in it: (session_id, idx, event_index, path)."""
    files = Window.partitionBy(*EPISODE, "path").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    marked = calls.withColumn("_read", F.max((F.col("name") == "Read").cast("int")).over(files))
    edits = marked.where(F.col("name").isin("Edit", "Write") & (F.col("_read") == 1) & F.col("path").isNotNull())
    return edits.groupBy(*EPISODE).agg(F.min("event_index").alias("event_index"), F.min_by("path", "event_index").alias("path"))


def next_event(events: DataFrame, wanted: Column, column: str, keys: list[str] = EPISODE) -> Column:
    """column of the nearest later event of the episode that is wanted: a forward as-of lookup, as a running one backwards."""
    after = Window.partitionBy(*keys).orderBy(F.desc("event_index")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(wanted, F.col(column)), ignorenulls=True).over(after)


def last_is_open(events: DataFrame, is_open: Column) -> DataFrame:
    """Sessions whose very last event is_open: their last episode was left in the middle."""
    ends = events.groupBy("session_id").agg(F.max("idx").alias("idx"), F.max("event_index").alias("event_index"), F.max_by(is_open, "event_index").alias("open"))
    return ends.where("open").select("session_id", "idx", "event_index")


def evidence_row(name: str, direction: str, weight: str, value: Column, reason: Column) -> Column:
    return F.struct(F.lit(name).alias("signal"), F.lit(direction).alias("direction"), F.lit(weight).alias("weight"), value.cast("string").alias("value"), reason.alias("reason"))


def content_hash(events: DataFrame) -> DataFrame:
    """sha256 of each episode's parts in order, joined by line feeds. events: session_id, idx, event_index, part."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_index", "part"))), lambda p: p["part"])
    return events.groupBy(*EPISODE).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("content_hash"))


def line_of(role: Column, text: Column) -> Column:
    """One line of the compact view; user envelopes and blank texts give none (null)."""
    clean = T.js_trim(text)
    user = F.when((clean != "") & ~clean.startswith("<"), F.concat(F.lit("USER: "), F.left(clean, F.lit(USER_CAP))))
    return F.when(role == "user", user).when((role == "assistant") & (clean != ""), F.concat(F.lit("ASSISTANT: "), F.left(clean, F.lit(ASSISTANT_CAP))))


def fit_within_cap(body: Column, appended: Column, cap: int = RENDER_CAP) -> Column:
    """Body and appended blocks in at most `cap` characters: the middle of the body is elided, the blocks are not."""
    sep = F.when(appended == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), appended))
    n, budget = F.length(body), F.lit(cap) - F.length(sep)
    whole = F.concat(body, sep)

    def marker(k: Column) -> Column:
        return F.concat(F.lit("\n… ["), k.cast("string"), F.lit(" chars elided] …\n"))

    share, mark = F.floor(budget * 0.4), F.length(marker(n))
    left = F.greatest(budget - mark, F.lit(0))
    over = 2 * share + mark > budget
    head = F.when(over, F.floor(left / 2)).otherwise(share).cast("int")
    tail = F.when(over, left - F.floor(left / 2)).otherwise(share).cast("int")
    cut = F.concat(F.left(body, head), marker(n - head - tail), F.right(body, tail), sep)
    return F.when(F.length(whole) <= cap, whole).when(budget < 0, F.left(whole, F.lit(cap))).otherwise(F.left(cut, F.lit(cap)))


def render(events: DataFrame, cap: int = RENDER_CAP) -> DataFrame:
    """The compact view of each episode. events: session_id, idx, event_index, role, text."""
    lines = events.withColumn("line", line_of(F.col("role"), F.col("text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("event_index", "line")))), lambda p: p["line"]), "\n")
    none = F.lit(f"{SIGNALS_HEAD}\n(none)")
    return lines.groupBy(*EPISODE).agg(body.alias("body")).select(*EPISODE, fit_within_cap(F.col("body"), none, cap).alias("rendered"))


def event_lines(human: Column) -> Column:
    """The lines of an event, by its type and parts: a human turn with its images, an assistant's texts and tool calls."""
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    image = F.exists("parts", lambda p: p["type"] == "image")

    def user(t: Column) -> Column:
        return F.concat(F.lit("USER: "), F.concat_ws(" ", F.nullif(F.left(t, F.lit(USER_CAP)), F.lit("")), F.when(image, F.lit(IMAGE))))

    def line(p: Column) -> Column:
        said = T.js_trim(F.coalesce(p["text"], F.lit("")))
        call = F.concat(F.lit("  [tool:"), F.coalesce(p["name"], F.lit("?")), F.lit(" "), F.left(F.coalesce(p["input"], F.lit("{}")), F.lit(INPUT_CAP)), F.lit("]"))
        return F.when((p["type"] == "text") & (said != ""), F.concat(F.lit("ASSISTANT: "), F.left(said, F.lit(ASSISTANT_CAP)))).when(p["type"] == "tool_use", call)

    none = F.array().cast("array<string>")
    return F.when(human, F.array(T.bound(T.js_trim(text), user))).when(F.col("type") == "assistant", F.array_compact(F.transform("parts", line))).otherwise(none)


def render_full(events: DataFrame, human: Column, signals: DataFrame, subagents: DataFrame | None = None, cap: int = RENDER_CAP) -> DataFrame:
    """(KEYS, rendered): conversation and tool lines of each episode, then its evidence and subagents, which are never elided.

    events: session_id, idx, event_index, type, parts. signals, subagents: the blocks of operators.evidence.
    """
    lines = events.select(*EPISODE, F.struct("event_index", event_lines(human).alias("lines")).alias("l"))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["lines"])), "\n")
    x = lines.groupBy(*EPISODE).agg(body.alias("body")).join(signals, EPISODE, "left")
    blocks = [F.coalesce("signals", F.lit(f"{SIGNALS_HEAD}\n(none)"))]
    if subagents is not None:
        x, blocks = x.join(subagents, EPISODE, "left"), [*blocks, F.col("subagents")]
    return x.select(*EPISODE, fit_within_cap(F.col("body"), F.concat_ws("\n\n", *blocks), cap).alias("rendered"))


def hash_parts(events: DataFrame) -> DataFrame:
    """(session_id, idx, event_index, part) for content_hash(): user texts as written, assistant texts, and tool calls with their input.

    Tool results and blank user events have none; event_index orders the parts of one event too.
    """
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    result = F.col("tool_use_result").isNotNull() | F.exists("parts", lambda p: p["type"] == "tool_result")
    call = lambda p: F.concat(F.lit("T:"), F.coalesce(p["name"], F.lit("undefined")), F.coalesce(p["input"], F.lit("{}")))
    parts = F.when((F.col("type") == "user") & ~result & (text != ""), F.array(F.concat(F.lit("USER:"), text))).when(
        F.col("type") == "assistant", F.array_compact(F.transform("parts", lambda p: F.when(p["type"] == "text", F.concat(F.lit("A:"), p["text"])).when(p["type"] == "tool_use", call(p))))
    )
    x = events.select(*EPISODE, "event_index", F.posexplode(parts).alias("k", "part"))
    return x.select(*EPISODE, (F.col("event_index") * (1 << 20) + F.col("k")).alias("event_index"), "part")


def result_text(v: Column) -> Column:
    """A tool result, parsed as VARIANT, as one lower-case text: a string itself, else its output, errors and contents, else its JSON (an array's too)."""

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    kind = F.schema_of_variant(v)
    interrupted = F.when(F.try_variant_get(v, "$.interrupted", "boolean"), "interrupted")
    listed = F.array_join(F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "\n")
    whole = F.nullif(F.concat_ws("\n", text("$.stdout"), text("$.stderr"), interrupted, F.coalesce(text("$.content"), F.nullif(listed, F.lit("")))), F.lit(""))
    return F.lower(F.when(v.isNull(), "").when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(whole, F.to_json(v))).when(kind.startswith("ARRAY"), F.to_json(v)).otherwise(""))


def opens_pull_request(command: Column) -> Column:
    return command.rlike(r"(?i)gh\s+pr\s+create")


def linked_forks(calls: DataFrame, results: DataFrame, forks: DataFrame) -> DataFrame:
    """Agent calls with their fork: by the result, else by tool-use id, else by lower-cased description, last written first.

    calls: id, description, subagent_type. results: id, agent_id, agent_type, tool_count, status.
    forks: agent_id, agent_type, description, tool_use_id, tool_count, outcome, name. A count of 0
    counts as missing.
    """
    def index(key: Column, prefix: str) -> DataFrame:
        x = forks.withColumn("_k", key).where("_k is not null and _k <> ''")
        return x.groupBy("_k").agg(*[F.max_by(c, "name").alias(f"{prefix}{c}") for c in ("agent_id", "agent_type", "description", "tool_count", "outcome")]).withColumnRenamed("_k", f"{prefix}key")

    by_id, by_text = index(F.col("tool_use_id"), "i_"), index(F.lower(F.trim("description")), "d_")
    own = results.select(F.col("id").alias("r_id"), F.col("agent_id").alias("r_agent_id"), F.col("agent_type").alias("r_agent_type"), F.col("tool_count").alias("r_tool_count"), F.col("status").alias("r_status"))
    x = calls.join(own, F.col("id") == F.col("r_id"), "left").join(by_id, F.col("id") == F.col("i_key"), "left").join(by_text, F.lower(F.trim(calls["description"])) == F.col("d_key"), "left")

    def fork(c: str) -> Column:
        return F.when(F.col("i_key").isNotNull(), F.col(f"i_{c}")).otherwise(F.col(f"d_{c}"))

    return x.select(
        "id",
        F.coalesce("r_agent_id", fork("agent_id"), F.lit("")).alias("agent_id"),
        F.coalesce("r_agent_type", fork("agent_type"), "subagent_type", F.lit("unknown")).alias("agent_type"),
        F.coalesce(F.nullif(fork("description"), F.lit("")), calls["description"], F.lit("")).alias("description"),
        F.coalesce(F.nullif(F.col("r_tool_count"), F.lit(0)), fork("tool_count"), F.lit(0)).cast("bigint").alias("tool_count"),
        F.coalesce("r_status", fork("outcome"), F.lit("unknown")).alias("outcome"),
    )
