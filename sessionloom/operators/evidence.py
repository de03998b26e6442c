"""Evidence of an episode, from its events and human turns: ten kinds of signals, each a hint and no verdict.

events: session_id, idx, event_index, type, subtype, raw, parts, tool_use_result, pr_url,
pr_number (see sources.transcripts, with idx from episodes.segment). turns: session_id, idx,
event_index, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import episodes as E

KEYS = E.EPISODE
#: What reasons say.
PR_LINK, PR_COMMAND = "pr-link event", "`gh pr create` Bash command"
APPROVES, PRAISES, REJECTS = "approval-role turn near episode end", "praise in user turn", "correction turn rejecting work"
ABANDONS = "episode ends on an unresolved tool_use with no following resolution"
INTERRUPTED, FAILS, PASSES = "test/build command interrupted or errored", "test/build output indicates failure", "test/build output indicates pass"
CORRECTS, API_ERRORS, COMPACTS = " correction turn(s)", " system/api_error event(s) — likely transient infra", " compaction boundary(ies) — context overflow"
READ_FIRST = "Read preceded Edit on "
QUOTED, COMMAND_CAP, APPROVAL_TAIL = 40, 80, 2


def one_line_value(x: Column) -> Column:
    """A signal's text on one line."""
    return T.js_trim(F.regexp_replace(x, f"{T.S}+", " "))


def tool_calls(events: DataFrame) -> DataFrame:
    """(KEYS, at, name, id, input, path, command) of every named tool use of the assistant; at orders calls, those of one event too."""
    used = events.where("type = 'assistant'").select(*KEYS, "event_index", F.posexplode("parts").alias("part", "p")).where("p.type = 'tool_use' and p.name is not null")
    path = F.coalesce(F.get_json_object("p.input", "$.file_path"), F.get_json_object("p.input", "$.path"))
    at = F.col("event_index") * (1 << 20) + F.col("part")
    return used.select(*KEYS, at.alias("at"), "event_index", F.col("p.name").alias("name"), F.col("p.id").alias("id"), F.col("p.input").alias("input"), path.alias("path"), F.get_json_object("p.input", "$.command").alias("command"))


def _haystack(r: Column) -> Column:
    """A result as one lower-case text: an object's outputs, else the text itself."""
    return F.coalesce(F.when(r.startswith("{"), F.nullif(E.result_text(F.try_parse_json(r)), F.lit(""))), F.lower(r), F.lit(""))


def test_runs(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(KEYS, at, command, verdict, interrupted) of the test and build commands.

    The result of a call is that of its id in the episode, the last one, else what the next user event holds.
    """
    content = F.get_json_object("raw", "$.message.content")
    user = F.col("type") == "user"
    seen = events.withColumn("_held", F.when(user, F.struct(F.coalesce("tool_use_result", content).alias("r"))))
    behind = seen.select(*KEYS, "event_index", E.next_event(seen, user, "_held").alias("_next"))
    parts = events.where(user).select(*KEYS, "event_index", "tool_use_result", F.posexplode("parts").alias("part", "p")).where("p.type = 'tool_result' and p.tool_use_id is not null")
    own = parts.groupBy(*KEYS, F.col("p.tool_use_id").alias("id")).agg(F.max_by(F.struct(F.coalesce("p.content", "tool_use_result").alias("r")), F.struct("event_index", "part")).alias("_own"))
    tests = calls.where((F.col("name") == "Bash") & E.is_test_command(F.coalesce("command", F.lit(""))))
    x = tests.join(own, [*KEYS, "id"], "left").join(behind, [*KEYS, "event_index"], "left")
    r = F.coalesce("_own", "_next")["r"]
    interrupted = F.coalesce(r.startswith("{") & (F.get_json_object(r, "$.interrupted") == "true"), F.lit(False))
    x = x.withColumns({"interrupted": interrupted, "_hay": _haystack(r)})
    return x.select(*KEYS, "at", "command", F.when(F.col("interrupted"), "failed").otherwise(E.test_verdict(F.col("_hay"))).alias("verdict"), "interrupted")


def evidence(events: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, idx, ord, signal, direction, weight, value, reason): the signals of every episode in fixed order."""
    uses = F.exists("parts", lambda p: p["type"] == "tool_use")
    says = F.exists("parts", lambda p: (p["type"] == "text") & (T.js_trim(F.coalesce(p["text"], F.lit(""))) != ""))
    system = lambda kind: F.count_if((F.col("type") == "system") & (F.col("subtype") == kind))
    base = events.groupBy(*KEYS).agg(
        F.min_by(F.struct("pr_url", "pr_number"), F.when(F.col("type") == "pr-link", F.col("event_index"))).alias("pr"),
        system("api_error").alias("api"), system("compact_boundary").alias("compact"),
        F.max_by((F.col("type") == "assistant") & uses & ~says, "event_index").alias("open"),
    )
    base = base.withColumn("last", F.col("idx") == F.max("idx").over(Window.partitionBy("session_id")))

    calls = tool_calls(events)
    runs = test_runs(events, calls)
    bad = F.when(F.col("verdict") == "failed", F.col("at"))
    good = F.when(F.col("verdict") == "passed", F.col("at"))
    run = F.struct("at", "command", "interrupted")
    runs = runs.groupBy(*KEYS).agg(F.min_by(run, bad).alias("failed"), F.min_by(run, good).alias("passed"))
    command = calls.groupBy(*KEYS).agg(F.bool_or((F.col("name") == "Bash") & E.opens_pull_request(F.coalesce("command", F.lit("")))).alias("gh"))
    read = E.read_before_edit(calls.withColumn("event_index", F.col("at"))).select(*KEYS, "path")

    late = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("event_index"))) <= APPROVAL_TAIL
    first = lambda test: F.min_by("text", F.when(test, F.col("event_index")))
    said = turns.withColumn("_late", late).groupBy(*KEYS).agg(
        first(F.col("_late") & (F.col("role") == "approval")).alias("approves"), first(F.col("text").rlike(E.PRAISE)).alias("praises"),
        first((F.col("role") == "correction") & F.col("text").rlike(E.REJECT)).alias("rejects"), F.count_if(F.col("role") == "correction").alias("corrections"),
    )

    x = base
    for other in (runs, command, read, said):
        x = x.join(other, KEYS, "left")

    def row(signal: str, direction: str, weight: str, value: Column, reason: Column) -> Column:
        return E.evidence_row(signal, direction, weight, one_line_value(value.cast("string")), reason)

    def quoted(why: str, text: str) -> Column:
        return F.concat(F.lit(why + ' ("'), F.left(F.col(text), F.lit(QUOTED)), F.lit('")'))

    def counted(n: str, why: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.lit(why))

    true = F.lit("true")
    number = F.nullif(F.col("pr.pr_number"), F.lit("0"))
    linked = row("created_pr", "+", "strong", F.coalesce("pr.pr_url", "pr.pr_number", true), F.concat(F.lit(PR_LINK), F.coalesce(F.concat(F.lit(" #"), number), F.lit(""))))
    fails = F.when(
        F.col("failed").isNotNull(),
        row("test_failed", "-", "medium", F.left("failed.command", F.lit(COMMAND_CAP)), F.when(F.col("failed.interrupted"), INTERRUPTED).otherwise(FAILS)),
    )
    passes = F.when(F.col("passed").isNotNull(), row("test_passed", "+", "medium", F.left("passed.command", F.lit(COMMAND_CAP)), F.lit(PASSES)))
    pass_first = F.coalesce(F.col("passed.at") < F.col("failed.at"), F.lit(False))
    rows = F.array(
        F.when(F.col("pr").isNotNull(), linked).when(F.col("gh"), row("created_pr", "+", "strong", F.lit("gh pr create"), F.lit(PR_COMMAND))),
        F.when(F.col("approves").isNotNull(), row("explicit_user_approval", "+", "strong", true, quoted(APPROVES, "approves"))).when(
            F.col("praises").isNotNull(), row("explicit_user_approval", "+", "strong", true, quoted(PRAISES, "praises"))
        ),
        F.when(F.col("rejects").isNotNull(), row("explicit_user_rejection", "-", "strong", true, quoted(REJECTS, "rejects"))),
        F.when(F.col("open") & F.col("last"), row("abandoned_mid_edit", "-", "strong", true, F.lit(ABANDONS))),
        F.when(pass_first, passes).otherwise(fails),
        F.when(pass_first, fails).otherwise(passes),
        F.when(F.col("corrections") > 0, row("n_corrections", "-", "weak", F.col("corrections"), counted("corrections", CORRECTS))),
        F.when(F.col("api") > 0, row("api_errors", "0", "weak", F.col("api"), counted("api", API_ERRORS))),
        F.when(F.col("compact") > 0, row("compact_boundary", "-", "weak", F.col("compact"), counted("compact", COMPACTS))),
        F.when(F.col("path").isNotNull(), row("read_before_edit", "+", "weak", F.col("path"), F.concat(F.lit(READ_FIRST), "path"))),
    )
    out = x.select(*KEYS, F.posexplode(F.array_compact(rows)).alias("ord", "e"))
    return out.select(*KEYS, F.col("ord").cast("bigint").alias("ord"), "e.*")


def signals_block(signals: DataFrame) -> DataFrame:
    """(KEYS, block): the lines of each episode's evidence under their heading."""
    line = F.concat("signal", F.lit(" ("), "direction", "weight", F.lit("): "), F.coalesce("value", F.lit("null")), F.lit(" — "), "reason")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda s: s["line"])
    return signals.groupBy(*KEYS).agg(F.concat(F.lit(E.SIGNALS_HEAD + "\n"), F.array_join(lines, "\n")).alias("signals"))


def subagents_block(links: DataFrame) -> DataFrame:
    """(KEYS, block) of linked subagents in order: KEYS, ord, agent_type, description, tool_count, outcome."""
    line = F.concat("agent_type", F.lit(": "), "description", F.lit(" (tools="), F.col("tool_count").cast("string"), F.lit(", outcome="), "outcome", F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda s: s["line"])
    return links.groupBy(*KEYS).agg(F.concat(F.lit(E.SUBAGENTS_HEAD + "\n"), F.array_join(lines, "\n")).alias("subagents"))
