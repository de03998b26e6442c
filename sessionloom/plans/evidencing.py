"""Queries that read transcripts: typed events, tool calls with results, evidence, the full compact view, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import evidence as V
from ..operators import turns as TU
from ..sources import transcripts as TR
from . import bindings as D
from .registry import oracle, query
from .structure import _sql_fit

CAP = 2500


@query
def transcript_events(spark: SparkSession, sf: str) -> DataFrame:
    """What is read of each transcript: events by type, human turns, images, tool uses and results, output tokens."""
    x = TR.events_of_lines(D.transcript_lines(spark, sf))
    kinds = lambda k: F.sum(F.size(F.filter("parts", lambda p: p["type"] == k))).cast("bigint")
    return x.groupBy("session_id").agg(
        F.count_if(F.col("type") == "user").alias("n_user"), F.count_if(F.col("type") == "assistant").alias("n_assistant"), F.count_if(F.col("type") == "system").alias("n_system"), F.count_if(F.col("type") == "pr-link").alias("n_links"),
        F.count_if(TR.is_human_turn()).alias("n_human"), F.sum(TR.n_images(F.col("parts"))).cast("bigint").alias("n_images"), kinds("tool_use").alias("n_calls"), kinds("tool_result").alias("n_results"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens"),
    )


oracle(
    "transcript_events",
    """WITH cv AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS x, (7 * conv_id + turn) % 8 AS k, conv_id + turn AS s FROM conversations WHERE role IN ('user', 'assistant')), f AS (SELECT *, role = 'assistant' AS a, k < 7 AND NOT (k = 3 AND c % 2 = 1) AS answered FROM cv)
    SELECT c AS session_id, (count_if(NOT a) + count_if(a AND answered))::BIGINT AS n_user, count_if(a)::BIGINT AS n_assistant, count_if(a AND (s % 11 = 5 OR s % 13 = 6))::BIGINT AS n_system, count_if(a AND s % 9 = 4 AND c % 3 = 0)::BIGINT AS n_links,
    count_if(NOT a AND x <> '' AND NOT starts_with(x, '<'))::BIGINT AS n_human, count_if(NOT a AND s % 5 = 0 AND x <> '')::BIGINT AS n_images, count_if(a AND k < 7)::BIGINT AS n_calls, count_if(a AND answered AND k < 6)::BIGINT AS n_results,
    coalesce(sum(length(x)) FILTER (a), 0)::BIGINT AS tokens FROM f GROUP BY 1""",
)


@query
def discover_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of team folders since a time, the earliest first."""
    events = TR.events_of_lines(D.transcript_lines(spark, sf).withColumn("session_id", F.concat(F.lit("s"), F.col("session_id").cast("string"))))
    return TU.discover(events, project="E", since="2023-11-14T22:15", allow=["s1", "s22", "s3", "s4", "s5"], limit=12)


oracle(
    "discover_sessions",
    """WITH u AS (SELECT conv_id AS c, turn AS t, conv_id + turn AS s, strftime(to_timestamp(1700000000 + turn * (100 + conv_id % 5 * 300)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts FROM conversations WHERE role = 'user'),
    n AS (SELECT conv_id AS c, sum(CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' THEN 1 + ((7 * conv_id + turn) % 8 < 7 AND NOT ((7 * conv_id + turn) % 8 = 3 AND conv_id % 2 = 1))::INT
      + ((conv_id + turn) % 11 = 5 OR (conv_id + turn) % 13 = 6)::INT + ((conv_id + turn) % 9 = 4 AND conv_id % 3 = 0)::INT ELSE 0 END)::BIGINT AS n_events FROM conversations GROUP BY 1),
    x AS (SELECT 's' || n.c AS session_id, CASE WHEN n.c % 3 > 0 AND count(u.c) > 0 THEN 'team' || n.c % 4 ELSE 'side' || n.c % 5 END AS project, '-home-u-side' || n.c % 5 AS project_dir,
      CASE WHEN n.c % 3 > 0 AND count(u.c) > 0 THEN '/home/u/team' || n.c % 4 || '/' ELSE '/home/u/side' || n.c % 5 END AS cwd, coalesce(arg_min(ts, t) FILTER (s % 6 > 0), '') AS started_at, coalesce(arg_max(ts, t) FILTER (s % 6 > 0), '') AS completed_at, any_value(n_events) AS n_events
      FROM n LEFT JOIN u ON n.c = u.c WHERE n_events > 0 GROUP BY n.c)
    SELECT * FROM x WHERE contains(lower(project), 'e') AND completed_at >= '2023-11-14T22:15' AND regexp_matches(session_id, '^(s1|s22|s3|s4|s5)') ORDER BY started_at, session_id LIMIT 12""",
)


@query
def transcript_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Test and build commands with the verdict of their results."""
    events, _ = D.transcript(spark, sf)
    runs = V.test_runs(events, V.tool_calls(events))
    return runs.select("session_id", "idx", F.shiftright("at", 20).alias("event_index"), "command", "verdict", "interrupted")


oracle("transcript_tests", f"WITH RECURSIVE {D.TRANSCRIPT} SELECT c AS session_id, ep AS idx, e AS event_index, cmd AS command, verdict, k = 6 AND c % 5 = 0 AS interrupted FROM tr")


@query
def evidence_all(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of evidence of the transcripts' episodes."""
    return V.evidence(*D.transcript(spark, sf))


oracle("evidence_all", f"WITH RECURSIVE {D.TRANSCRIPT} SELECT c AS session_id, ep AS idx, ord, signal, direction, weight, value, reason FROM te2")


@query
def episode_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each episode by role, with their images."""
    return E.turn_counts(D.transcript(spark, sf)[1])


oracle(
    "episode_turns",
    f"""WITH RECURSIVE {D.TRANSCRIPT} SELECT c AS session_id, ep AS idx, count(*) AS n_turns, count_if(role = 'correction')::BIGINT AS n_corrections, count_if(role = 'interruption')::BIGINT AS n_interruptions, count_if(role = 'approval')::BIGINT AS n_approvals,
    count_if(s % 5 = 0)::BIGINT AS n_images, left(arg_min({D.sql_trim('x')}, e), 200) AS first_prompt FROM tx WHERE role IS NOT NULL GROUP BY 1, 2""",
)


@query
def render_full(spark: SparkSession, sf: str) -> DataFrame:
    """The compact view with tool lines, evidence and, in every third session, a subagent."""
    events, turns = D.transcript(spark, sf)
    links = events.where("session_id % 3 = 0 and type = 'pr-link'").select(*V.KEYS, F.col("event_index").alias("ord"), F.lit("explorer").alias("agent_type"), F.lit("looks").alias("description"), F.lit(3).alias("tool_count"), F.lit("done").alias("outcome"))
    return E.render_full(events, F.col("human"), V.signals_block(V.evidence(events, turns)), V.subagents_block(links), CAP)


oracle(
    "render_full",
    f"""WITH RECURSIVE {D.TRANSCRIPT}, bl AS (
      SELECT c, ep, e, 0 AS n, 'USER: ' || left({D.sql_trim('x')}, 700) || CASE WHEN s % 5 = 0 THEN ' [image attached]' ELSE '' END AS line FROM tx WHERE role IS NOT NULL
      UNION ALL SELECT c, ep, e, 1, 'ASSISTANT: ' || left({D.sql_trim('x')}, 1000) FROM tx WHERE kind = 'assistant' AND s % 4 <> 3 AND {D.sql_trim('x')} <> ''
      UNION ALL SELECT c, ep, e, 2, '  [tool:' || tool || ' ' || left(input, 160) || ']' FROM tc),
    bb AS (SELECT c, ep, string_agg(line, chr(10) ORDER BY e, n) AS body FROM bl GROUP BY 1, 2),
    sb AS (SELECT c, ep, string_agg(signal || ' (' || direction || weight || '): ' || value || ' — ' || reason, chr(10) ORDER BY ord) AS lines FROM te2 GROUP BY 1, 2),
    ab AS (SELECT c, ep, string_agg('explorer: looks (tools=3, outcome=done)', chr(10)) AS lines FROM tx WHERE kind = 'pr-link' AND c % 3 = 0 GROUP BY 1, 2),
    x AS (SELECT k.c AS k1, k.ep AS k2, coalesce(body, '') AS t, '--- EVIDENCE SIGNALS ---' || chr(10) || coalesce(sb.lines, '(none)') || coalesce(chr(10) || chr(10) || '--- SUBAGENTS ---' || chr(10) || ab.lines, '') AS a
      FROM (SELECT DISTINCT c, ep FROM tx) k LEFT JOIN bb ON bb.c = k.c AND bb.ep = k.ep LEFT JOIN sb ON sb.c = k.c AND sb.ep = k.ep LEFT JOIN ab ON ab.c = k.c AND ab.ep = k.ep),
    r AS ({_sql_fit('t', 'a', CAP)}) SELECT k1 AS session_id, k2 AS idx, rendered FROM r""",
)


@query
def episode_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes over user texts, assistant texts and tool calls."""
    return E.content_hash(E.hash_parts(D.transcript(spark, sf)[0]))


oracle(
    "episode_hash",
    f"""WITH RECURSIVE {D.TRANSCRIPT}, p AS (
      SELECT c, ep, e, 0 AS n, 'USER:' || x AS part FROM tx WHERE kind = 'user' AND x <> '' UNION ALL SELECT c, ep, e, 1, 'A:' || x FROM tx WHERE kind = 'assistant' AND s % 4 <> 3
      UNION ALL SELECT c, ep, e, 2, 'T:' || tool || input FROM tc)
    SELECT c AS session_id, ep AS idx, sha256(string_agg(part, chr(10) ORDER BY e, n)) AS content_hash FROM p GROUP BY 1, 2""",
)
