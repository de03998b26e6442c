"""The driver's tables as the engine's inputs, in Spark and, as CTEs, in the oracle's SQL.

The tables hold no transcripts, so each is read as a stand-in:
TURNS - conversations are sessions, user rows human turns, assistant rows their context; a made
clock (turn x (100 + conv_id % 5 x 300) seconds) gives gaps on both sides of the limits.
EVENTS - users are sessions; signup opens a task, purchase is a human turn with a PR link, view a
Read and click an Edit of file k, error an API error; value is a view's seconds and a
purchase's tokens.
EPISODES - orders are labelled episodes of customers, their lines the workflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import episodes as E
from ..operators import mine as M
from ..operators import turns as TU
from ..sources import transcripts as TR


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turn_events(spark: SparkSession, sf: str) -> DataFrame:
    clock = F.col("turn") * (100 + F.col("conv_id") % 5 * 300)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), "role", F.coalesce("text", F.lit("")).alias("text"), clock.cast("double").alias("s"))


def _json(x: Column) -> Column:
    """A text as a JSON string."""
    made = F.to_json(F.struct(x.alias("v")))
    return F.substr(made, F.lit(6), F.length(made) - 6)


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as transcript lines (session_id, project_dir, line, raw), four to a turn.

    An assistant row of turn t in conversation c calls the tool k = (7 c + t) % 8 (7: none) and is
    followed by its result and, by s = c + t, by system events, PR links or a broken line.
    """
    x = table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("x"))
    k, s, c = (7 * F.col("c") + F.col("t")) % 8, F.col("c") + F.col("t"), F.col("c")
    said = F.concat(F.lit('{"type":"text","text":'), _json(F.col("x")), F.lit("}"))
    path = lambda n: F.concat(F.lit("/src/f"), (n % 2).cast("string"), F.lit(".py"))
    tool = F.when(k <= 1, F.concat(F.lit('"Bash","input":{"command":"cd app && pytest -q t'), c.cast("string"), F.lit('"}')))
    tool = tool.when(k <= 3, F.concat(F.when(k == 2, '"Read"').otherwise('"Edit"'), F.lit(',"input":{"file_path":"'), path(c), F.lit('"}')))
    tool = tool.when(k == 4, F.concat(F.lit('"Write","input":{"path":"'), path(F.col("t")), F.lit('"}')))
    tool = tool.when(k == 5, F.lit('"Bash","input":{"command":"gh pr create --fill"}')).when(k == 6, F.lit('"Bash","input":{"command":"make  all"}'))
    call = F.concat(F.lit('{"type":"tool_use","id":"'), c.cast("string"), F.lit("_"), F.col("t").cast("string"), F.lit('","name":'), tool, F.lit("}"))
    parts = F.concat_ws(",", F.when(s % 4 != 3, said), call)
    result = F.element_at(F.array(F.lit("2 failed, 3 passed"), F.lit("5 passed in 0.1s"), F.lit("1 error suppressed")), (s % 3 + 1).cast("int"))
    held = F.when(k == 1, F.concat(F.lit('[{"type":"text","text":'), _json(result), F.lit("}]"))).otherwise(_json(result))
    answer = F.when((k <= 5) & ~((k == 3) & (c % 2 == 1)), F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"'), c.cast("string"), F.lit("_"), F.col("t").cast("string"), F.lit('","content":'), held, F.lit("}]}}")))
    answer = answer.when(k == 6, F.concat(F.lit('{"type":"user","toolUseResult":{"stdout":"Build succeeded","stderr":"","interrupted":'), (c % 5 == 0).cast("string"), F.lit('},"message":{"content":"done"}}')))
    system = F.when(s % 11 == 5, F.lit('{"type":"system","subtype":"api_error"}')).when(s % 13 == 6, F.lit('{"type":"system","subtype":"compact_boundary"}')).when(s % 10 == 7, F.lit('{"type":"user", broken'))
    link = F.when((s % 9 == 4) & (c % 3 == 0), F.concat(F.lit('{"type":"pr-link","prUrl":"https://x/pr/'), c.cast("string"), F.lit('","prNumber":'), (c + 1).cast("string"), F.lit("}")))
    pictured = (s % 5 == 0) & (F.col("x") != "")
    content = F.when(pictured, F.concat(F.lit("["), said, F.lit(',{"type":"image"}]'))).otherwise(_json(F.col("x")))
    when = F.date_format(F.timestamp_seconds(1700000000 + F.col("t") * (100 + c % 5 * 300)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.concat(F.when(s % 6 > 0, F.concat(F.lit('"timestamp":"'), when, F.lit('",'))).otherwise(""), F.when(c % 3 > 0, F.concat(F.lit('"cwd":"/home/u/team'), (c % 4).cast("string"), F.lit('/",'))).otherwise(""))
    user = F.array(F.concat(F.lit('{"type":"user",'), stamp, F.lit('"message":{"role":"user","content":'), content, F.lit("}}")))
    assistant = F.array(F.concat(F.lit('{"type":"assistant","message":{"content":['), parts, F.lit('],"usage":{"output_tokens":'), F.length("x").cast("string"), F.lit("}}}")), answer, system, link)
    lines = x.select("c", "t", F.posexplode(F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant)).alias("n", "raw"))
    return lines.where("raw is not null").select(F.col("c").alias("session_id"), F.concat(F.lit("-home-u-side"), (F.col("c") % 5).cast("string")).alias("project_dir"), (F.col("t") * 4 + F.col("n")).alias("line"), "raw")


def transcript(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(events with idx and human, turns with idx) of transcript_lines; roles are those of the conversations."""
    events = TR.events_of_lines(transcript_lines(spark, sf)).withColumn("human", TR.is_human_turn())
    marks = roles(spark, sf).select("session_id", (F.col("event_index") * 4).alias("event_index"), "role")
    events = events.join(marks, ["session_id", "event_index"], "left")
    events = E.segment(events, F.coalesce(F.col("role") == "new_task", F.lit(False)), F.col("human"))
    return events, events.where("human").select("session_id", "idx", "event_index", "role", TR.user_text(F.col("parts")).alias("text"), TR.n_images(F.col("parts")).alias("n_images"))


TURNS = """
te AS (SELECT conv_id AS session_id, turn AS event_index, role, coalesce(text, '') AS text, (turn * (100 + conv_id % 5 * 300))::DOUBLE AS s FROM conversations),
hu AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_index) - 1 AS idx FROM te WHERE role = 'user' AND text <> '' AND NOT starts_with(text, '<')),
hg AS (SELECT *, coalesce(s - lag(s) OVER w, 'infinity'::DOUBLE) AS gap_s, coalesce(text = lag(text) OVER w, false) AS repeats FROM hu WINDOW w AS (PARTITION BY session_id ORDER BY idx))
"""


def human_turns(spark: SparkSession, sf: str) -> DataFrame:
    human = (F.col("role") == "user") & (F.col("text") != "") & ~F.col("text").startswith("<")
    return TU.with_gaps(TU.human_turns(turn_events(spark, sf), human), F.col("s"))


def roles(spark: SparkSession, sf: str) -> DataFrame:
    context = turn_events(spark, sf).where("role = 'assistant'").select("session_id", "event_index", T.keywords(F.col("text")).alias("words"))
    return TU.classify(human_turns(spark, sf).withColumn("n_images", F.lit(0)), context)


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_keywords(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9_./]+'), lambda w : length(w) >= 3 AND NOT list_contains({_list(T.STOPWORDS)}, w)))"


def sql_contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_role(x: str) -> str:
    t = sql_trim(f"lower({x})")
    norm = sql_trim(f"regexp_replace(lower({x}), '[\\s.!,]+$', '')")
    words = f"string_split_regex({norm}, '\\s+')"
    approval = f"(length({x}) BETWEEN 1 AND 40 AND (list_contains({_list(T.APPROVALS)}, {norm}) OR (length({norm}) <= 20 AND len({words}) <= 3 AND len(list_filter({words}, lambda w : NOT list_contains({_list(T.APPROVALS)}, w))) = 0)))"
    lines = f"string_split({x}, chr(10))"
    filled = f"list_filter({lines}, lambda l : {sql_trim('l')} <> '')"
    hard = " OR ".join(
        [
            sql_contains_any(f"lower({x})", T.LOG_TOKENS),
            f"len(list_filter({lines}, lambda l : regexp_matches(l, '[A-Za-z0-9_]+@[A-Za-z0-9_.-]+.*[%$]\\s') OR regexp_matches(l, '^\\s*\\$ '))) > 0",
            f"regexp_matches({x}, '\\n\\s*at\\s+[^\\s]+:[0-9]+') OR regexp_matches({x}, 'File \".*\", line [0-9]+')",
            f"len(list_filter({lines}, lambda l : regexp_matches({sql_trim('l')}, '^[-d][rwx-]{{9}}') OR regexp_matches(l, '\\b[0-9]{{2,}}%\\b.*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}'))) >= 2",
            f"len(list_filter({lines}, lambda l : len(string_split_regex({sql_trim('l')}, '\\s+')) >= 6 AND len(list_filter(string_split_regex({sql_trim('l')}, '\\s+'), lambda c : regexp_matches(c, '^[0-9][0-9.,%]*$'))) >= 4)) >= 2",
        ]
    )
    first = f"coalesce({filled}[1], '')"
    odd = f"len(list_filter({filled}, lambda l : NOT regexp_matches({sql_trim('l')}, '^[A-Za-z]')))"
    paste = (
        f"(length({x}) >= 60 AND CASE WHEN {hard} THEN NOT (contains({first}, '?') AND length({first}) < 120) "
        f"ELSE len({filled}) >= 4 AND {odd} >= 0.6 * len({filled}) AND NOT {sql_contains_any(f'lower({x})', T.REQUEST_CUES)} END)"
    )
    starts = " OR ".join("starts_with(" + t + ", '" + p.replace("'", "''") + "')" for p in T.CORRECTIONS)
    correction = f"({t} IN ('no', 'nope') OR {starts} OR regexp_matches({t}, '^still\\b'))"
    return f"CASE WHEN contains({x}, '{T.INTERRUPT_MARKER}') THEN 'interruption' WHEN {approval} THEN 'approval' WHEN {paste} THEN 'paste' WHEN {correction} THEN 'correction' ELSE 'new_task' END"


def sql_cue(x: str) -> str:
    t = sql_trim(f"lower({x})")
    return f"(regexp_matches({t}, '^(?:also|then|plus)\\b') OR regexp_matches({t}, '^and\\s+'))"


ROLES = f"""{TURNS},
ht AS (SELECT *, {sql_role('text')} AS role0, {sql_cue('text')} AS cue, {sql_keywords('text')} AS words, length(text) AS chars FROM hg),
cx AS (SELECT session_id, event_index, unnest({sql_keywords('text')}) AS word FROM te WHERE role = 'assistant'),
tw AS (SELECT session_id, event_index, unnest(words) AS word FROM ht),
ov AS (
  SELECT b.session_id, b.event_index AS last, t.event_index, count(DISTINCT tw.word) AS hits
  FROM ht b JOIN ht t ON b.session_id = t.session_id AND b.event_index < t.event_index
  JOIN cx ON cx.session_id = b.session_id AND cx.event_index >= b.event_index AND cx.event_index < t.event_index
  JOIN tw ON tw.session_id = b.session_id AND tw.event_index = t.event_index AND tw.word = cx.word GROUP BY ALL
),
fold AS (
  SELECT session_id, -1::BIGINT AS idx, -1::BIGINT AS event_index, -1::BIGINT AS last, '' AS role, '' AS classed FROM (SELECT DISTINCT session_id FROM ht)
  UNION ALL
  SELECT session_id, idx, event_index, CASE WHEN role = 'new_task' THEN event_index ELSE last END, role,
         CASE WHEN sure OR (NOT follows AND last >= 0 AND overlap >= 0.2) THEN 'heuristic' ELSE 'signal' END
  FROM (
    SELECT *, CASE WHEN sure THEN role0 WHEN follows THEN 'continuation' ELSE 'new_task' END AS role FROM (
      SELECT *, role0 <> 'new_task' AS sure,
             last >= 0 AND (cue OR (repeats AND chars > 0) OR (gap_s < 600 AND (overlap >= 0.2 OR chars <= 40)) OR (gap_s < 1800 AND overlap >= 0.6)) AS follows
      FROM (
        SELECT t.session_id, t.idx, t.event_index, f.last, t.role0, t.cue, t.repeats, t.chars, t.gap_s,
               CASE WHEN len(t.words) = 0 THEN 0 ELSE coalesce(ov.hits, 0) / len(t.words) END AS overlap
        FROM fold f JOIN ht t ON t.session_id = f.session_id AND t.idx = f.idx + 1
        LEFT JOIN ov ON ov.session_id = t.session_id AND ov.last = f.last AND ov.event_index = t.event_index)))
),
ro AS (SELECT session_id, idx, event_index, role, classed AS classified_by FROM fold WHERE idx >= 0)
"""


TRANSCRIPT = f"""{ROLES},
cv AS (SELECT conv_id AS c, turn AS t, role AS who, coalesce(text, '') AS x, (7 * conv_id + turn) % 8 AS k, conv_id + turn AS s FROM conversations),
tv AS (
  SELECT *, t * 4 AS e, 'user' AS kind FROM cv WHERE who = 'user'
  UNION ALL SELECT *, t * 4, 'assistant' FROM cv WHERE who = 'assistant'
  UNION ALL SELECT *, t * 4 + 1, 'result' FROM cv WHERE who = 'assistant' AND (k < 7 AND NOT (k = 3 AND c % 2 = 1))
  UNION ALL SELECT *, t * 4 + 2, CASE WHEN s % 11 = 5 THEN 'api_error' ELSE 'compact_boundary' END FROM cv WHERE who = 'assistant' AND (s % 11 = 5 OR s % 13 = 6)
  UNION ALL SELECT *, t * 4 + 3, 'pr-link' FROM cv WHERE who = 'assistant' AND s % 9 = 4 AND c % 3 = 0
),
tx AS (SELECT tv.*, ro.role, greatest(sum(coalesce(ro.role = 'new_task', false)::INT) OVER (PARTITION BY c ORDER BY e) - 1, 0)::BIGINT AS ep,
         CASE WHEN k <= 1 THEN 'Bash' WHEN k = 2 THEN 'Read' WHEN k = 3 THEN 'Edit' WHEN k = 4 THEN 'Write' WHEN k <= 6 THEN 'Bash' END AS tool,
         CASE WHEN k IN (2, 3) THEN '/src/f' || c % 2 || '.py' WHEN k = 4 THEN '/src/f' || t % 2 || '.py' END AS path,
         CASE WHEN k <= 1 THEN 'cd app && pytest -q t' || c WHEN k = 5 THEN 'gh pr create --fill' WHEN k = 6 THEN 'make  all' END AS cmd
       FROM tv LEFT JOIN ro ON ro.session_id = c AND ro.event_index * 4 = e WHERE c IN (SELECT session_id FROM ro)),
tc AS (SELECT *, CASE WHEN cmd IS NOT NULL THEN '{{"command":"' || cmd || '"}}' WHEN k = 4 THEN '{{"path":"' || path || '"}}' ELSE '{{"file_path":"' || path || '"}}' END AS input FROM tx WHERE kind = 'assistant' AND k < 7),
tr AS (SELECT c, ep, e, cmd, k, CASE WHEN k = 6 THEN CASE WHEN c % 5 = 0 THEN 'failed' ELSE 'passed' END WHEN s % 3 = 0 THEN 'failed' WHEN s % 3 = 1 THEN 'passed' END AS verdict FROM tc WHERE k IN (0, 1, 6)),
tt AS (SELECT c, ep, e, role, {sql_trim('x')} AS x, row_number() OVER (PARTITION BY c, ep ORDER BY e DESC) AS back FROM tx WHERE role IS NOT NULL),
ts AS (
  SELECT c, ep, 0 AS o, 'created_pr' AS signal, '+' AS direction, 'strong' AS weight, CASE WHEN bool_or(kind = 'pr-link') THEN 'https://x/pr/' || c ELSE 'gh pr create' END AS value,
    CASE WHEN bool_or(kind = 'pr-link') THEN 'pr-link event #' || (c + 1) ELSE '`gh pr create` Bash command' END AS reason FROM tx WHERE kind = 'pr-link' OR (kind = 'assistant' AND k = 5) GROUP BY c, ep
  UNION ALL SELECT c, ep, 1, 'explicit_user_approval', '+', 'strong', 'true', CASE WHEN bool_or(back <= 2 AND role = 'approval') THEN 'approval-role turn near episode end ("' || left(arg_min(x, e) FILTER (back <= 2 AND role = 'approval'), 40)
    ELSE 'praise in user turn ("' || left(arg_min(x, e) FILTER (praises), 40) END || '")' FROM (SELECT *, regexp_matches(x, '(?i)\\b(perfect|great|awesome|excellent|nice|lgtm|looks good|well done|thanks|thank you|amazing)\\b') AS praises FROM tt)
    GROUP BY c, ep HAVING bool_or(back <= 2 AND role = 'approval') OR bool_or(praises)
  UNION ALL SELECT c, ep, 2, 'explicit_user_rejection', '-', 'strong', 'true', 'correction turn rejecting work ("' || left(arg_min(x, e), 40) || '")' FROM tt
    WHERE role = 'correction' AND regexp_matches(x, '(?i)\\b(wrong|revert|undo|no\\b|not right|that''s not|incorrect|broke|broken)\\b') GROUP BY c, ep
  UNION ALL SELECT c, max(ep), 3, 'abandoned_mid_edit', '-', 'strong', 'true', 'episode ends on an unresolved tool_use with no following resolution' FROM tx GROUP BY c
    HAVING arg_max(kind = 'assistant' AND k < 7 AND (s % 4 = 3 OR {sql_trim('x')} = ''), e)
  UNION ALL SELECT c, ep, 4, 'test_' || verdict, CASE verdict WHEN 'failed' THEN '-' ELSE '+' END, 'medium', arg_min(regexp_replace(cmd, ' +', ' ', 'g'), e),
    CASE WHEN verdict = 'passed' THEN 'test/build output indicates pass' WHEN arg_min(k, e) = 6 THEN 'test/build command interrupted or errored' ELSE 'test/build output indicates failure' END FROM tr WHERE verdict IS NOT NULL GROUP BY c, ep, verdict
  UNION ALL SELECT c, ep, 6, 'n_corrections', '-', 'weak', count(*)::VARCHAR, count(*) || ' correction turn(s)' FROM tt WHERE role = 'correction' GROUP BY c, ep
  UNION ALL SELECT c, ep, 7, 'api_errors', '0', 'weak', count(*)::VARCHAR, count(*) || ' system/api_error event(s) — likely transient infra' FROM tx WHERE kind = 'api_error' GROUP BY c, ep
  UNION ALL SELECT c, ep, 8, 'compact_boundary', '-', 'weak', count(*)::VARCHAR, count(*) || ' compaction boundary(ies) — context overflow' FROM tx WHERE kind = 'compact_boundary' GROUP BY c, ep
  UNION ALL SELECT c, ep, 9, 'read_before_edit', '+', 'weak', arg_min(path, e), 'Read preceded Edit on ' || arg_min(path, e) FROM tc w
    WHERE tool IN ('Edit', 'Write') AND EXISTS (SELECT 1 FROM tc r WHERE r.c = w.c AND r.ep = w.ep AND r.e < w.e AND r.path = w.path AND r.tool = 'Read') GROUP BY c, ep
),
tf AS (SELECT c, ep, verdict, min(e) AS f FROM tr WHERE verdict IS NOT NULL GROUP BY ALL),
te2 AS (SELECT ts.*, row_number() OVER (PARTITION BY ts.c, ts.ep ORDER BY o, f) - 1 AS ord FROM ts LEFT JOIN tf ON tf.c = ts.c AND tf.ep = ts.ep AND ts.signal = 'test_' || tf.verdict)
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").alias("path"))
    e = e.withColumn("event_index", (F.row_number().over(order) - 1).cast("bigint"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        "session_id", "event_id", "ts", "event_index", "event_type", "value", "path", s.alias("s"),
        F.col("event_type").isin("signup", "purchase").alias("human"), (F.col("event_type") == "signup").alias("is_task"),
        F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").alias("name"),
    )


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return E.segment(events(spark, sf), F.col("is_task"), F.col("human"))


EVENTS = """
ev AS (SELECT user_id AS session_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index, event_type, value,
       json_extract_string(props, '$.k') AS path, epoch_us(ts) / 1e6 AS s, event_type IN ('signup', 'purchase') AS human,
       CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' END AS name FROM events),
sg AS (SELECT *, greatest(sum((event_type = 'signup')::INT) OVER (PARTITION BY session_id ORDER BY event_index) - 1, 0)::BIGINT AS idx
       FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE human))
"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled episodes; orders without lines are not judged."""
    days = (F.unix_micros(F.max("l_shipdate").cast("timestamp")) - F.unix_micros(F.min("l_shipdate").cast("timestamp"))) / 1e6
    flags = F.array_join(F.transform(F.array_sort("own"), lambda x: x["l_returnflag"]), ">")
    distinct = lambda c: F.size(F.array_distinct(F.array_compact(F.transform("own", lambda x: x[c])))).cast("bigint")
    # An order's lines are few: one list of them takes no copy of the lines for each count_distinct, and is built where they lie together.
    lines = table(spark, sf, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("episode_id")).agg(
        F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")).alias("own"), F.count_if(F.col("l_returnflag") == "R").alias("n_corrections"), F.count_if(F.col("l_linestatus") == "O").alias("n_interruptions"),
        days.alias("duration_s"),
    ).withColumns({"signature": flags, "n_files_read": distinct("l_partkey"), "n_files_edited": distinct("l_suppkey")}).drop("own")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("session_id"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    x = o.join(lines, "episode_id", "left")
    judged = F.col("signature").isNotNull()
    outcome = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").when(F.col("o_orderstatus") == "P", F.when(F.col("episode_id") % 5 == 0, "qa_only").otherwise("failed"))
    k = F.col("episode_id")
    return x.select(
        "episode_id", "session_id", k.alias("ord"), "o_orderdate",
        F.when(judged, F.col("o_orderpriority")).alias("task_type"), F.when(judged, outcome).alias("outcome"),
        F.lower(F.coalesce("signature", F.lit(""))).alias("signature"), F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"), F.coalesce("n_interruptions", F.lit(0)).alias("n_interruptions"),
        "duration_s", "n_files_read", "n_files_edited",
        F.concat(F.lit("order "), k.cast("string"), F.when(k % 997 == 0, " drop table x").when(k % 1009 == 0, " api_key here").otherwise("")).alias("first_prompt"),
        F.lower("signature").alias("tool_sequence"), (k % 3 == 0).alias("worth_codifying"),
        F.element_at(F.array(F.lit("skill"), F.lit("script"), F.lit("sop")), (F.col("session_id") % 3 + 1).cast("int")).alias("skill_type"),
        F.when(judged & (k % 4 == 0), k % 5 + 1).alias("efficiency"), F.when(judged & (k % 6 == 0), k % 7 % 5 + 1).alias("quality"),
    )


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return M.clustered(episodes(spark, sf))


EPISODES = """
li AS (SELECT l_orderkey AS episode_id, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag) AS signature, count_if(l_returnflag = 'R') AS n_corrections,
       count_if(l_linestatus = 'O') AS n_interruptions, (epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1e6 AS duration_s,
       count(DISTINCT l_partkey) AS n_files_read, count(DISTINCT l_suppkey) AS n_files_edited FROM lineitem GROUP BY 1),
ep AS (SELECT o_orderkey AS episode_id, o_custkey AS session_id, o_orderkey AS ord, o_orderdate,
       CASE WHEN signature IS NOT NULL THEN o_orderpriority END AS task_type,
       CASE WHEN signature IS NOT NULL THEN CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' WHEN 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'qa_only' ELSE 'failed' END END END AS outcome,
       lower(coalesce(signature, '')) AS signature, coalesce(n_corrections, 0)::BIGINT AS n_corrections, coalesce(n_interruptions, 0)::BIGINT AS n_interruptions, duration_s, n_files_read, n_files_edited,
       'order ' || o_orderkey || CASE WHEN o_orderkey % 997 = 0 THEN ' drop table x' WHEN o_orderkey % 1009 = 0 THEN ' api_key here' ELSE '' END AS first_prompt,
       lower(signature) AS tool_sequence, o_orderkey % 3 = 0 AS worth_codifying, ['skill', 'script', 'sop'][o_custkey % 3 + 1] AS skill_type,
       CASE WHEN signature IS NOT NULL AND o_orderkey % 4 = 0 THEN o_orderkey % 5 + 1 END AS efficiency,
       CASE WHEN signature IS NOT NULL AND o_orderkey % 6 = 0 THEN o_orderkey % 7 % 5 + 1 END AS quality
       FROM orders LEFT JOIN li ON o_orderkey = li.episode_id),
cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(task_type), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g'), '\\b([a-z0-9]{3,}[a-hj-rtv-z0-9])s\\b', '\\1', 'g') AS label,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(task_type), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g'), '\\b([a-z0-9]{3,}[a-hj-rtv-z0-9])s\\b', '\\1', 'g'), ' +', '-', 'g') AS cluster_id
       FROM ep WHERE task_type IS NOT NULL)
"""
