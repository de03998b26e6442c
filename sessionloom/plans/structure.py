"""Queries of the structure phase: sessions, turns, segmentation, features, evidence, privacy, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions import text as T
from ..operators import episodes as E
from ..operators import turns as TU
from . import bindings as D
from .registry import oracle, query

OPT_OUT = ["src1", "src7"]


@query
def episode_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    return D.segmented(spark, sf).groupBy("session_id", "idx").agg(F.min("event_index").alias("first_event"), F.max("event_index").alias("last_event"), F.count_if("human").alias("n_turns"))


oracle("episode_segmentation", f"WITH {D.EVENTS} SELECT session_id, idx, min(event_index) AS first_event, max(event_index) AS last_event, count_if(human)::BIGINT AS n_turns FROM sg GROUP BY 1, 2")


@query
def session_timespan(spark: SparkSession, sf: str) -> DataFrame:
    x = TU.session_spans(D.events(spark, sf))
    return x.select("session_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"), "n_events")


oracle(
    "session_timespan",
    f"WITH {D.EVENTS} SELECT session_id, strftime(arg_min(ts, event_index), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(arg_max(ts, event_index), '%Y-%m-%d %H:%M:%S') AS completed_at, count(*) AS n_events FROM ev GROUP BY 1",
)


@query
def session_filters(spark: SparkSession, sf: str) -> DataFrame:
    x = session_timespan(spark, sf).select(F.concat(F.lit("u"), F.col("session_id").cast("string")).alias("session_id"), F.concat(F.lit("Team-"), (F.col("session_id") % 4).cast("string")).alias("project"), "started_at", "completed_at")
    return TU.filter_sessions(x, project="team", since="2024-01-30 12", allow=["u1", "u22", "u3"], limit=25)


oracle(
    "session_filters",
    f"""WITH {D.EVENTS}, x AS (SELECT 'u' || session_id AS session_id, 'Team-' || (session_id % 4) AS project, strftime(arg_min(ts, event_index), '%Y-%m-%d %H:%M:%S') AS started_at,
    strftime(arg_max(ts, event_index), '%Y-%m-%d %H:%M:%S') AS completed_at FROM ev GROUP BY ev.session_id)
    SELECT * FROM x WHERE contains(lower(project), 'team') AND completed_at >= '2024-01-30 12' AND (starts_with(session_id, 'u1') OR starts_with(session_id, 'u22') OR starts_with(session_id, 'u3'))
    ORDER BY started_at, session_id LIMIT 25""",
)


@query
def project_name(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", TU.project_name(F.regexp_replace("url", "[?#].*$", "")).alias("project"))


oracle("project_name", "SELECT page_id, coalesce(nullif(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1], ''), 'unknown') AS project FROM pages")


@query
def human_turns(spark: SparkSession, sf: str) -> DataFrame:
    return D.human_turns(spark, sf).select("session_id", "idx", "event_index", F.length("text").cast("bigint").alias("char_len"))


oracle("human_turns", f"WITH {D.TURNS} SELECT session_id, idx, event_index, length(text) AS char_len FROM hg")


@query
def turn_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(F.col("gap_s") != float("inf"), F.col("gap_s"))
    return D.human_turns(spark, sf).select("session_id", "idx", gap.alias("gap_s"), "repeats")


oracle("turn_gaps", f"WITH {D.TURNS} SELECT session_id, idx, CASE WHEN gap_s < 'infinity'::DOUBLE THEN gap_s END AS gap_s, repeats FROM hg")


@query
def turn_roles_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    turns = D.human_turns(spark, sf).select(F.concat(F.lit("c"), F.col("session_id").cast("string"), F.lit("."), F.col("idx").cast("string")).alias("turn_id"), "text")
    docs = D.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("turn_id"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.union(docs).select("turn_id", T.heuristic_role(F.col("text"), F.lit(0)).alias("role"))


oracle(
    "turn_roles_heuristic",
    f"WITH {D.TURNS}, x AS (SELECT 'c' || session_id || '.' || idx AS turn_id, text FROM hg UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents) SELECT turn_id, {D.sql_role('text')} AS role FROM x",
)


@query
def turn_roles_fold(spark: SparkSession, sf: str) -> DataFrame:
    return D.roles(spark, sf)


oracle("turn_roles_fold", f"WITH RECURSIVE {D.ROLES} SELECT * FROM ro")


@query
def role_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return D.roles(spark, sf).groupBy("role", "classified_by").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


oracle("role_histogram", f"WITH RECURSIVE {D.ROLES} SELECT role, classified_by, count(*) AS n FROM ro GROUP BY 1, 2")


@query
def turn_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the classified sessions counted into episodes, with the first prompt of each."""
    turns = D.human_turns(spark, sf).select("session_id", "event_index", "text")
    x = E.segment(D.roles(spark, sf).join(turns, ["session_id", "event_index"]).drop("idx"), F.col("role") == "new_task", F.lit(True))
    return x.groupBy("session_id", "idx").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "correction").alias("n_corrections"), F.count_if(F.col("role") == "approval").alias("n_approvals"), F.left(F.min_by("text", "event_index"), F.lit(200)).alias("first_prompt")
    )


oracle(
    "turn_episodes",
    f"""WITH RECURSIVE {D.ROLES}, x AS (SELECT ro.*, text, greatest(sum((ro.role = 'new_task')::INT) OVER (PARTITION BY ro.session_id ORDER BY ro.event_index) - 1, 0)::BIGINT AS e
    FROM ro JOIN hg ON ro.session_id = hg.session_id AND ro.event_index = hg.event_index)
    SELECT session_id, e AS idx, count(*) AS n_turns, count_if(role = 'correction')::BIGINT AS n_corrections, count_if(role = 'approval')::BIGINT AS n_approvals, left(arg_min(text, event_index), 200) AS first_prompt FROM x GROUP BY 1, 2""",
)


@query
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.keywords(F.coalesce("text", F.lit("")))), " ").alias("keywords"))


oracle("keywords", f"SELECT doc_id, array_to_string(list_sort({D.sql_keywords(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}), ' ') AS keywords FROM documents")


@query
def tool_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return E.tool_sequence(D.segmented(spark, sf).where("name is not null"))


_SEQUENCE = """sq AS (SELECT session_id, idx, event_index, name FROM (SELECT *, lag(name) OVER (PARTITION BY session_id, idx ORDER BY event_index) AS before FROM sg WHERE name IS NOT NULL) WHERE before IS NULL OR name <> before),
ts AS (SELECT session_id, idx, array_to_string(CASE WHEN count(*) > 40 THEN list_append(list(name ORDER BY event_index)[1:40], '…') ELSE list(name ORDER BY event_index) END, '>') AS tool_sequence FROM sq GROUP BY 1, 2)"""
oracle("tool_sequence", f"WITH {D.EVENTS}, {_SEQUENCE} SELECT * FROM ts")


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    x = D.segmented(spark, sf)
    return x.select(
        "session_id", "idx", "event_index", "s", "human", "name", "path",
        ((F.col("name") == "Edit") & F.col("path").endswith("0")).alias("test"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("turn_s"),
        F.when(F.col("event_type") == "purchase", F.floor("value")).alias("tokens"),
    )


@query
def episode_features(spark: SparkSession, sf: str) -> DataFrame:
    return E.features(_feature_rows(spark, sf))


oracle(
    "episode_features",
    f"""WITH {D.EVENTS},
    gp AS (SELECT session_id, idx, s - lag(s) OVER (PARTITION BY session_id, idx ORDER BY s, event_index) AS gap FROM sg WHERE human),
    gi AS (SELECT session_id, idx, coalesce(sum(CASE WHEN gap > 60 THEN gap END), 0) AS idle FROM gp GROUP BY 1, 2),
    f AS (SELECT session_id, idx, count(name) AS n_tool_calls, count(DISTINCT CASE WHEN name = 'Read' THEN path END) AS n_files_read, count(DISTINCT CASE WHEN name = 'Edit' THEN path END) AS n_files_edited,
      coalesce(count_if(name = 'Edit' AND ends_with(path, '0')), 0)::BIGINT AS n_test_runs, sum(CASE WHEN event_type = 'view' THEN value END) AS own, arg_max(s, event_index) - arg_min(s, event_index) AS span,
      coalesce(sum(CASE WHEN event_type = 'purchase' THEN floor(value) END), 0)::BIGINT AS tokens FROM sg GROUP BY 1, 2)
    SELECT f.session_id, f.idx, n_tool_calls, n_files_read, n_files_edited, n_test_runs, round(coalesce(own, greatest(span, 0)), 2) AS duration_s,
      round(greatest(coalesce(idle, 0) - coalesce(own, 0), 0), 2) AS idle_s, tokens FROM f LEFT JOIN gi ON f.session_id = gi.session_id AND f.idx = gi.idx""",
)


@query
def read_before_edit(spark: SparkSession, sf: str) -> DataFrame:
    return E.read_before_edit(D.segmented(spark, sf).where("name is not null"))


_READ_FIRST = """re AS (SELECT e.session_id, e.idx, e.event_index, e.path FROM sg e WHERE e.name = 'Edit' AND EXISTS (SELECT 1 FROM sg r WHERE r.session_id = e.session_id AND r.idx = e.idx AND r.path = e.path AND r.name = 'Read' AND r.event_index < e.event_index)),
rb AS (SELECT session_id, idx, min(event_index) AS event_index, arg_min(path, event_index) AS path FROM re GROUP BY 1, 2)"""
oracle("read_before_edit", f"WITH {D.EVENTS}, {_READ_FIRST} SELECT * FROM rb")


@query
def abandoned_mid_edit(spark: SparkSession, sf: str) -> DataFrame:
    return E.last_is_open(D.segmented(spark, sf), F.coalesce(F.col("name") == "Edit", F.lit(False)))


_OPEN = "ab AS (SELECT session_id, max(idx) AS idx, max(event_index) AS event_index FROM sg GROUP BY 1 HAVING arg_max(event_type, event_index) = 'click')"
oracle("abandoned_mid_edit", f"WITH {D.EVENTS}, {_OPEN} SELECT * FROM ab")


@query
def next_result_asof(spark: SparkSession, sf: str) -> DataFrame:
    x = D.segmented(spark, sf)
    return x.withColumn("next_human", E.next_event(x, F.col("human"), "event_id")).where("name = 'Edit'").select("session_id", "idx", "event_id", "next_human")


oracle(
    "next_result_asof",
    f"""WITH {D.EVENTS}, n AS (SELECT *, first_value(CASE WHEN human THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id, idx ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_human FROM sg)
    SELECT session_id, idx, event_id, next_human FROM n WHERE name = 'Edit'""",
)


@query
def evidence_long(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the event episodes, one row a signal: PR, abandonment, errors, corrections, read before edit."""
    x = D.segmented(spark, sf)
    keys = E.EPISODE
    one = x.groupBy(*keys).agg(
        F.min_by("event_id", F.when(F.col("event_type") == "purchase", F.col("event_index"))).alias("pr"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    one = one.join(E.read_before_edit(x.where("name is not null")).select(*keys, "path"), keys, "left")
    ends = E.last_is_open(x, F.coalesce(F.col("name") == "Edit", F.lit(False))).select(*keys, F.lit(True).alias("open"))
    one = one.join(ends, keys, "left")
    rows = F.array(
        F.when(F.col("pr").isNotNull(), E.evidence_row("created_pr", "+", "strong", F.col("pr"), F.lit("pr-link event"))),
        F.when(F.col("open"), E.evidence_row("abandoned_mid_edit", "-", "strong", F.lit(True), F.lit("last event edits"))),
        F.when(F.col("errors") > 0, E.evidence_row("api_errors", "0", "weak", F.col("errors"), F.lit("api errors"))),
        F.when(F.col("path").isNotNull(), E.evidence_row("read_before_edit", "+", "weak", F.col("path"), F.lit("read, then edited"))),
    )
    out = one.select(*keys, F.posexplode(F.array_compact(rows)).alias("ord", "e"))
    return out.select(*keys, F.col("ord").cast("bigint").alias("ord"), "e.*")


oracle(
    "evidence_long",
    f"""WITH {D.EVENTS}, {_READ_FIRST}, {_OPEN},
    o AS (SELECT session_id, idx, arg_min(event_id, event_index) FILTER (event_type = 'purchase') AS pr, count_if(event_type = 'error')::BIGINT AS errors FROM sg GROUP BY 1, 2),
    u AS (SELECT session_id, idx, 0 AS k, 'created_pr' AS signal, '+' AS direction, 'strong' AS weight, pr::VARCHAR AS value, 'pr-link event' AS reason FROM o WHERE pr IS NOT NULL
      UNION ALL SELECT session_id, idx, 1, 'abandoned_mid_edit', '-', 'strong', 'true', 'last event edits' FROM ab
      UNION ALL SELECT session_id, idx, 2, 'api_errors', '0', 'weak', errors::VARCHAR, 'api errors' FROM o WHERE errors > 0
      UNION ALL SELECT session_id, idx, 3, 'read_before_edit', '+', 'weak', path, 'read, then edited' FROM rb)
    SELECT session_id, idx, row_number() OVER (PARTITION BY session_id, idx ORDER BY k) - 1 AS ord, signal, direction, weight, value, reason FROM u""",
)


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    part = F.concat(F.when(F.col("role") == "user", "USER:").otherwise("A:"), "text")
    x = D.turn_events(spark, sf).withColumn("idx", F.lit(0).cast("bigint"))
    return E.content_hash(x.select("session_id", "idx", "event_index", part.alias("part")))


oracle("content_hash", f"WITH {D.TURNS} SELECT session_id, 0::BIGINT AS idx, sha256(string_agg(CASE WHEN role = 'user' THEN 'USER:' ELSE 'A:' END || text, chr(10) ORDER BY event_index)) AS content_hash FROM te GROUP BY 1")


@query
def praise_and_rejection(spark: SparkSession, sf: str) -> DataFrame:
    x = D.human_turns(spark, sf)
    near_end = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("idx"))) <= 2
    return x.select("session_id", "idx", F.col("text").rlike(E.PRAISE).alias("praises"), F.col("text").rlike(E.REJECT).alias("rejects"), near_end.alias("near_end"))


oracle(
    "praise_and_rejection",
    f"""WITH {D.TURNS} SELECT session_id, idx, regexp_matches(text, '(?i)\\b(perfect|great|awesome|excellent|nice|lgtm|looks good|well done|thanks|thank you|amazing)\\b') AS praises,
    regexp_matches(text, '(?i)\\b(wrong|revert|undo|no\\b|not right|that''s not|incorrect|broke|broken)\\b') AS rejects, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) <= 2 AS near_end FROM hg""",
)


def _sql_rules(table: str, key: str, column: str) -> str:
    """The rules as a chain of CTEs s0, s1, ... over (key, t), each with its hit flag."""
    out = [f"s0 AS (SELECT {key}, coalesce({column}, '') AS t FROM {table})"]
    for i, (_, pattern, mask) in enumerate(P.RULES):
        re2 = pattern.replace(T.B, "\\b").replace(T.S, "\\s").replace("(?iu)", "(?i)").replace("'", "''")
        flags = ", ".join(f"h{j}" for j in range(i))
        new = f"regexp_replace(t, '{re2}', '{mask}', 'g')"
        out.append(f"s{i + 1} AS (SELECT {key}, {flags}{', ' if flags else ''}t <> {new} AS h{i}, {new} AS t FROM s{i})")
    return ", ".join(out)


_RULES = _sql_rules("documents", "doc_id", "text")
_LAST = len(P.RULES)
_HITS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN h{i} THEN '{n}' END" for i, (n, _, _) in enumerate(P.RULES)) + "], lambda x : x IS NOT NULL), ',')"
_STRONG = " + ".join(f"h{i}::BIGINT" for i in range(len(P.CREDENTIAL_RULES), _LAST))
_CREDENTIAL = " OR ".join(f"h{i}" for i in range(len(P.CREDENTIAL_RULES)))


@query
def privacy_redaction(spark: SparkSession, sf: str) -> DataFrame:
    x = P.sanitize(D.table(spark, sf, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.sha2("clean_text", 256).alias("clean_sha256"), F.array_join("hits", ",").alias("hits"), "had_credential", "n_strong_pii")


oracle("privacy_redaction", f"WITH {_RULES} SELECT doc_id, sha256(t) AS clean_sha256, {_HITS} AS hits, {_CREDENTIAL} AS had_credential, {_STRONG} AS n_strong_pii FROM s{_LAST}")


@query
def privacy_audit(spark: SparkSession, sf: str) -> DataFrame:
    x = P.sanitize(D.table(spark, sf, "documents").select("doc_id", "text"))
    return x.agg(F.sum(F.size("hits")).cast("bigint").alias("n_hits"), F.sum("n_strong_pii").alias("n_strong_pii"), F.count_if("had_credential").alias("n_with_credential"))


oracle(
    "privacy_audit",
    f"WITH {_RULES} SELECT sum({' + '.join(f'h{i}::BIGINT' for i in range(_LAST))})::BIGINT AS n_hits, sum({_STRONG})::BIGINT AS n_strong_pii, count_if({_CREDENTIAL})::BIGINT AS n_with_credential FROM s{_LAST}",
)


@query
def optout_partition(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", P.opted_out(F.col("source"), OPT_OUT).alias("reason")).withColumn("kept", F.col("reason").isNull())


oracle("optout_partition", "SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 'src1' WHEN contains(lower(source), 'src7') THEN 'src7' END AS reason, NOT coalesce(contains(lower(source), 'src1') OR contains(lower(source), 'src7'), false) AS kept FROM documents")


@query
def render_elided(spark: SparkSession, sf: str) -> DataFrame:
    fitted = E.fit_within_cap(F.coalesce("text", F.lit("")), F.concat(F.lit("source "), F.coalesce("source", F.lit("?"))), 2000)
    return D.table(spark, sf, "documents").select("doc_id", fitted.alias("rendered"))


def _sql_fit(body: str, appended: str, cap: int) -> str:
    return f"""SELECT k1, k2, CASE WHEN length(body || sep) <= {cap} THEN body || sep WHEN budget < 0 THEN left(body || sep, {cap})
    ELSE left(left(body, head) || chr(10) || '… [' || (n - head - tail) || ' chars elided] …' || chr(10) || right(body, tail) || sep, {cap}) END AS rendered FROM (
    SELECT *, (CASE WHEN fits THEN share ELSE floor(rest / 2) END)::BIGINT AS head, (CASE WHEN fits THEN share ELSE rest - floor(rest / 2) END)::BIGINT AS tail FROM (
    SELECT *, 2 * share + mark <= budget AS fits, greatest(budget - mark, 0) AS rest FROM (
    SELECT *, length(body) AS n, {cap} - length(sep) AS budget, floor(({cap} - length(sep)) * 0.4) AS share, length(length(body)::VARCHAR) + length('… [ chars elided] …') + 2 AS mark FROM (
    SELECT *, {body} AS body, CASE WHEN {appended} = '' THEN '' ELSE chr(10) || chr(10) || {appended} END AS sep FROM x))))"""


oracle(
    "render_elided",
    f"WITH x AS (SELECT doc_id AS k1, 0 AS k2, coalesce(text, '') AS t, 'source ' || coalesce(source, '?') AS a FROM documents), r AS ({_sql_fit('t', 'a', 2000)}) SELECT k1 AS doc_id, rendered FROM r",
)


@query
def render_episode(spark: SparkSession, sf: str) -> DataFrame:
    x = D.turn_events(spark, sf).withColumn("idx", F.lit(0).cast("bigint"))
    return E.render(x.select("session_id", "idx", "event_index", "role", "text"), 1500)


oracle(
    "render_episode",
    f"""WITH {D.TURNS}, l AS (SELECT session_id, event_index, CASE WHEN {D.sql_trim('text')} = '' THEN NULL WHEN role = 'user' AND NOT starts_with({D.sql_trim('text')}, '<') THEN 'USER: ' || left({D.sql_trim('text')}, 700)
      WHEN role = 'assistant' THEN 'ASSISTANT: ' || left({D.sql_trim('text')}, 1000) END AS line FROM te),
    x AS (SELECT session_id AS k1, 0 AS k2, coalesce(string_agg(line, chr(10) ORDER BY event_index), '') AS t, '--- EVIDENCE SIGNALS ---' || chr(10) || '(none)' AS a FROM l GROUP BY 1),
    r AS ({_sql_fit('t', 'a', 1500)}) SELECT k1 AS session_id, 0::BIGINT AS idx, rendered FROM r""",
)
