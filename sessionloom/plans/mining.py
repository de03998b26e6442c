"""Queries over labelled episodes: clusters, report, checks, calibration, convergence, drafting, storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import converge as C
from ..operators import draft as G
from ..operators import episodes as E
from ..operators import mine as M
from ..operators import report as R
from ..operators import store as S
from ..operators import trust as Q
from ..operators import turns as TU
from . import bindings as D
from .registry import ORACLES, oracle, query

J = "outcome IN ('success', 'partial', 'failed', 'abandoned')"
RATE = "CASE WHEN n_judged > 0 THEN n_success / n_judged ELSE 0 END"


@query
def task_normalize(spark: SparkSession, sf: str) -> DataFrame:
    names = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("raw"))
    words = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.js_trim(F.coalesce("text", F.lit(""))).alias("raw"))
    label = T.normalize_task_type(F.col("raw"))
    return names.union(words).select("id", "raw", label.alias("label"), T.slugify(label).alias("slug"))


def _sql_normalize(x: str) -> str:
    base = f"trim(regexp_replace(regexp_replace(regexp_replace({D.sql_trim(f'lower({x})')}, '[_/]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g'))"
    single = f"regexp_replace({base}, '\\b([a-z0-9]{{3,}}[a-hj-rtv-z0-9])s\\b', '\\1', 'g')"
    cases = " ".join(f"WHEN regexp_matches({single}, '{p}') THEN '{n}'" for p, n in T.TASK_TYPES)
    return f"CASE WHEN {base} = '' THEN 'uncategorized' {cases} ELSE {single} END"


def _sql_slug(x: str) -> str:
    s = f"regexp_replace(regexp_replace(trim(lower({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'uncategorized' ELSE {s} END"


oracle(
    "task_normalize",
    f"""WITH x AS (SELECT p_partkey AS id, p_type AS raw FROM part UNION ALL SELECT doc_id, {D.sql_trim("coalesce(text, '')")} FROM documents),
    y AS (SELECT id, raw, {_sql_normalize('raw')} AS label FROM x) SELECT id, raw, label, {_sql_slug('label')} AS slug FROM y""",
)


@query
def cluster_components(spark: SparkSession, sf: str) -> DataFrame:
    return M.ranked(M.components(D.clusters(spark, sf)))


_COMPONENTS = f"""cc AS (SELECT cluster_id, count(*) AS frequency, count(DISTINCT session_id) AS n_sessions, count_if({J})::BIGINT AS n_judged, count_if(outcome = 'success')::BIGINT AS n_success,
    coalesce(median(n_corrections + n_interruptions), 0)::DOUBLE AS median_friction, coalesce(median(duration_s), 0) AS d FROM cl GROUP BY 1)"""
oracle(
    "cluster_components",
    f"""WITH {D.EPISODES}, {_COMPONENTS} SELECT cluster_id, frequency, n_sessions, n_judged, round({RATE}, 4) AS success_rate, round((n_success + 1) / (n_judged + 2), 4) AS laplace_rate,
    n_judged < 5 AS low_confidence, median_friction, round(d * frequency)::BIGINT AS est_effort_s FROM cc""",
)


@query
def dominant_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return M.dominant_pattern(D.clusters(spark, sf))


_PATTERN = """dp AS (SELECT cluster_id, arg_max(signature, (n, -first)) AS dominant_pattern, max(n) AS pattern_n, sum(n)::BIGINT AS n_patterns FROM (
    SELECT cluster_id, signature, count(*) AS n, min(ord) AS first FROM cl WHERE outcome = 'success' AND signature <> '' GROUP BY 1, 2) GROUP BY 1)"""
oracle("dominant_pattern", f"WITH {D.EPISODES}, {_PATTERN} SELECT *, n_patterns >= 3 AND pattern_n / n_patterns >= 0.5 AS stable FROM dp")


@query
def intervention(spark: SparkSession, sf: str) -> DataFrame:
    return M.intervention(D.clusters(spark, sf))


_INTERVENTION = f"""iv AS (SELECT cluster_id, CASE WHEN worth_codifying AND skill_type IN ('skill', 'script', 'sop') THEN skill_type END AS vote, count(*) AS n, min(ord) AS first,
    count_if({J})::BIGINT AS j, count_if(outcome = 'success')::BIGINT AS s FROM cl GROUP BY 1, 2),
ic AS (SELECT cluster_id, sum(j)::BIGINT AS n_judged, sum(s)::BIGINT AS n_success, coalesce(sum(n) FILTER (vote IS NOT NULL), 0)::BIGINT AS votes, arg_max(vote, (n, -first)) FILTER (vote IS NOT NULL) AS best FROM iv GROUP BY 1),
it AS (SELECT cluster_id, votes, CASE WHEN n_judged < 3 OR {RATE} < 0.34 OR votes < 2 THEN 'none' ELSE best END AS intervention FROM ic)"""
oracle("intervention", f"WITH {D.EPISODES}, {_INTERVENTION} SELECT * FROM it")


@query
def risk_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.kept(D.clusters(spark, sf).select("cluster_id", "ord", "first_prompt", "tool_sequence", "n_files_edited", "n_files_read", "n_corrections"))
    said = F.when(F.col("ord") % 3 == 0, "they git push").when(F.col("ord") % 3 == 1, "  ").otherwise("--force it")
    return M.risk_flags(rows, rows.where("ord % 512 < 3 and n_corrections = 0").select("cluster_id", "ord", said.alias("text")))


_RISKS = ", ".join(
    f"CASE WHEN regexp_matches(blob, '{p.replace(T.B, chr(92) + 'b')}') THEN '{k}: {n}' END" for rules, k in ((M.DESTRUCTIVE, "destructive"), (M.SENSITIVE, "sensitive")) for p, n in rules
)
oracle(
    "risk_flags",
    f"""WITH {D.EPISODES}, v AS (SELECT cluster_id, string_agg(CASE ord % 3 WHEN 0 THEN 'they git push' WHEN 1 THEN '  ' ELSE '--force it' END, chr(10) ORDER BY ord) AS said FROM cl WHERE ord % 512 < 3 AND n_corrections = 0 GROUP BY 1),
    b AS (SELECT cl.cluster_id, string_agg(first_prompt || coalesce(chr(10) || nullif(tool_sequence, ''), ''), chr(10) ORDER BY ord) || coalesce(chr(10) || any_value(said), '') AS blob, sum(n_files_edited) AS edited, sum(n_files_read) AS read
      FROM cl LEFT JOIN v ON cl.cluster_id = v.cluster_id GROUP BY 1)
    SELECT cluster_id, array_to_string(list_filter([{_RISKS}, CASE WHEN edited >= 5 AND edited > 2 * coalesce(read, 0) THEN 'write-heavy (edits >> reads)' END], lambda x : x IS NOT NULL), '; ') AS risk_flags FROM b""",
)


@query
def panel_medians(spark: SparkSession, sf: str) -> DataFrame:
    return M.panel_medians(D.clusters(spark, sf))


oracle(
    "panel_medians",
    f"WITH {D.EPISODES} SELECT cluster_id, median(efficiency)::DOUBLE AS median_efficiency, median(quality)::DOUBLE AS median_quality, count_if(efficiency IS NOT NULL OR quality IS NOT NULL)::BIGINT AS n_panel FROM cl GROUP BY 1",
)


@query
def contrast(spark: SparkSession, sf: str) -> DataFrame:
    return M.contrast(D.clusters(spark, sf))


oracle(
    "contrast",
    f"""WITH {D.EPISODES}, s AS (SELECT cluster_id, CASE WHEN outcome = 'success' THEN 'success' WHEN outcome IN ('failed', 'abandoned', 'partial') THEN 'fail' END AS side, signature FROM cl),
    c AS (SELECT cluster_id, side, signature, count(*) AS n FROM s WHERE side IS NOT NULL AND signature <> '' GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY cluster_id, side ORDER BY n DESC, signature) AS place FROM c""",
)


@query
def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return M.exemplars(D.clusters(spark, sf))


oracle(
    "exemplars",
    f"""WITH {D.EPISODES}, x AS (SELECT *, n_corrections + n_interruptions AS fr FROM cl), g AS (SELECT cluster_id, arg_min(episode_id, (fr, ord)) AS good FROM x WHERE outcome = 'success' GROUP BY 1),
    t AS (SELECT x.cluster_id, episode_id, ord, fr, CASE WHEN outcome IN ('failed', 'abandoned') THEN 0 WHEN outcome = 'partial' THEN 1 WHEN fr > 0 THEN 2 END AS tier FROM x LEFT JOIN g ON x.cluster_id = g.cluster_id WHERE episode_id IS DISTINCT FROM good),
    b AS (SELECT cluster_id, arg_min(episode_id, (tier, -fr, ord)) AS bad FROM t WHERE tier IS NOT NULL GROUP BY 1)
    SELECT k.cluster_id, good, bad FROM (SELECT DISTINCT cluster_id FROM cl) k LEFT JOIN g ON k.cluster_id = g.cluster_id LEFT JOIN b ON k.cluster_id = b.cluster_id""",
)


@query
def thin_split(spark: SparkSession, sf: str) -> DataFrame:
    # Clusters of one customer and priority each, so that many are thin.
    own = D.clusters(spark, sf).withColumn("cluster_id", F.concat_ws("-", F.col("session_id").cast("string"), "cluster_id"))
    return M.thin_split(M.components(own)).select("cluster_id", "frequency", "n_judged", "thin")


oracle(
    "thin_split",
    f"WITH {D.EPISODES}, x AS (SELECT session_id || '-' || cluster_id AS cluster_id, outcome FROM cl) SELECT cluster_id, count(*) AS frequency, count_if({J})::BIGINT AS n_judged, count(*) < 3 OR count_if({J}) < 3 AS thin FROM x GROUP BY 1",
)


@query
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return M.totals(D.episodes(spark, sf))


oracle(
    "corpus_totals",
    f"""WITH {D.EPISODES}, t AS (SELECT count(DISTINCT session_id) AS n_sessions, count(*) AS n_episodes, count(task_type) AS n_labeled, count_if({J})::BIGINT AS n_judged, count_if(outcome = 'success')::BIGINT AS n_success FROM ep)
    SELECT *, round({RATE}, 4) AS success_rate FROM t""",
)


def _store(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The stored tables of the order episodes, with faults where keys are of certain remainders."""
    e = D.episodes(spark, sf)
    k = F.col("episode_id")
    episodes = e.where(k % 1013 != 0).select(
        "episode_id", F.when(k % 911 == 0, -k).otherwise(F.col("session_id")).alias("session_id"), F.when(k % 701 == 0, 0).otherwise(1).alias("n_turns"),
        F.when(k % 503 == 0, "").otherwise(F.col("first_prompt")).alias("first_prompt"), F.when(k % 401 == 0, None).otherwise(F.sha2("first_prompt", 256)).alias("content_hash"),
    )
    counts = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_episodes"))
    sessions = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id")).join(counts, "session_id", "left").select("session_id", F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"))
    features = e.where(k % 601 != 0).select("episode_id", F.when(k % 809 == 0, -1.0).otherwise(F.col("duration_s")).alias("duration_s"), F.lit(0.0).alias("idle_s"))
    return {"sessions": sessions, "turns": e.select("episode_id"), "episodes": episodes, "features": features, "labels": e.where("task_type is not null").select("episode_id", "outcome")}


@query
def check_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return Q.invariants(**_store(spark, sf))


_STORE = """se AS (SELECT episode_id, CASE WHEN episode_id % 911 = 0 THEN -episode_id ELSE session_id END AS session_id, CASE WHEN episode_id % 701 = 0 THEN 0 ELSE 1 END AS n_turns,
    CASE WHEN episode_id % 503 = 0 THEN '' ELSE first_prompt END AS first_prompt, CASE WHEN episode_id % 401 = 0 THEN NULL ELSE sha256(first_prompt) END AS content_hash FROM ep WHERE episode_id % 1013 <> 0),
sn AS (SELECT c_custkey AS session_id, count(ep.episode_id) AS n_episodes FROM customer LEFT JOIN ep ON c_custkey = ep.session_id GROUP BY 1),
fe AS (SELECT episode_id, CASE WHEN episode_id % 809 = 0 THEN -1 ELSE duration_s END AS duration_s FROM ep WHERE episode_id % 601 <> 0)"""
oracle(
    "check_invariants",
    f"""WITH {D.EPISODES}, {_STORE}
    SELECT 'zero_turn_episodes' AS "check", count(*) AS n FROM se WHERE n_turns = 0 UNION ALL SELECT 'empty_first_prompt', count(*) FROM se WHERE coalesce(first_prompt, '') = ''
    UNION ALL SELECT 'empty_content_hash', count(*) FROM se WHERE coalesce(content_hash, '') = ''
    UNION ALL SELECT 'episodes_missing_features', count(*) FROM se LEFT JOIN fe ON se.episode_id = fe.episode_id WHERE fe.episode_id IS NULL
    UNION ALL SELECT 'orphan_turns', count(*) FROM ep WHERE episode_id NOT IN (SELECT episode_id FROM se)
    UNION ALL SELECT 'orphan_episodes', count(*) FROM se WHERE session_id NOT IN (SELECT session_id FROM sn)
    UNION ALL SELECT 'n_episodes_mismatch', count(*) FROM sn WHERE n_episodes <> (SELECT count(*) FROM se WHERE se.session_id = sn.session_id)
    UNION ALL SELECT 'negative_durations', count(*) FROM fe WHERE duration_s < 0
    UNION ALL SELECT 'orphan_labels', count(*) FROM ep WHERE task_type IS NOT NULL AND episode_id NOT IN (SELECT episode_id FROM se)""",
)


@query
def turns_per_episode(spark: SparkSession, sf: str) -> DataFrame:
    x = D.segmented(spark, sf).where("human").groupBy("session_id", "idx").agg(F.count(F.lit(1)).alias("n_turns"))
    return x.groupBy("n_turns").agg(F.count(F.lit(1)).alias("n_episodes"))


oracle("turns_per_episode", f"WITH {D.EVENTS}, x AS (SELECT session_id, idx, count(*) AS n_turns FROM sg WHERE human GROUP BY 1, 2) SELECT n_turns, count(*) AS n_episodes FROM x GROUP BY 1")


@query
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    x = D.segmented(spark, sf).where("human").groupBy("session_id", "idx").agg(F.count(F.lit(1)).alias("n_turns"))
    out = x.agg(F.count(F.lit(1)).alias("n_episodes"), F.round(F.avg("n_turns"), 2).alias("mean_turns"), F.max("n_turns").alias("max_turns"), F.round(F.avg((F.col("n_turns") == 1).cast("double")), 4).alias("singleton_share"))
    return out.withColumn("drift_percent", Q.drift(F.col("mean_turns"), 2.11))


oracle(
    "split_statistics",
    f"""WITH {D.EVENTS}, x AS (SELECT session_id, idx, count(*) AS n_turns FROM sg WHERE human GROUP BY 1, 2),
    y AS (SELECT count(*) AS n_episodes, round(avg(n_turns), 2) AS mean_turns, max(n_turns) AS max_turns, round(avg((n_turns = 1)::INT), 4) AS singleton_share FROM x) SELECT *, round(100 * (mean_turns - 2.11) / 2.11, 1) AS drift_percent FROM y""",
)

_STRATA = {"outcome:success": "outcome = 'success'", "outcome:partial": "outcome = 'partial'", "outcome:failed": "outcome = 'failed'", "outcome:abandoned": "outcome = 'abandoned'",
           "high-error": "n_corrections >= 4", "no-test": "coalesce(n_files_read, 0) % 2 = 0", "pr-created": "worth_codifying", "image-heavy": "episode_id % 50 = 0", "subagent-heavy": "n_interruptions >= 5"}


def _members(spark: SparkSession, sf: str) -> DataFrame:
    labelled = D.episodes(spark, sf).where("task_type is not null")
    return Q.strata(labelled, {k: F.expr(v) for k, v in _STRATA.items()})


@query
def strata_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode_id").alias("n_distinct"))


_MEMBERS = "me AS (" + " UNION ALL ".join(f"SELECT *, {i} AS stratum_k, '{k}' AS stratum FROM ep WHERE task_type IS NOT NULL AND {v}" for i, (k, v) in enumerate(_STRATA.items())) + ")"
oracle("strata_flags", f"WITH {D.EPISODES}, {_MEMBERS} SELECT stratum, count(*) AS n, count(DISTINCT episode_id) AS n_distinct FROM me GROUP BY 1")


@query
def stratified_draw(spark: SparkSession, sf: str) -> DataFrame:
    return Q.stratified_draw(_members(spark, sf), 40, seed=7)


oracle(
    "stratified_draw",
    f"""WITH RECURSIVE {D.EPISODES}, {_MEMBERS}, l AS (SELECT stratum_k, stratum, list(episode_id ORDER BY md5(episode_id || ':7'), episode_id) AS ids FROM me GROUP BY 1, 2),
    a AS (SELECT list(ids ORDER BY stratum_k) AS ls, list(stratum ORDER BY stratum_k) AS names FROM l),
    d AS (SELECT 0 AS i, []::BIGINT[] AS taken, []::VARCHAR[] AS who UNION ALL
      SELECT i + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, CASE WHEN pick IS NULL THEN who ELSE list_append(who, name) END FROM (
        SELECT i, taken, who, names[i % len(ls) + 1] AS name, list_filter(ls[i % len(ls) + 1], lambda x : NOT list_contains(taken, x))[1] AS pick FROM d, a WHERE len(taken) < 40 AND i < 40 * len(ls)))
    SELECT taken[k] AS episode_id, who[k] AS stratum FROM (SELECT taken, who FROM d ORDER BY i DESC LIMIT 1), range(1, len(taken) + 1) t(k)""",
)


def _calibration(x: DataFrame) -> DataFrame:
    k = F.col("episode_id")
    human = Q.human_outcome(F.when(k % 11 == 0, "partial"), F.when(k % 4 < 3, k % 4 > 0), F.col("outcome"))
    return x.withColumn("human_outcome", human).withColumn("agrees", F.when(k % 4 < 3, F.col("human_outcome").eqNullSafe(F.col("outcome"))))


@query
def stratum_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return Q.agreement(_calibration(_members(spark, sf)))


_CALIBRATION = """*, CASE WHEN episode_id % 11 = 0 THEN 'partial' WHEN episode_id % 4 IN (1, 2) THEN outcome END AS human_outcome,
    CASE WHEN episode_id % 4 < 3 THEN (CASE WHEN episode_id % 11 = 0 THEN 'partial' WHEN episode_id % 4 IN (1, 2) THEN outcome END) IS NOT DISTINCT FROM outcome END AS agrees"""
oracle(
    "stratum_agreement",
    f"""WITH {D.EPISODES}, {_MEMBERS}, c AS (SELECT {_CALIBRATION} FROM me), g AS (SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS n, count_if(agrees)::BIGINT AS n_agree, count_if(agrees IS NULL)::BIGINT AS n_open FROM c GROUP BY ROLLUP (stratum))
    SELECT *, round(CASE WHEN n - n_open > 0 THEN n_agree / (n - n_open) END, 4) AS rate FROM g""",
)


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.episodes(spark, sf).where("task_type is not null")
    return Q.confusion(_calibration(labels).select("episode_id", "human_outcome"), labels)


oracle("confusion", f"WITH {D.EPISODES}, c AS (SELECT {_CALIBRATION} FROM ep WHERE task_type IS NOT NULL) SELECT outcome, human_outcome, count(*) AS n FROM c WHERE human_outcome IS NOT NULL GROUP BY 1, 2")


@query
def cross_check(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf).where("task_type is not null")
    kinds = F.array(
        F.when(F.col("n_corrections") >= 3, "explicit_user_rejection"), F.when(F.col("n_interruptions") >= 5, "abandoned_mid_edit"),
        F.when(F.col("n_corrections") == 0, "created_pr"), F.when(F.col("n_interruptions") == 0, "explicit_user_approval"),
    )
    return Q.cross_check(e.select("episode_id", "outcome"), e.select("episode_id", F.explode(F.array_compact(kinds)).alias("signal")))


oracle(
    "cross_check",
    f"""WITH {D.EPISODES}, x AS (SELECT episode_id, outcome, array_to_string(list_filter([CASE WHEN outcome = 'success' AND n_corrections >= 3 THEN 'explicit_user_rejection' END, CASE WHEN outcome = 'success' AND n_interruptions >= 5 THEN 'abandoned_mid_edit' END,
    CASE WHEN outcome = 'failed' AND n_corrections = 0 THEN 'created_pr' END, CASE WHEN outcome = 'failed' AND n_interruptions = 0 THEN 'explicit_user_approval' END], lambda x : x IS NOT NULL), '+') AS reason FROM ep WHERE task_type IS NOT NULL)
    SELECT * FROM x WHERE reason <> ''""",
)


@query
def self_consistency(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf).where("task_type is not null")
    again = e.where("episode_id % 3 = 0").select("episode_id", F.when(F.col("episode_id") % 9 == 0, "partial").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("episode_id") % 21 == 0, "timeout").alias("error"))
    return Q.self_consistency(e, again)


oracle(
    "self_consistency",
    f"""WITH {D.EPISODES}, a AS (SELECT outcome, CASE WHEN episode_id % 9 = 0 THEN 'partial' ELSE outcome END AS again, episode_id % 21 = 0 AS bad FROM ep WHERE task_type IS NOT NULL AND episode_id % 3 = 0)
    SELECT count_if(NOT bad)::BIGINT AS n_checked, count_if(NOT bad AND again = outcome)::BIGINT AS n_matched, count_if(bad)::BIGINT AS n_errors FROM a""",
)


# ------------------------------------------------------------ convergence


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate for each market segment and order priority of a region."""
    x = D.table(spark, sf, "orders").join(D.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(D.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.concat_ws(" ", "c_mktsegment", F.when(F.col("r_regionkey") % 2 == 0, F.col("o_orderpriority")).otherwise("work"))
    x = x.groupBy(F.col("r_name").alias("machine_id"), label.alias("label")).agg(F.count(F.lit(1)).alias("frequency"), F.max("o_orderstatus").alias("st"))
    kind = F.when(F.col("frequency") % 3 == 0, "none").when(F.col("frequency") % 3 == 1, "skill").otherwise("sop")
    return x.select("machine_id", "label", T.slugify(F.col("label")).alias("cluster_id"), F.concat_ws(">", F.lit("read"), F.lower("st")).alias("dominant_pattern"), "frequency", kind.alias("intervention"))


_CANDIDATES = """ca AS (SELECT *, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS cluster_id, 'read>' || lower(st) AS dominant_pattern,
    CASE frequency % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'skill' ELSE 'sop' END AS intervention FROM (
    SELECT r_name AS machine_id, c_mktsegment || ' ' || CASE WHEN r_regionkey % 2 = 0 THEN o_orderpriority ELSE 'work' END AS label, count(*) AS frequency, max(o_orderstatus) AS st
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)),
ci AS (SELECT *, list_distinct(list_transform(list_filter(string_split_regex(lower(label), '[^a-z0-9]+'), lambda w : w <> ''), lambda w : 'l:' || w) || ['p:' || dominant_pattern]) AS sig, row_number() OVER (ORDER BY machine_id, label, cluster_id) AS pos FROM ca)"""


def _sql_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})))"


@query
def converge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.similar_pairs(_candidates(spark, sf))


oracle(
    "converge_pairs",
    f"""WITH {_CANDIDATES} SELECT a.machine_id AS machine_a, a.cluster_id AS cluster_a, b.machine_id AS machine_b, b.cluster_id AS cluster_b, round({_sql_jaccard('a.sig', 'b.sig')}, 4) AS similarity
    FROM ci a JOIN ci b ON a.machine_id < b.machine_id WHERE round({_sql_jaccard('a.sig', 'b.sig')}, 4) >= 0.4""",
)


@query
def converge(spark: SparkSession, sf: str) -> DataFrame:
    return C.converge(_candidates(spark, sf)).drop("converged_id")


oracle(
    "converge",
    f"""WITH RECURSIVE {_CANDIDATES}, fo AS (
      SELECT 0::BIGINT AS pos, []::VARCHAR[][] AS seeds, 0::BIGINT AS grp
      UNION ALL
      SELECT pos, CASE WHEN best >= 0.4 THEN seeds ELSE list_append(seeds, sig) END, CASE WHEN best >= 0.4 THEN list_position(sims, best) ELSE len(seeds) + 1 END
      FROM (SELECT *, coalesce(list_max(sims), 0) AS best FROM (
        SELECT ci.pos, ci.sig, fo.seeds, list_transform(fo.seeds, lambda s : {_sql_jaccard('ci.sig', 's')}) AS sims FROM fo JOIN ci ON ci.pos = fo.pos + 1))),
    g AS (SELECT fo.grp, ci.* FROM fo JOIN ci ON fo.pos = ci.pos),
    v AS (SELECT grp, arg_max(intervention, (v, -p)) AS best FROM (SELECT grp, intervention, count(*) AS v, min(pos) AS p FROM g WHERE intervention <> 'none' GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT grp, arg_min(label, pos) AS label, array_to_string(list_sort(list_distinct(list(machine_id))), ',') AS machines, count(DISTINCT machine_id) AS n_machines, sum(frequency)::BIGINT AS total_frequency,
      string_agg(machine_id || ':' || cluster_id, ',' ORDER BY pos) AS clusters FROM g GROUP BY 1),
    pm AS (SELECT grp, string_agg(machine_id || ':' || n, ', ' ORDER BY p) AS per_machine FROM (SELECT grp, machine_id, sum(frequency)::BIGINT AS n, min(pos) AS p FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT label, machines, n_machines, total_frequency, per_machine, clusters, coalesce(v.best, 'none') AS intervention, round(n_machines / (SELECT count(DISTINCT machine_id) FROM ca), 3) AS agreement, n_machines >= 2 AS cross_validated FROM m JOIN pm ON m.grp = pm.grp LEFT JOIN v ON m.grp = v.grp""",
)


@query
def hash31(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "customer").select("c_custkey", T.hash31(F.concat_ws("|", F.lit("conv"), F.lower("c_name"), "c_mktsegment")).alias("h"))


oracle(
    "hash31",
    """WITH x AS (SELECT c_custkey, 'conv|' || lower(c_name) || '|' || c_mktsegment AS s FROM customer)
    SELECT c_custkey, lpad(lower(printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c : unicode(c)::BIGINT)), lambda a, c : (a * 31 + c) % 4294967296))), 8, '0') AS h FROM x""",
)


# ------------------------------------------------------------ drafting


@query
def evidence_tally(spark: SparkSession, sf: str) -> DataFrame:
    lines = D.table(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    items = lines.where("text <> ''").select("source", "text", F.col("doc_id").cast("string").alias("example"), (F.col("doc_id") * 1000000 + F.col("n")).alias("ord"))
    return M.tally(items, ["source"])


oracle(
    "evidence_tally",
    """WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), i AS (SELECT source, ls[n] AS text, doc_id::VARCHAR AS example, doc_id * 1000000 + n - 1 AS ord FROM l, range(1, len(ls) + 1) t(n)),
    f AS (SELECT *, lower(text) AS item FROM i WHERE text <> ''), e AS (SELECT source, item, example, min(ord) AS o FROM f GROUP BY ALL), x AS (SELECT source, item, array_to_string(list(example ORDER BY o)[1:3], '|') AS examples FROM e GROUP BY 1, 2),
    a AS (SELECT source, item, count(*) AS n, arg_min(text, ord) AS text FROM f GROUP BY 1, 2), r AS (SELECT a.*, examples, row_number() OVER (PARTITION BY a.source ORDER BY n DESC, a.item) AS place FROM a JOIN x ON a.source = x.source AND a.item = x.item)
    SELECT * FROM r WHERE place <= 12""",
)


@query
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf).where("task_type is not null").withColumn("confidence", 0.5 + F.col("episode_id") % 50 / 100)
    outcome, confidence = S.consolidate(F.col("outcome"), F.col("confidence"), F.col("quality"))
    return e.select("episode_id", outcome.alias("outcome"), F.round(confidence, 2).alias("confidence"))


oracle(
    "consolidate",
    f"""WITH {D.EPISODES}, x AS (SELECT *, 0.5::DOUBLE + episode_id % 50 / 100 AS c, coalesce(quality <= 2 AND outcome = 'success', false) AS veto FROM ep WHERE task_type IS NOT NULL)
    SELECT episode_id, CASE WHEN veto THEN 'partial' ELSE outcome END AS outcome, round(CASE WHEN veto THEN least(c, 0.6) ELSE c END, 2) AS confidence FROM x""",
)

#: Fixed sentences, put before the texts of the pages' titles.
_CLAIMS = ["Always works; seen in 7 runs and in 3 sessions", "This recurring fix NEVER fails: 5 of 8 sessions, 3x faster", "Guaranteed every time after 12 episodes", "Plain words without claims"]


@query
def overclaim_guard(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(c) for c in _CLAIMS]), (F.col("p_partkey") % len(_CLAIMS) + 1).cast("int"))
    x = D.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", pick, "p_name").alias("prose"), (F.col("p_size") % 2 == 0).alias("stable"), (F.col("p_size") % 3).alias("friction"))
    return x.select("p_partkey", G.overclaim_guard(F.col("prose"), F.col("stable"), F.col("friction")).alias("guarded"), G.clamp_description(F.col("prose"), 40).alias("short"))


def _sql_chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, other in rules:
        x = f"regexp_replace({x}, '{pattern.replace(T.B, chr(92) + 'b')}', '{other.replace('$', chr(92))}', 'g')"
    return x


_STRIPPED = _sql_chain("prose", G.COUNTS)
_SOFT = _sql_chain(_STRIPPED, [(f"(?i)\\b{a}\\b", b) for a, b in G.ABSOLUTES])
oracle(
    "overclaim_guard",
    f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{c}'" for c in _CLAIMS)}][p_partkey % {len(_CLAIMS)} + 1] || ' ' || p_name AS prose, p_size % 2 = 0 AS stable, p_size % 3 AS friction FROM part),
    y AS (SELECT *, CASE WHEN stable THEN {_STRIPPED} ELSE {_SOFT} END AS g FROM x)
    SELECT p_partkey, CASE WHEN friction < 2 THEN regexp_replace(g, '(?i)\\brecurring\\b', 'observed', 'g') ELSE g END AS guarded, CASE WHEN length(prose) <= 40 THEN prose ELSE trim(left(prose, 40)) || '…' END AS short FROM y""",
)


@query
def script_risks(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "rm -rf /tmp/x"), (2, "curl http://a | sudo bash"), (3, "git push --force"), (4, "echo fine"), (5, "DROP TABLE t; TRUNCATE TABLE u"), (6, "cat ~/.ssh/id && npm install x"), (7, "kubectl apply -f x && redeploy")]
    return spark.createDataFrame(rows, "id int, body string").select("id", F.array_join(G.script_risks(F.col("body")), ", ").alias("risks"))


oracle("script_risks", "SELECT * FROM (VALUES (1, 'rm -rf'), (2, 'pipe-to-shell (curl|wget … | sh)'), (3, 'force-push'), (4, ''), (5, 'DROP (SQL), TRUNCATE (SQL)'), (6, 'credential-file read (.ssh/.env/.aws), arbitrary package install'), (7, 'deploy')) t(id, risks)")


@query
def selection_parser(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "1,3,5-8"), (2, "8-5, 2 ,2"), (3, "x,,0,11"), (4, "9-40"), (5, "")]
    return spark.createDataFrame(rows, "id int, s string").select("id", F.array_join(G.selection(F.col("s"), F.lit(10)), " ").alias("picked"))


oracle("selection_parser", "SELECT * FROM (VALUES (1, '1 3 5 6 7 8'), (2, '2'), (3, ''), (4, '9 10'), (5, '')) t(id, picked)")


@query
def test_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "pytest -q", "2 failed, 3 passed"), (2, "npm run test", "0 errors"), (3, "ls latest", "1 error suppressed"), (4, "make", "Traceback (most recent"), (5, "a && test && b", "all tests passed"), (6, "cargo build", "2 errors"), (7, "contest", "nothing here")]
    x = spark.createDataFrame(rows, "id int, command string, result string")
    return x.select("id", E.is_test_command(F.col("command")).alias("is_test"), E.test_verdict(F.lower("result")).alias("verdict"))


oracle("test_verdicts", "SELECT * FROM (VALUES (1, true, 'failed'), (2, true, NULL), (3, false, NULL), (4, true, 'failed'), (5, true, 'passed'), (6, true, 'failed'), (7, false, NULL)) t(id, is_test, verdict)")


@query
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, 'so: ```json\n{"a": {"b": "}"}}\n``` end }'), (2, "none"), (3, '{"x": "a\\"}{"} tail'), (4, "{open"), (5, "")]
    return spark.createDataFrame(rows, "id int, s string").select("id", T.json_object(F.col("s")).alias("found"))


oracle("json_extract", """SELECT * FROM (VALUES (1, '{"a": {"b": "}"}}'), (2, NULL), (3, '{"x": "a\\"}{"}'), (4, NULL), (5, NULL)) t(id, found)""")

_GOOD = '{"task_type": "bug fix", "task_difficulty": "hard", "outcome": "success", "outcome_confidence": 0.9, "workflow_pattern": ["read"], "good_practices": [], "friction_points": [{"what": "a", "evidence": "b"}], "root_cause": "", "outcome_evidence": ["x"], "skill_opportunity": {"worth_codifying": true, "type": "skill", "rationale": "r"}, "quality": {"score": 4}}'


@query
def label_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = [
        (1, _GOOD),
        (2, _GOOD.replace('"hard"', '"huge"').replace("0.9", "1.5").replace('"score": 4', '"score": 4.0')),
        (3, _GOOD.replace('["read"]', '"read"').replace('"evidence": "b"', '"evidence": 3').replace("true", '"yes"').replace('"score": 4', '"score": 6')),
        (4, "{}"),
        (5, _GOOD.replace('"bug fix"', '"  "').replace("0.9", '"0.9"').replace('["x"]', "[1]").replace('"score": 4', '"score": "4"')),
        (6, "not json"),
    ]
    v = F.try_parse_json("label")
    x = spark.createDataFrame(rows, "id int, label string")
    return x.select("id", F.array_join(S.label_errors(v), ",").alias("errors"), S.valid_score(v, "$.quality.score").alias("quality_ok"))


_ALL = "task_type,task_difficulty,outcome,outcome_confidence,workflow_pattern,good_practices,friction_points,root_cause,outcome_evidence,skill_opportunity.worth_codifying,skill_opportunity.type,skill_opportunity.rationale"
oracle(
    "label_validation",
    f"""SELECT * FROM (VALUES (1, '', true), (2, 'task_difficulty,outcome_confidence', false), (3, 'workflow_pattern,friction_points,skill_opportunity.worth_codifying', false), (4, '{_ALL}', false),
    (5, 'task_type,outcome_confidence,outcome_evidence', false), (6, '{_ALL}', false)) t(id, errors, quality_ok)""",
)


@query
def stage_names(spark: SparkSession, sf: str) -> DataFrame:
    steps = D.table(spark, sf, "part").select("p_brand", "p_partkey", "p_type")
    return G.stage_file_names(steps, ["p_brand"], "p_partkey", "p_type").select("p_partkey", "file_name")


oracle(
    "stage_names",
    """WITH x AS (SELECT p_brand, p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48), ''), 'stage') AS base FROM part),
    y AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS n FROM x) SELECT p_partkey, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.md' AS file_name FROM y""",
)


@query
def draft_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Role, steps, strength, note and escaped texts of the candidates of all machines."""
    x = _candidates(spark, sf).withColumn("risks", F.when(F.col("frequency") % 2 == 0, F.array(F.lit("destructive: deploy"))).otherwise(F.array().cast("array<string>")))
    notes = x.where("frequency % 5 = 0").select("cluster_id", F.concat(F.lit("own "), "cluster_id").alias("note")).distinct()
    x = G.with_notes(x, notes, "  billing work ")
    return x.select(
        "machine_id", "cluster_id", "note", G.is_draftable(F.col("intervention")).alias("draftable"), G.draft_role(F.col("intervention")).alias("role"),
        F.array_join(G.draft_steps(F.col("dominant_pattern")), "|").alias("steps"), G.evidence_strength(F.col("frequency") < 100, F.col("frequency")).alias("strength"),
        G.yaml_scalar(F.concat("label", F.lit(' "x"\n\\'))).alias("yaml"), G.table_cell(F.concat("label", F.lit("|a\n\nb "))).alias("cell"),
    )


oracle(
    "draft_fields",
    f"""WITH {_CANDIDATES}, n AS (SELECT DISTINCT cluster_id, 'own ' || cluster_id AS note FROM ca WHERE frequency % 5 = 0)
    SELECT machine_id, ca.cluster_id, coalesce(note, 'Relate "' || label || '" to: "billing work". A domain owner must confirm it matches the real process before codifying.' || CASE WHEN frequency % 2 = 0 THEN ' Note risk flags: destructive: deploy.' ELSE '' END) AS note,
    intervention <> 'none' AS draftable, CASE intervention WHEN 'script' THEN 'automation' WHEN 'sop' THEN 'practitioner' ELSE 'implementer' END AS role, replace(dominant_pattern, '>', '|') AS steps,
    CASE WHEN frequency >= 100 THEN 'strong' ELSE 'weak' END AS strength, '"' || label || ' \\"x\\"\\n\\\\"' AS yaml, label || '\\|a b' AS cell FROM ca LEFT JOIN n ON ca.cluster_id = n.cluster_id""",
)


@query
def env_exports(spark: SparkSession, sf: str) -> DataFrame:
    lines = ["export A=1", "set \"B=two words\"", "$env:C='x'", "# D=no", "E = \"q\"", "1F=no", "=no", "A=3", "G="]
    x = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "id int, line int, text string")
    return G.parse_exports(x, ["id"])


oracle("env_exports", "SELECT * FROM (VALUES (1, 'A', '3'), (1, 'B', 'two words'), (1, 'C', 'x'), (1, 'E', 'q'), (1, 'G', '')) t(id, name, value)")


@query
def script_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, " run.sh "), (2, "../x"), (3, ".hidden"), (4, "a/b"), (5, "C:x"), (6, ""), (7, None), (8, "a..b")]
    return spark.createDataFrame(rows, "id int, raw string").select("id", G.safe_script_name(F.col("raw")).alias("name"))


oracle("script_names", "SELECT i::INT AS id, CASE WHEN i = 1 THEN 'run.sh' END AS name FROM range(1, 9) t(i)")


@query
def reconstruct_compact(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf).where("task_type is not null")
    evidence = e.where("n_corrections > 0").select("episode_id", F.lit("n_corrections").alias("signal"), F.lit("-").alias("direction"), F.lit("weak").alias("weight"), F.col("n_corrections").cast("string").alias("value"), F.lit("corrected").alias("reason"))
    evidence = evidence.union(e.where("episode_id % 2 = 0").select("episode_id", F.lit("api_errors"), F.lit("0"), F.lit("weak"), F.lit(None).cast("string"), F.lit("even")))
    friction = F.when(F.col("n_interruptions") > 3, F.array(F.lit("stop (often)"))).otherwise(F.array().cast("array<string>"))
    return Q.reconstructed(e.select("episode_id", "first_prompt", F.col("signature").alias("workflow"), friction.alias("friction")), evidence)


oracle(
    "reconstruct_compact",
    f"""WITH {D.EPISODES}, v AS (SELECT episode_id, 'n_corrections' AS signal, 'n_corrections (-weak): ' || n_corrections || ' — corrected' AS line FROM ep WHERE task_type IS NOT NULL AND n_corrections > 0
      UNION ALL SELECT episode_id, 'api_errors', 'api_errors (0weak): null — even' FROM ep WHERE task_type IS NOT NULL AND episode_id % 2 = 0),
    g AS (SELECT episode_id, string_agg(line, chr(10) ORDER BY signal) AS lines FROM v GROUP BY 1)
    SELECT ep.episode_id, 'USER: ' || first_prompt || chr(10) || chr(10) || '(NOTE: compact reconstruction from stored columns — the full transcript was not persisted.)' || chr(10) ||
      'OBSERVED WORKFLOW PHASES: ' || replace(signature, '>', ' > ') || chr(10) || CASE WHEN n_interruptions > 3 THEN 'FRICTION OBSERVED:' || chr(10) || '  - stop (often)' || chr(10) ELSE '' END ||
      chr(10) || '--- EVIDENCE SIGNALS ---' || chr(10) || coalesce(lines, '(none)') AS compact FROM ep LEFT JOIN g ON ep.episode_id = g.episode_id WHERE task_type IS NOT NULL""",
)


@query
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    calls = D.table(spark, sf, "orders").select(k.alias("episode_id"), (k % 3 == 0).alias("cached"), F.lit(0.4).alias("cost"), (k % 4 == 1).alias("failed"))
    return Q.run_counters(S.budgeted(calls, ["episode_id"], 100, 1000.0, 5))


oracle(
    "run_counters",
    """WITH c AS (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 100) SELECT count(*) AS n_total, count_if(k % 3 <> 0 AND k % 4 <> 1)::BIGINT AS n_judged, count_if(k % 3 = 0)::BIGINT AS n_skipped,
    count_if(k % 3 <> 0 AND k % 4 = 1)::BIGINT AS n_errors, round(0.4 * count_if(k % 3 <> 0), 2)::DOUBLE AS spent FROM c""",
)


@query
def result_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, '"Plain"'), (2, '{"stdout": "A", "stderr": "B", "interrupted": true}'), (3, '{"content": [{"text": "X"}, {"text": "Y"}]}'), (4, '{"content": "C"}'), (5, '{"z": 1}'), (6, None), (7, "[1]")]
    x = spark.createDataFrame(rows, "id int, r string")
    return x.select("id", F.replace(E.result_text(F.try_parse_json("r")), F.lit("\n"), F.lit("/")).alias("haystack"))


oracle("result_texts", """SELECT * FROM (VALUES (1, 'plain'), (2, 'a/b/interrupted'), (3, 'x/y'), (4, 'c'), (5, '{"z":1}'), (6, ''), (7, '[1]')) t(id, haystack)""")


@query
def subagent_links(spark: SparkSession, sf: str) -> DataFrame:
    calls = spark.createDataFrame([("t1", "Look", "explorer"), ("t2", " Fix It ", None), ("t3", "none", None)], "id string, description string, subagent_type string")
    results = spark.createDataFrame([("t1", "a9", None, 0, None), ("t3", None, None, 4, "completed")], "id string, agent_id string, agent_type string, tool_count int, status string")
    forks = spark.createDataFrame([("a1", "plan", "look", "t1", 3, "done", "f1"), ("a2", "code", "fix it", "x", 5, "mid_call", "f2"), ("a3", "code2", "Fix it", "y", 6, "done", "f3")], "agent_id string, agent_type string, description string, tool_use_id string, tool_count int, outcome string, name string")
    return E.linked_forks(calls, results, forks)


oracle("subagent_links", "SELECT id, agent_id, agent_type, description, tool_count::BIGINT AS tool_count, outcome FROM (VALUES ('t1', 'a9', 'plan', 'look', 3, 'done'), ('t2', 'a3', 'code2', 'Fix it', 6, 'done'), ('t3', '', 'unknown', 'none', 4, 'completed')) t(id, agent_id, agent_type, description, tool_count, outcome)")


@query
def previous_task(spark: SparkSession, sf: str) -> DataFrame:
    overrides = D.roles(spark, sf).where("session_id % 7 = 0 and idx = 1").select("session_id", "idx", F.lit("correction").alias("role"))
    return TU.previous_task(TU.overridden(D.roles(spark, sf), overrides)).select("session_id", "idx", "role", "task_idx")


oracle(
    "previous_task",
    f"""WITH RECURSIVE {D.ROLES}, o AS (SELECT session_id, idx, CASE WHEN session_id % 7 = 0 AND idx = 1 THEN 'correction' ELSE role END AS role FROM ro)
    SELECT *, last_value(CASE WHEN role = 'new_task' THEN idx END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS task_idx FROM o""",
)


# ------------------------------------------------------------ storage


@query
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf).select("episode_id", "outcome")
    new = e.where("episode_id % 5 = 0").select((F.col("episode_id") * 3).alias("episode_id"), F.lit("failed").alias("outcome"), F.lit("m2").alias("model"))
    return S.upsert(e, new, ["episode_id"])


oracle(
    "upsert",
    f"""WITH {D.EPISODES}, n AS (SELECT episode_id * 3 AS episode_id, 'failed' AS outcome, 'm2' AS model FROM ep WHERE episode_id % 5 = 0)
    SELECT episode_id, outcome, NULL::VARCHAR AS model FROM ep WHERE episode_id NOT IN (SELECT episode_id FROM n) UNION ALL SELECT * FROM n""",
)


@query
def prune(spark: SparkSession, sf: str) -> DataFrame:
    keep = D.episodes(spark, sf).where("task_type is not null and episode_id % 7 <> 0").select(F.col("episode_id").alias("l_orderkey"))
    kept = S.prune(D.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), keep, ["l_orderkey"])
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("q"))


oracle("prune", "SELECT l_orderkey, count(*) AS n, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 7 <> 0 GROUP BY 1")


@query
def unlink_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("part"))
    keep = D.table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("episode_id"))
    return S.unlink(turns, keep, "episode_id").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


oracle("unlink_turns", "WITH x AS (SELECT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) THEN l_orderkey END AS episode_id FROM lineitem) SELECT episode_id, count(*) AS n FROM x GROUP BY 1")


@query
def cache_skip(spark: SparkSession, sf: str) -> DataFrame:
    e = D.episodes(spark, sf)
    version = lambda m: F.when(F.col("episode_id") % m == 0, F.lit(None).cast("string")).otherwise("1")
    now = e.select("episode_id", F.sha2("signature", 256).alias("content_hash"), F.lit("p").alias("prompt_hash"), version(13).alias("schema_version"), F.lit("m").alias("model"), F.lit("c").alias("cli_version"))
    stored = e.where("task_type is not null").select("episode_id", F.sha2(F.when(F.col("episode_id") % 4 == 0, F.lit("old")).otherwise(F.col("signature")), 256).alias("content_hash"), F.lit("p").alias("prompt_hash"), version(13).alias("schema_version"), F.lit("m").alias("model"), F.lit("c").alias("cli_version"))
    return S.not_yet_labeled(now, stored).select("episode_id")


oracle("cache_skip", f"WITH {D.EPISODES} SELECT episode_id FROM ep WHERE task_type IS NULL OR episode_id % 4 = 0 OR episode_id % 13 = 0")


@query
def judge_budget(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    calls = D.table(spark, sf, "orders").select(k.alias("episode_id"), (k % 3 == 0).alias("cached"), F.lit(0.4).alias("cost"), ((k % 4 == 1) | (k % 100 > 90)).alias("failed"))
    return S.budgeted(calls, ["episode_id"], 300, 60.0, 5).select("episode_id", "ran", F.round("spent", 1).alias("spent"))


oracle(
    "judge_budget",
    """WITH RECURSIVE c AS (SELECT o_orderkey AS episode_id, o_orderkey % 3 = 0 AS cached, o_orderkey % 4 = 1 OR o_orderkey % 100 > 90 AS failed, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
    s AS (SELECT 0::BIGINT AS n, -1::BIGINT AS episode_id, 0::BIGINT AS asked, 0 AS fails, false AS broken, false AS ran
      UNION ALL SELECT n, episode_id, asked, CASE WHEN NOT ran THEN fails WHEN failed THEN fails + 1 ELSE 0 END, broken OR (ran AND failed AND fails + 1 >= 5), ran FROM (
        SELECT c.n, c.episode_id, c.failed, s.fails, s.broken, s.asked + (NOT c.cached)::INT AS asked, NOT c.cached AND NOT s.broken AND 0.4 * (s.asked + 1) <= 60 AS ran FROM s JOIN c ON c.n = s.n + 1 WHERE c.n <= 300))
    SELECT episode_id, ran, round(0.4 * asked, 1)::DOUBLE AS spent FROM s WHERE n > 0""",
)


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rendered episodes."""
    n = F.length(F.coalesce("text", F.lit("")))
    return D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("episode_id"), F.col("doc_id").alias("ord"), n.cast("bigint").alias("n_turns"), (n > E.RENDER_CAP).alias("elided"), (F.col("doc_id") % 83 == 7).alias("subagents"), (F.col("doc_id") % 19 == 3).cast("bigint").alias("n_corrections"),
        F.coalesce("source", F.lit("")).alias("session_id"),
    )


@query
def representative_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that show the shapes there are."""
    return Q.representatives(_shown(spark, sf), 9)


oracle(
    "representative_picks",
    """WITH x AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), f AS (
      SELECT 0 AS a, arg_min(doc_id, (-n, doc_id)) AS id FROM x UNION ALL SELECT 1, min(doc_id) FROM x WHERE n > 12000 UNION ALL SELECT 2, min(doc_id) FROM x WHERE doc_id % 83 = 7 UNION ALL SELECT 3, min(doc_id) FROM x WHERE doc_id % 19 = 3
      UNION ALL SELECT 3 + row_number() OVER (ORDER BY n DESC, doc_id), doc_id FROM x),
    d AS (SELECT id, min(a) AS a FROM f WHERE id IS NOT NULL GROUP BY 1) SELECT id AS episode_id, place FROM (SELECT id, row_number() OVER (ORDER BY a) - 1 AS place FROM d) WHERE place < 9""",
)


@query
def render_selection(spark: SparkSession, sf: str) -> DataFrame:
    """What the selections by id, session prefix and draw give."""
    x = _shown(spark, sf)
    picks = {"id": Q.selected(x, episode_id="17"), "session": Q.selected(x, session="src1"), "draw": Q.selected(x, draw=12, seed=3), "first": Q.selected(x).limit(5)}
    out = None
    for how, df in picks.items():
        own = df.select(F.lit(how).alias("how"), "episode_id")
        out = own if out is None else out.unionByName(own)
    return out


oracle(
    "render_selection",
    """SELECT 'id' AS how, doc_id AS episode_id FROM documents WHERE doc_id = 17 UNION ALL SELECT 'session', doc_id FROM documents WHERE starts_with(coalesce(source, ''), 'src1')
    UNION ALL SELECT * FROM (SELECT 'draw', doc_id FROM documents ORDER BY md5(doc_id || ':3'), doc_id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'first', doc_id FROM documents ORDER BY length(coalesce(text, '')) DESC, doc_id LIMIT 5)""",
)


@query
def convergence_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.report_lines(C.converge(_candidates(spark, sf)))


oracle(
    "convergence_report",
    f"""WITH RECURSIVE c AS (SELECT * FROM ({{converge}})), r AS (SELECT *, row_number() OVER (ORDER BY cross_validated DESC, total_frequency DESC, label, clusters) AS n FROM c),
    l AS (SELECT 0 AS place, '# Cross-machine convergence' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '- Converged workflows: **' || count(*) || '** · cross-validated (≥2 machines): **' || count_if(cross_validated) || '**' FROM c
      UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| # | Workflow | #Machines | Cross-validated | Total freq | Per-machine | Rec |' UNION ALL SELECT 5, '|---|---|---|---|---|---|---|'
      UNION ALL SELECT 5 + n, '| ' || n || ' | ' || label || ' | ' || n_machines || ' | ' || CASE WHEN cross_validated THEN '✅' ELSE '—' END || ' | ' || total_frequency || ' | ' || per_machine || ' | ' || intervention || ' |' FROM r
      UNION ALL SELECT 6 + count(*), '' FROM c UNION ALL SELECT 7 + count(*), '> Cross-validated workflows are the highest-confidence candidates for the org-wide meta phase.' FROM c)
    SELECT place::INT AS place, line FROM l""".replace("{converge}", ORACLES["converge"]),
)


@query
def replace_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as evidence of orders: those of every fifth order are replaced, of every tenth by nothing."""
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("n"))
    done = D.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("episode_id"))
    new = done.where("episode_id % 10 <> 0").select("episode_id", F.lit(77).alias("n"))
    out = S.replace_all(S.replace_all(rows, new, done), new, done)
    return out.groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("bigint").alias("n"))


oracle(
    "replace_evidence",
    """WITH x AS (SELECT l_orderkey AS episode_id, l_linenumber AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)
      UNION ALL SELECT o_orderkey, 77 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) SELECT episode_id, count(*) AS rows, sum(n)::BIGINT AS n FROM x GROUP BY 1""",
)


@query
def prune_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and rows without a link, of each table after every second session lost the episodes that are divisible by three."""
    tables = _store(spark, sf)
    tables["episodes"] = tables["episodes"].where("session_id > 0")
    tables["evidence"] = tables["episodes"].select("episode_id")
    keep = tables["episodes"].where("session_id % 2 = 0 and episode_id % 3 <> 0").select("session_id", "episode_id")
    out = S.prune_sessions(tables, keep)
    parts = [out[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("episode_id").isNull()).alias("unlinked")) for n in (*S.OWNED, *S.LINKED)]
    return reduce(DataFrame.unionByName, parts)


oracle(
    "prune_sessions",
    f"""WITH {D.EPISODES}, {_STORE}, s AS (SELECT * FROM se WHERE session_id > 0), again AS (SELECT DISTINCT session_id FROM s WHERE session_id % 2 = 0 AND episode_id % 3 <> 0),
    gone AS (SELECT episode_id FROM s WHERE session_id IN (SELECT session_id FROM again) AND episode_id % 3 = 0), kept AS (SELECT episode_id FROM s WHERE episode_id NOT IN (SELECT episode_id FROM gone))
    SELECT 'episodes' AS name, count(*) AS n, 0::BIGINT AS unlinked FROM kept UNION ALL SELECT 'evidence', count(*), 0 FROM kept UNION ALL SELECT 'features', count(*), 0 FROM fe WHERE episode_id NOT IN (SELECT episode_id FROM gone)
    UNION ALL SELECT 'labels', count(*), 0 FROM ep WHERE task_type IS NOT NULL AND episode_id NOT IN (SELECT episode_id FROM gone)
    UNION ALL SELECT 'turns', count(*), count_if(episode_id IN (SELECT episode_id FROM gone))::BIGINT FROM ep""",
)


@query
def sampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored labels as a reviewer gets them, some with values of the wrong kind."""
    k = F.col("episode_id")
    e = D.episodes(spark, sf).where("task_type is not null").select("episode_id", "outcome", "first_prompt")
    text = F.concat(
        F.lit('{"outcome":"'), F.when(k % 7 == 0, "done").otherwise(F.col("outcome")), F.lit('","outcome_confidence":'), F.when(k % 5 == 0, '"high"').otherwise((k % 10 / 10).cast("string")),
        F.lit(',"workflow_pattern":'), F.when(k % 3 == 0, '["read",4,"edit"]').otherwise('"read"'), F.lit(',"friction_points":'), F.when(k % 4 == 0, '{}').otherwise('[{"what":"w","evidence":"e"}]'), F.lit("}"),
    )
    rows = e.select("episode_id", F.lit("s").alias("stratum"), F.when(k % 11 == 0, "no json").otherwise(text).alias("label"), F.when(k % 2 == 0, F.col("first_prompt")).alias("first_prompt"))
    x = Q.sampled(rows)
    return x.select("episode_id", "outcome", F.round("confidence", 2).alias("confidence"), "first_prompt", F.array_join("steps", ">").alias("steps"), F.size("friction").alias("n_friction"), "root_cause")


oracle(
    "sampled_rows",
    f"""WITH {D.EPISODES}, x AS (SELECT *, episode_id AS k, episode_id % 11 <> 0 AS ok FROM ep WHERE task_type IS NOT NULL)
    SELECT k AS episode_id, CASE WHEN ok AND k % 7 <> 0 THEN outcome END AS outcome, CASE WHEN ok AND k % 5 <> 0 THEN round(k % 10 / 10, 2) END AS confidence, CASE WHEN k % 2 = 0 THEN first_prompt ELSE '' END AS first_prompt,
    CASE WHEN ok AND k % 3 = 0 THEN 'read>edit' ELSE '' END AS steps, CASE WHEN ok AND k % 4 <> 0 THEN 1 ELSE 0 END AS n_friction, '' AS root_cause FROM x""",
)


@query
def stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that still hold: those whose episode has the content they were given for."""
    e = D.episodes(spark, sf)
    one = lambda h: (F.sha2(h, 256).alias("content_hash"), *[F.lit("v").alias(c) for c in S.CACHE_KEY[2:]])
    labels = e.where("task_type is not null").select("episode_id", *one(F.when(F.col("episode_id") % 4 == 0, F.lit("old")).otherwise(F.col("signature"))), "outcome")
    return S.stored_labels(e.select("episode_id", *one(F.col("signature"))), labels).select("episode_id", "outcome")


oracle("stored_labels", f"WITH {D.EPISODES} SELECT episode_id, outcome FROM ep WHERE task_type IS NOT NULL AND episode_id % 4 <> 0")


@query
def greedy_spans(spark: SparkSession, sf: str) -> DataFrame:
    x = D.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_partkey") % 3 > 0, "so {"), "p_name", F.when(F.col("p_partkey") % 4 > 0, "} [a]"), "p_brand", F.when(F.col("p_partkey") % 5 > 0, "] }")).alias("s"))
    return x.select("p_partkey", T.greedy(F.col("s")).alias("object"), T.greedy(F.col("s"), "[", "]").alias("list"))


oracle(
    "greedy_spans",
    """WITH x AS (SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 3 > 0 THEN 'so {' END, p_name, CASE WHEN p_partkey % 4 > 0 THEN '} [a]' END, p_brand, CASE WHEN p_partkey % 5 > 0 THEN '] }' END) AS s FROM part)
    SELECT p_partkey, nullif(regexp_extract(s, '(?s)\\{.*\\}'), '') AS object, nullif(regexp_extract(s, '(?s)\\[.*\\]'), '') AS list FROM x""",
)


@query
def small_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One-line prompts, path segments, pattern signatures and decoded folders of the parts' texts."""
    steps = F.array(F.concat(F.lit("  "), F.upper("p_brand")), F.lit(" "), F.col("p_type"))
    path = F.concat_ws("/", F.lit("/Src"), F.replace("p_type", F.lit(" "), F.lit("/")), F.concat("p_brand", F.lit(".test.py")))
    return D.table(spark, sf, "part").select(
        "p_partkey", T.one_line(F.concat(F.lit(" \n"), "p_name", F.lit("\t\t "), "p_type", F.lit("  "), "p_brand"), 30).alias("line"), F.array_join(F.array_sort(T.path_segments(path)), " ").alias("segments"),
        T.pattern_signature(steps).alias("signature"), TU.decoded_folder(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("folder"),
    )


oracle(
    "small_texts",
    f"""SELECT p_partkey, left(p_name || ' ' || p_type || ' ' || p_brand, 30) AS line, lower(p_brand) || '>' || lower(p_type) AS signature, replace(p_name, ' ', '/') AS folder,
    array_to_string(list_sort(list_distinct(list_filter(string_split_regex('/src/' || lower(replace(p_type, ' ', '/')) || '/' || lower(p_brand) || '.test.py', '[/.]'), lambda w : length(w) >= 3 AND NOT list_contains({D._list(T.STOPWORDS)}, w)))), ' ') AS segments FROM part""",
)


def _sections(episodes: DataFrame) -> DataFrame:
    rows = S.kept(M.clustered(episodes))
    friction = rows.where("n_corrections > 1").select("cluster_id", F.concat(F.lit("slow "), (F.col("n_corrections") % 5).cast("string")).alias("what")).groupBy("cluster_id", "what").agg(F.count(F.lit(1)).alias("n"))
    return R.sections(rows, friction, rows.select("cluster_id", F.lit("check").alias("note")).where("cluster_id like '%high%'").distinct())


@query
def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The report's section of each cluster."""
    return _sections(D.episodes(spark, sf)).select("cluster_id", "thin", "section")


oracle(
    "report_sections",
    f"""WITH {D.EPISODES}, {_COMPONENTS}, {_PATTERN}, {_INTERVENTION}, rk AS ({{risks}}), pn AS (SELECT cluster_id, median(efficiency)::DOUBLE AS e, median(quality)::DOUBLE AS q, count_if(efficiency IS NOT NULL OR quality IS NOT NULL) AS np FROM cl GROUP BY 1),
    sd AS (SELECT cluster_id, CASE WHEN outcome = 'success' THEN 's' WHEN outcome IN ('failed', 'abandoned', 'partial') THEN 'f' END AS side, signature AS t, count(*) AS n FROM cl WHERE signature <> '' GROUP BY ALL
      UNION ALL SELECT cluster_id, 'w', 'slow ' || n_corrections % 5, count(*) FROM cl WHERE n_corrections > 1 GROUP BY ALL),
    tp AS (SELECT cluster_id, side, CASE WHEN side = 'w' THEN string_agg(t || ' (×' || n || ')', '; ' ORDER BY p) ELSE string_agg('`' || t || '` (×' || n || ')', ', ' ORDER BY p) END AS l FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, side ORDER BY n DESC, t) AS p FROM sd) WHERE p <= 3 GROUP BY cluster_id, side),
    ex AS ({{exemplars}}), ct AS (SELECT episode_id, '`' || episode_id || '` : ' || first_prompt || ' _(outcome: ' || coalesce(outcome, 'unjudged') || ', friction: ' || (n_corrections + n_interruptions) || ')_' AS c FROM cl)
    SELECT cc.cluster_id, frequency < 3 OR cc.n_judged < 3 AS thin, array_to_string(list_filter(['### ' || (SELECT min(label) FROM cl WHERE cl.cluster_id = cc.cluster_id), '', '- Frequency: **' || frequency || '** episodes across **' || n_sessions || '** session(s)',
      '- Success rate: **' || round(100 * round(CASE WHEN cc.n_judged > 0 THEN cc.n_success / cc.n_judged ELSE 0 END, 4))::BIGINT || '%**', '- Median friction (corrections + interruptions): **' || regexp_replace(median_friction::VARCHAR, '\\.0$', '') || '**',
      CASE WHEN e IS NOT NULL OR q IS NOT NULL THEN '- Median efficiency / quality (1–5, panel over ' || np || ' ep): **' || coalesce(regexp_replace(e::VARCHAR, '\\.0$', ''), '—') || '** / **' || coalesce(regexp_replace(q::VARCHAR, '\\.0$', ''), '—') || '**' END,
      '- Stable success pattern: **' || CASE WHEN n_patterns >= 3 AND pattern_n / n_patterns >= 0.5 THEN 'yes' ELSE 'no' END || '**' || coalesce(' — dominant: `' || dominant_pattern || '`', ''), '- Recommended intervention: **' || intervention || '**',
      CASE WHEN risk_flags <> '' THEN '- Risk flags: `' || replace(risk_flags, '; ', '`, `') || '`' END, '- Est. effort (median duration × frequency): ~' || round(d * frequency)::BIGINT || 's', '', '**Good vs bad workflow contrast**' || chr(10),
      '- Works (success patterns): ' || coalesce((SELECT l FROM tp WHERE tp.cluster_id = cc.cluster_id AND side = 's'), '_none_'), '- Flails (fail/partial patterns): ' || coalesce((SELECT l FROM tp WHERE tp.cluster_id = cc.cluster_id AND side = 'f'), '_none_'), '',
      '**Recurring friction:** ' || coalesce((SELECT l FROM tp WHERE tp.cluster_id = cc.cluster_id AND side = 'w'), '_none recorded_'), chr(10) || '**Exemplars**' || chr(10),
      '- Good: ' || coalesce((SELECT c FROM ct WHERE ct.episode_id = good), '_none available_'), '- Bad: ' || coalesce((SELECT c FROM ct WHERE ct.episode_id = bad), '_none available_'),
      CASE WHEN contains(cc.cluster_id, 'high') THEN chr(10) || '**Business note (sidecar, join-late):** check' END, ''], lambda x : x IS NOT NULL), chr(10)) AS section
    FROM cc LEFT JOIN dp ON dp.cluster_id = cc.cluster_id JOIN it ON it.cluster_id = cc.cluster_id JOIN rk ON rk.cluster_id = cc.cluster_id JOIN pn ON pn.cluster_id = cc.cluster_id LEFT JOIN ex ON ex.cluster_id = cc.cluster_id""".replace(
        "{risks}", f"SELECT cluster_id, array_to_string(list_filter([{_RISKS}, CASE WHEN edited >= 5 AND edited > 2 * coalesce(read, 0) THEN 'write-heavy (edits >> reads)' END], lambda x : x IS NOT NULL), '; ') AS risk_flags FROM (SELECT cluster_id, string_agg(first_prompt || coalesce(chr(10) || nullif(tool_sequence, ''), ''), chr(10) ORDER BY ord) AS blob, sum(n_files_edited) AS edited, sum(n_files_read) AS read FROM cl GROUP BY 1)"
    ).replace(
        "{exemplars}", """SELECT k.cluster_id, good, (SELECT arg_min(episode_id, (CASE WHEN outcome IN ('failed', 'abandoned') THEN 0 WHEN outcome = 'partial' THEN 1 ELSE 2 END, -(n_corrections + n_interruptions), ord)) FROM cl b WHERE b.cluster_id = k.cluster_id AND b.episode_id IS DISTINCT FROM good
        AND (outcome IN ('failed', 'abandoned', 'partial') OR n_corrections + n_interruptions > 0)) AS bad FROM (SELECT cluster_id, arg_min(episode_id, (n_corrections + n_interruptions, ord)) FILTER (outcome = 'success') AS good FROM cl GROUP BY 1) k"""
    ),
)


@query
def report_document(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the whole report but those of its clusters."""
    x = S.kept(D.episodes(spark, sf))
    doc = R.document(x, _sections(x).withColumn("section", F.lit("+")))
    return doc.select(F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))


oracle(
    "report_document",
    f"""WITH {D.EPISODES}, t AS (SELECT count(DISTINCT session_id) AS s, count(*) AS e, count_if({J})::BIGINT AS n_judged, count_if(outcome = 'success')::BIGINT AS n_success FROM ep), k AS (SELECT cluster_id, count(*) < 3 OR count_if({J}) < 3 AS thin FROM cl GROUP BY 1),
    l AS (SELECT string_split('# Workflow report||## Corpus||- Sessions: **' || s || '**|- Episodes: **' || e || '**|- Judged episodes (success/partial/failed/abandoned): **' || n_judged || '**|- Overall success rate: **' || round(100 * round({RATE}, 4))::BIGINT || '%** (of judged)|- Task clusters: **'
      || (SELECT count(*) FROM k) || '**||> Exemplars, not statistics: clusters are often thin and outcomes are judged by a model. Read them as leads.||## Task clusters (sufficient evidence)||' || CASE WHEN (SELECT count_if(NOT thin) FROM k) > 0 THEN repeat('+|', (SELECT count_if(NOT thin) FROM k)::BIGINT) ELSE '_None._||' END
      || '## Insufficient evidence||' || CASE WHEN (SELECT count_if(thin) FROM k) > 0 THEN repeat('+|', (SELECT count_if(thin) FROM k)::BIGINT) ELSE '_None._|' END, '|') AS ls FROM t)
    SELECT (i - 1)::INT AS place, ls[i] AS line FROM l, range(1, len(ls) + 1) r(i)""",
)
