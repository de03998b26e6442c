"""Queries of the labeler boundary: customers stand in for rendered episodes, callers answer by the id at a prompt's end."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labeling as L
from . import bindings as D
from .registry import oracle, query

RUBRICS = L.Rubrics("judge", "efficiency", "quality", "consolidate")


def _label(k: int, outcome: str, confidence: float, **more: object) -> str:
    return json.dumps(
        {
            "task_type": "feature", "task_difficulty": "moderate", "outcome": outcome, "outcome_confidence": confidence, "workflow_pattern": ["read", "edit"], "good_practices": [],
            "friction_points": [{"what": f"w{k}", "evidence": "}"}], "root_cause": "", "outcome_evidence": ["e"], "skill_opportunity": {"worth_codifying": k % 2 == 0, "type": "skill", "rationale": ""}, **more,
        }
    )


def _axis(score: float) -> str:
    return json.dumps({"score": score, "rationale": "r", "evidence": []})


def _outcome(k: int, again: bool) -> str:
    if k % 37 == 0 or (k % 11 == 0 and not again):
        return "no object { here"
    made = _label(k, ("success", "partial", "failed")[k % 3], 0.5 + k % 50 / 100)
    return f"so: {{x}}\n```json\n{made}\n```" if k % 2 else made


def _efficiency(k: int, again: bool) -> str:
    return _axis(4.5 if k % 41 == 0 else k % 5 + 1)


def _quality(k: int, again: bool) -> str:
    return _axis(0 if k % 13 == 0 and not again else k % 4 + 1)


def _consolidator(k: int, again: bool) -> str:
    more = {"quality": {"score": 9 if k % 3 == 0 else 5, "rationale": "q", "evidence": []}}
    if k % 2:
        more["efficiency"] = {"score": 1, "rationale": "e", "evidence": []}
    return _label(k, "partial", 0.25, **more)


def caller(answer: Callable[[int, bool], str]) -> L.Caller:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [answer(int(re.findall(r"EPISODE_ID: (\d+)\n", p)[-1]), L.NUDGE in p) for p in f["prompt"]]
            yield pd.DataFrame({"episode_id": f["episode_id"], "answer": said})

    return run


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "customer").select(F.col("c_custkey").alias("episode_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("rendered"))


def _flat(x: DataFrame) -> DataFrame:
    return x.select(
        "episode_id", F.col("label.outcome").alias("outcome"), F.round("label.outcome_confidence", 2).alias("confidence"), F.col("label.friction_points")[0]["what"].alias("friction"),
        F.col("efficiency.score").alias("efficiency"), F.col("quality.score").alias("quality"), F.array_join("errors", ";").alias("errors"),
    )


_CALLERS = {"outcome": caller(_outcome), "efficiency": caller(_efficiency), "quality": caller(_quality)}
_PANEL = """p AS (SELECT c_custkey AS k, c_custkey % 37 = 0 AS no_label, c_custkey % 41 = 0 AS no_axis, ['success', 'partial', 'failed'][c_custkey % 3 + 1] AS outcome, 0.5::DOUBLE + c_custkey % 50 / 100 AS c,
    c_custkey % 5 + 1 AS e, c_custkey % 4 + 1 AS q FROM customer)"""
_ALL = "task_type,task_difficulty,outcome,outcome_confidence,workflow_pattern,good_practices,friction_points,root_cause,outcome_evidence,skill_opportunity.worth_codifying,skill_opportunity.type,skill_opportunity.rationale"
_FAILED = f"CASE WHEN no_label THEN '{';'.join('outcome: ' + x for x in _ALL.split(','))}' WHEN no_axis THEN 'efficiency: score' ELSE '' END"


@query
def panel_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with the quality veto for a consolidator."""
    return _flat(L.panel(_episodes(spark, sf), _CALLERS, RUBRICS))


oracle(
    "panel_consolidate",
    f"""WITH {_PANEL} SELECT k AS episode_id, CASE WHEN no_label OR no_axis THEN NULL WHEN q <= 2 AND outcome = 'success' THEN 'partial' ELSE outcome END AS outcome,
    CASE WHEN no_label OR no_axis THEN NULL ELSE round(CASE WHEN q <= 2 AND outcome = 'success' THEN least(c, 0.6) ELSE c END, 2) END AS confidence, CASE WHEN NOT no_label AND NOT no_axis THEN 'w' || k END AS friction,
    (CASE WHEN NOT no_label AND NOT no_axis THEN e END)::INT AS efficiency, (CASE WHEN NOT no_label AND NOT no_axis THEN q END)::INT AS quality, {_FAILED} AS errors FROM p""",
)


@query
def panel_model(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with a consolidating caller; axes that it drops or breaks are the judged ones."""
    return _flat(L.panel(_episodes(spark, sf), _CALLERS | {"consolidator": caller(_consolidator)}, RUBRICS))


oracle(
    "panel_model",
    f"""WITH {_PANEL} SELECT k AS episode_id, CASE WHEN NOT no_label AND NOT no_axis THEN 'partial' END AS outcome, CASE WHEN NOT no_label AND NOT no_axis THEN 0.25::DOUBLE END AS confidence,
    CASE WHEN NOT no_label AND NOT no_axis THEN 'w' || k END AS friction, (CASE WHEN NOT no_label AND NOT no_axis THEN CASE WHEN k % 2 = 1 THEN 1 ELSE e END END)::INT AS efficiency,
    (CASE WHEN NOT no_label AND NOT no_axis THEN CASE WHEN k % 3 = 0 THEN q ELSE 5 END END)::INT AS quality, {_FAILED} AS errors FROM p""",
)


@query
def fresh_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the episodes that no stored label of equal key covers."""
    e = _episodes(spark, sf).withColumn("content_hash", F.sha2("rendered", 256))
    k = F.col("episode_id")
    old = e.where(k % 4 > 0).select(
        "episode_id", F.when(k % 4 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(L.prompt_hash(RUBRICS)).alias("prompt_hash"),
        F.lit(L.SCHEMA_VERSION).alias("schema_version"), F.when(k % 12 == 2, "m0").otherwise("m1").alias("model"), F.lit("1.0.0").alias("cli_version"),
    )
    got = L.fresh_labels(e, old, _CALLERS["outcome"], RUBRICS, "m1", "1.0.0")
    return got.select("episode_id", "content_hash", "model", F.get_json_object("label", "$.outcome").alias("outcome"), F.size("errors").alias("n_errors"))


oracle(
    "fresh_labels",
    f"""WITH {_PANEL} SELECT k AS episode_id, sha256(c_name || ' ' || c_mktsegment) AS content_hash, 'm1' AS model, CASE WHEN NOT no_label THEN outcome END AS outcome, CASE WHEN no_label THEN 12 ELSE 0 END AS n_errors
    FROM p JOIN customer ON k = c_custkey WHERE k % 4 <= 1 OR k % 12 = 2""",
)
