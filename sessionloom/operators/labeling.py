"""The labeler boundary: what goes out is redacted, what comes back is checked, one retry, a panel and its consolidation.

A caller is any function from an iterator of (episode_id, prompt) frames to an iterator of
(episode_id, answer) frames; it runs in mapInPandas on the episodes that no stored label
covers. Every set of answers is checkpointed before it is read twice, so a caller - a paid
model, perhaps - is asked once for each prompt. Nothing here calls a model.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.privacy import sanitize
from .episodes import RENDER_CAP
from .store import CACHE_KEY, consolidate, label_errors, not_yet_labeled, once, spread, valid_score

Caller = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
COST_A_CALL, EPISODES_A_SESSION = 0.4, 3
#: The frame of a prompt, what a retry adds, and the versions that hashes fold in.
EPISODE_HEAD, EPISODE_FOOT, ONLY_JSON = "\n\n--- EPISODE ---\n", "\n\nEPISODE_ID: ", "\nReturn ONLY the JSON object."
NUDGE = "Your previous output was invalid JSON or was missing required fields. Output ONLY a single valid JSON object that matches the schema exactly — no prose, no markdown code fences."
PRIVACY_VERSION, SCHEMA_VERSION = "1", "1"

AXIS = "struct<score:int,rationale:string,evidence:array<string>>"
LABEL = (
    "struct<task_type:string,task_difficulty:string,outcome:string,outcome_confidence:double,workflow_pattern:array<string>,good_practices:array<string>,"
    "friction_points:array<struct<what:string,evidence:string>>,root_cause:string,outcome_evidence:array<string>,"
    "skill_opportunity:struct<worth_codifying:boolean,type:string,rationale:string>>"
)


@dataclass(frozen=True)
class Rubrics:
    """The texts that a judge, or a panel of three and a consolidator, is given."""

    outcome: str
    efficiency: str = ""
    quality: str = ""
    consolidator: str = ""


def prompt_hash(rubrics: Rubrics, privacy: str = PRIVACY_VERSION) -> str:
    """The cache's discriminator of a single judge: its rubric and, from version 2 on, the privacy rules."""
    text = rubrics.outcome + (f" privacy:{privacy}" if privacy != "1" else "")
    return hashlib.sha256(text.encode()).hexdigest()


def panel_hash(rubrics: Rubrics, models: list[str], privacy: str = PRIVACY_VERSION) -> str:
    """The cache's discriminator of a panel: a tag, its four rubrics, the models and the privacy rules."""
    text = "panel:v1|" + rubrics.outcome + rubrics.efficiency + rubrics.quality + rubrics.consolidator + "|models:" + ",".join(models) + "|privacy:" + privacy
    return hashlib.sha256(text.encode()).hexdigest()


def prompt(rubric: str, rendered: Column, episode_id: Column, nudge: bool = False) -> Column:
    """Rubric, episode, its id and, on a retry, the nudge."""
    return F.concat(F.lit(rubric + EPISODE_HEAD), rendered, F.lit(EPISODE_FOOT), episode_id.cast("string"), F.lit(ONLY_JSON + (f"\n\n{NUDGE}" if nudge else "")))


def answered(answer: Column) -> Column:
    """The first JSON object of an answer as VARIANT; null if there is none that parses."""
    return F.try_parse_json(T.json_object(answer))


def kind_of(v: Column, path: str, none: str = "") -> Column:
    """The kind of a VARIANT's value at a path; none where there is no value."""
    return F.coalesce(F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant")), F.lit(none))


def is_object(v: Column) -> Column:
    """Whether a VARIANT holds an object; its fields are not looked into."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def assessment_errors(v: Column) -> Column:
    """What an assessment breaks: a whole score from 1 to 5, a rationale, a list of evidence."""
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("missing"))
    rules = [("score", valid_score(v, "$.score")), ("rationale", kind("$.rationale") == "STRING"), ("evidence", kind("$.evidence").rlike("^ARRAY<(?:STRING|VOID)>$"))]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def asked(rows: DataFrame, caller: Caller, ask: Callable[[bool], Column], errors: Callable[[Column], Column]) -> DataFrame:
    """(episode_id, answer, errors): the caller's answer to ask(False); where it breaks a rule, that to ask(True). rows keep their columns out of it.

    An episode that the caller gives no answer for has the error `no answer`.
    """
    kind = rows.schema["episode_id"].dataType.simpleString()

    def call(some: DataFrame, nudge: bool) -> DataFrame:
        said = some.select("episode_id", ask(nudge).alias("prompt")).mapInPandas(caller, f"episode_id {kind}, answer string")
        own = some.select("episode_id").join(said.dropDuplicates(["episode_id"]), "episode_id", "left")
        broken = F.when(F.col("answer").isNull(), F.array(F.lit("no answer"))).otherwise(T.bound(answered(F.col("answer")), errors))
        return once(own.withColumn("errors", broken))

    first = call(rows, False)
    again = call(rows.join(first.where("size(errors) > 0").select("episode_id"), "episode_id", "left_semi"), True)
    return first.where("size(errors) = 0").unionByName(again)


def outgoing(episodes: DataFrame) -> DataFrame:
    """(episode_id, rendered): the views as they may leave."""
    return sanitize(episodes, "rendered").select("episode_id", F.col("clean_text").alias("rendered"))


def label(episodes: DataFrame, caller: Caller, rubric: str = "") -> DataFrame:
    """(episode_id, label, errors) of redacted views; a label that breaks a rule is asked for once more."""
    rows = once(outgoing(spread(episodes)))
    got = asked(rows, caller, lambda nudge: prompt(rubric, F.col("rendered"), F.col("episode_id"), nudge), label_errors)
    return got.select("episode_id", T.json_object(F.col("answer")).alias("label"), "errors")


def fresh_labels(episodes: DataFrame, stored: DataFrame, caller: Caller, rubrics: Rubrics, model: str, cli_version: str) -> DataFrame:
    """label() for the episodes that stored labels of equal content, rubric, schema, model and version do not cover, with their cache key.

    episodes: episode_id, content_hash, rendered. stored: CACHE_KEY and more.
    """
    key = {"prompt_hash": prompt_hash(rubrics), "schema_version": SCHEMA_VERSION, "model": model, "cli_version": cli_version}
    todo = not_yet_labeled(episodes.withColumns({k: F.lit(v) for k, v in key.items()}), stored)
    return label(todo, caller, rubrics.outcome).join(todo.select(*CACHE_KEY), "episode_id")


def _as(answer: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(answered(answer), path, kind)


def _failed_at(name: str, got: DataFrame) -> DataFrame:
    return got.where("size(errors) > 0").select("episode_id", F.transform("errors", lambda e: F.concat(F.lit(f"{name}: "), e)).alias("errors"))


def panel(episodes: DataFrame, callers: dict[str, Caller], rubrics: Rubrics) -> DataFrame:
    """(episode_id, label, efficiency, quality, errors): the outcome judge's label, the two axes, reconciled.

    callers: outcome, efficiency, quality and, if a model consolidates, consolidator; without
    one the quality veto does (see store.consolidate). Each call is asked of the episodes that
    passed the one before, with one retry; an axis that the consolidator drops or breaks is the
    judged one. errors names the call an episode failed at and is empty for the others.
    """
    rows = once(outgoing(spread(episodes)))
    errors = {"outcome": label_errors, "efficiency": assessment_errors, "quality": assessment_errors}
    done, failed = rows, []
    for name, rules in errors.items():
        rubric = getattr(rubrics, name)
        got = asked(done.select("episode_id", "rendered"), callers[name], lambda nudge, r=rubric: prompt(r, F.col("rendered"), F.col("episode_id"), nudge), rules)
        failed.append(_failed_at(name, got))
        done = done.join(got.where("size(errors) = 0").select("episode_id", F.col("answer").alias(name)), "episode_id")
    done = once(done)
    axes = {n: _as(F.col(n), AXIS).alias(n) for n in ("efficiency", "quality")}
    if "consolidator" in callers:

        def ask(nudge: bool) -> Column:
            verdicts = [F.concat(F.lit(f"\n\n--- {n.upper()} VERDICT (JSON) ---\n"), T.json_object(F.col(n))) for n in errors]
            return F.concat(F.lit(rubrics.consolidator), *verdicts, prompt("", F.left("rendered", F.lit(RENDER_CAP)), F.col("episode_id"), nudge))

        got = asked(done, callers["consolidator"], ask, label_errors)
        failed.append(_failed_at("consolidator", got))
        final = got.where("size(errors) = 0").select("episode_id", F.col("answer").alias("final"))
        done = done.join(final, "episode_id")
        own = {n: F.when(F.size(assessment_errors(F.try_variant_get(answered(F.col("final")), f"$.{n}", "variant"))) == 0, _as(F.col("final"), AXIS, f"$.{n}")) for n in axes}
        out = done.select("episode_id", _as(F.col("final"), LABEL).alias("label"), *[F.coalesce(own[n], axes[n]).alias(n) for n in axes])
    else:
        out = done.select("episode_id", _as(F.col("outcome"), LABEL).alias("label"), *axes.values())
        outcome, confidence = consolidate(F.col("label.outcome"), F.col("label.outcome_confidence"), F.col("quality.score"))
        out = out.withColumn("label", F.col("label").withField("outcome", outcome).withField("outcome_confidence", confidence))
    out = out.withColumn("errors", F.array().cast("array<string>"))
    for f in failed:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stand_in(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A caller that gives a fixed label by the length of the view."""
    for f in frames:
        labels = []
        for text in f["prompt"]:
            view = re.search(f"{re.escape(EPISODE_HEAD)}(.*){re.escape(EPISODE_FOOT)}", text, re.DOTALL)
            done = len(view[1] if view else text) % 3
            labels.append(
                json.dumps(
                    {
                        "task_type": "feature", "task_difficulty": "moderate", "outcome": ("success", "partial", "failed")[done], "outcome_confidence": 0.5,
                        "workflow_pattern": ["read", "edit"], "good_practices": [], "friction_points": [], "root_cause": "", "outcome_evidence": [],
                        "skill_opportunity": {"worth_codifying": False, "type": "none", "rationale": ""},
                    }
                )
            )
        yield pd.DataFrame({"episode_id": f["episode_id"], "answer": labels})


def estimated_cost(sessions: int, most_episodes: int, panel: bool) -> float:
    """Dollars that a run may take: episodes bounded by three a session, four calls each for a panel."""
    return min(most_episodes, sessions * EPISODES_A_SESSION) * COST_A_CALL * (4 if panel else 1)
