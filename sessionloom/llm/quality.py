"""Quality rules by weak supervision.

Rules vote good, bad or abstain on each document. Votes are counted by pattern (at most
3 ** len(RULES) of them, whatever the corpus), expectation-maximisation on these counts
estimates how each rule votes on good and on bad documents, and a document's posterior
probability of being good decides. All work on rows is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = r"[\x20\t-\r]+"
#: Common function words of the languages the rules know.
FUNCTION_WORDS = (
    "the of and to in is was for that it with as on be at by this are from or an not "
    "der die das und ist von zu mit den für auf ein eine nicht dem im "
    "le la les de des et est un une que qui dans pour sur par du en "
    "el los las y del una con por su para no se al"
).split()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, counts of each text): row is a struct of the columns in `keep`; null text counts as empty."""
    words = docs.select(
        F.struct(*[F.col(C.quoted(c)) for c in keep]).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    n = F.size("words")
    lines = words.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\t-\r]")).alias("lines"),
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    ranked = lines.withColumn(
        "ranked",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )

    def met(s: Column, i: Column) -> Column:
        return F.coalesce((F.get("ranked", i - 1)["g"] == s["g"]) | (F.get("ranked", i + 1)["g"] == s["g"]), F.coalesce(F.get("ranked", i + 1)["g"] == s["g"], F.get("ranked", i - 1)["g"] == s["g"], F.lit(False)))

    twice = F.transform(F.filter("ranked", met), lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))
    return ranked.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("ranked").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(twice)))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_capitals",
        "n_exclaims",
        "n_function_words",
        "n_distinct",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(x: str, y: str) -> Column:
    return F.col(x) / F.greatest(F.col(y), F.lit(1))


def rules() -> dict[str, Column]:
    symbols, capitals = _share("n_symbols", "n_words"), _share("n_capitals", "word_chars")
    exclaims, repeats = _share("n_exclaims", "n_words"), _share("n_repeat_words", "n_words")
    copies, known = _share("n_dup_lines", "n_lines"), _share("n_function_words", "n_words")
    length, varied = _share("word_chars", "n_words"), _share("n_distinct", "n_words")
    long = F.col("n_words") >= MIN_WORDS
    return {
        "symbols": _rule(symbols > 0.15, symbols < 0.05),
        "capitals": _rule(capitals > 0.4, (capitals < 0.2) & (F.col("word_chars") > 0)),
        "exclaims": _rule(exclaims > 0.2, exclaims < 0.05),
        "repeats": _rule(repeats > 0.5, repeats < 0.2),
        "copied_lines": _rule(copies > 0.5, (copies < 0.2) & (F.col("n_lines") > 2)),
        "function_words": _rule(long & (known < 0.01), known > 0.04),
        "word_length": _rule((length > 14) | (length < 2), (length > 3) & (length < 10)),
        "variety": _rule(long & (varied < 0.15), varied > 0.3),
        "words": _rule(F.col("n_words") < 5, F.col("n_words") >= 2 * MIN_WORDS),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, strength: float = 20.0, start: dict[int, tuple[float, float]] | None = None) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on vote patterns and their counts: (prior of good, per rule P(vote | good), P(vote | bad)).

    The start believes that a bad vote is rare on good documents and that a good vote says
    little, as each rule knows one fault; that belief weighs as `strength` documents, so a
    table with votes of one kind only keeps its meaning.
    """
    width = len(patterns[0][0]) if patterns else 0
    start = start or {-1: (0.005, 0.3), 0: (0.245, 0.2), 1: (0.75, 0.5)}
    prior, table = 0.8, [dict(start) for _ in range(width)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good_sum = 0.0
        sums = [{v: [0.0, 0.0] for v in (-1, 0, 1)} for _ in range(width)]
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(votes))
            good = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_sum += n * good
            for j, v in enumerate(votes):
                sums[j][v][0] += n * good
                sums[j][v][1] += n * (1 - good)
        prior = (good_sum + 0.8 * strength) / (total + strength)
        table = [
            {v: tuple((sums[j][v][k] + strength * start[v][k]) / ((good_sum, total - good_sum)[k] + strength) for k in (0, 1)) for v in (-1, 0, 1)}
            for j in range(width)
        ]
    return prior, table


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns in `keep`), features, base_failed, quality (posterior probability of good) and kept of every document."""
    names = list(rules())
    table = C.written(features(docs, keep), "features").withColumns(rules())
    counts = table.groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    prior, fitted = fit(sorted((tuple(r[k] for k in names), r["count"]) for r in counts))
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, votes in zip(names, fitted, strict=False):
        ratio = {v: math.log(votes[v][0] / votes[v][1]) for v in votes}
        odds = odds + F.when(F.col(k) == 1, ratio[1]).when(F.col(k) == -1, ratio[-1]).otherwise(ratio[0])
    return table.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: base counts, base_failed, kept, quality.

    Null or empty text has no words and fails; repeated rows and null ids are returned as
    they are; other columns are ignored; an empty table gives an empty result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged(docs, ["doc_id"]).select(F.col("row")["doc_id"].alias("doc_id"), *made)


def quality_filtered(docs: DataFrame) -> DataFrame:
    """docs without the documents that the verdict rejects; all columns, repeated rows and null ids stay.

    The rows are written beside their counts and read again once the rules' accuracies are
    known: no text is shuffled or joined.
    """
    return judged(docs, docs.columns).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
