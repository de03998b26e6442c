"""URL filter by the ratio of two character language models.

Host and path rules decide the URLs that they fit. Those decisions are the examples from
which two variable-order Markov models of characters are estimated, one of accepted and one
of rejected URLs (Witten-Bell smoothing: each order falls back to the next shorter context).
A URL that no rule fits is judged by the difference of the two models' log-likelihoods per
character, calibrated on held-out examples by logistic regression on that difference.

The models are tables: counts of (context, next character) of all ruled URLs, each distinct
one once. The distinct windows of the URLs to judge meet them in joins, and a URL's ratio is the
sum over its windows, so neither the driver nor a task ever holds a model. At most about SAMPLE
examples of each verdict, chosen by hash, calibrate; only their ratios come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rules as (verdict, host, path); the longest fitting one wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: About so many examples of one verdict, at most, calibrate; the models count all.
SAMPLE = 20_000
#: Characters of the longest context, and what stands before a URL's first one.
ORDER = 5
START = "\x02"
#: Probability of any character without a model.
FLAT = 1 / 4096
#: Bits of a character's code, and characters that are looked up at a time.
BITS = np.int64(21)
STEP = 1 << 17


def windows(texts: list[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each row): for each character the `order` ones before it and itself, STEP rows at most at a time."""
    codes, owner, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(codes), np.concatenate(owner)

    for k, t in enumerate(texts):
        padded = np.frombuffer((START * order + t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        for a in range(0, len(t), STEP):
            part = np.lib.stride_tricks.sliding_window_view(padded[a : a + STEP + order], order + 1)
            if held and held + len(part) > STEP:
                yield joined()
                codes, owner, held = [], [], 0
            codes.append(part)
            owner.append(np.full(len(part), k))
            held += len(part)
    if held:
        yield joined()


def packed(codes: np.ndarray) -> pa.Table:
    """Windows of ORDER + 1 characters as two longs."""
    a, b = (codes[:, k] << 2 * BITS | codes[:, k + 1] << BITS | codes[:, k + 2] for k in (0, 3))
    return pa.table({"hi": a, "lo": b})


def calibrated(no: np.ndarray, yes: np.ndarray) -> tuple[float, float]:
    """(slope, shift): logistic regression of the verdict on the ratio, both verdicts weighing the same."""
    x = np.concatenate((no, yes))
    y = np.repeat((0.0, 1.0), (len(no), len(yes)))
    n = np.repeat((0.5 / len(no), 0.5 / len(yes)), (len(no), len(yes)))
    w, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
        v = n * np.maximum(p * (1 - p), 1e-6)
        gw, gb = -1e-3 * w + float(np.sum(n * (y - p) * x)), float(np.sum(n * (y - p)))
        hww, hwb, hbb = 1e-3 + float(np.sum(v * x * x)), float(np.sum(v * x)), 1e-6 + float(np.sum(v))
        det = hww * hbb - hwb * hwb
        if abs(det) < 1e-12:
            break
        w, b = w + max(-5.0, min(5.0, (hbb * gw - hwb * gb) / det)), b + max(-5.0, min(5.0, (hww * gb - hwb * gw) / det))
    return w, b


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to / ? # with A-Z lower-cased; the path up to ? or #."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substr(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the columns host and path; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


#: The four models: of accepted and of rejected URLs, each from the URLs that do not calibrate and from all.
MODELS = ("allow_taught", "allow", "block_taught", "block")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, blocked, taught) -> (hi, lo, and how often the window occurs in each model's URLs)."""
    for batch in batches:
        blocked, taught = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("blocked", "taught"))
        of = np.stack([(blocked == 0) & (taught == 1), blocked == 0, (blocked == 1) & (taught == 1), blocked == 1]).astype(np.int64)
        for codes, owner in windows(batch.column("url").to_pylist()):
            t = packed(codes)
            for name, own in zip(MODELS, of, strict=True):
                t = t.append_column(name, pa.array(own[owner]))
            t = t.group_by(["hi", "lo"], use_threads=False).aggregate([(c, "sum") for c in MODELS])
            yield from t.select(["hi", "lo", *[f"{c}_sum" for c in MODELS]]).rename_columns(["hi", "lo", *MODELS]).combine_chunks().to_batches()


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, url) -> (u, hi, lo, n): the windows of each URL and how often they occur in it."""
    for batch in batches:
        u = batch.column("u").to_numpy(zero_copy_only=False)
        for codes, owner in windows(batch.column("url").to_pylist()):
            t = packed(codes).append_column("u", pa.array(u[owner])).group_by(["u", "hi", "lo"], use_threads=False).aggregate([([], "count_all")])
            yield from t.select(["u", "hi", "lo", "count_all"]).rename_columns(["u", "hi", "lo", "n"]).combine_chunks().to_batches()


def _orders() -> Column:
    """For a window, of each order: (k, h, l, c), its last k + 1 characters as two longs, and c as l without the last."""
    one, two = 2 ** int(BITS) - 1, 2 ** (2 * int(BITS)) - 1
    out = []
    for k in range(ORDER + 1):
        h = F.lit(0).cast("long") if k < 3 else F.col("hi").bitwiseAND(F.lit((one, two, -1)[k - 3]).cast("long"))
        low = F.col("lo").bitwiseAND(F.lit((one, two, -1)[min(k, 2)]).cast("long"))
        out.append(F.struct(F.lit(k).alias("k"), h.alias("h"), low.alias("l"), (low - low.bitwiseAND(F.lit(one).cast("long"))).alias("c")))
    return F.array(*out)


#: Windows of a URL, about, for the number of files of a table.
A_URL = 32


def models(urls: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts) of (url, blocked, taught): counts by order k of characters after contexts, and each context's sum and kinds. rows: URLs there are, about."""
    size = None if rows is None else A_URL * rows
    counted = urls.mapInArrow(_count, f"hi long, lo long, {', '.join(f'{c} long' for c in MODELS)}").groupBy("hi", "lo").agg(*[F.sum(c).alias(c) for c in MODELS])
    grams = counted.select(F.explode(_orders()).alias("o"), *MODELS).groupBy("o.k", "o.h", "o.l", "o.c").agg(*[F.sum(m).alias(m) for m in MODELS])
    grams = C.written(grams, "grams", rows=size)
    contexts = grams.groupBy("k", "h", "c").agg(*[F.sum(m).alias(f"{m}_sum") for m in MODELS], *[F.count_if(F.col(m) > 0).alias(f"{m}_kinds") for m in MODELS])
    return grams, C.written(contexts, "contexts", rows=size)


def probabilities(asked: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """asked (hi, lo) with p: of the last character given those before it, by each of MODELS."""
    x = asked.select("hi", "lo", F.explode(_orders()).alias("o")).select("hi", "lo", "o.*")
    x = x.join(grams.drop("c"), ["k", "h", "l"], "left").join(contexts, ["k", "h", "c"], "left")

    def each(tail: str) -> Column:
        return F.array(*[F.coalesce(f"{m}{tail}", F.lit(0)).cast("double") for m in MODELS])

    level = F.struct("k", each("").alias("n"), each("_sum").alias("total"), each("_kinds").alias("kinds"))
    levels = F.sort_array(F.collect_list(level))  # one of each order

    def smoothed(p: Column, own: Column) -> Column:
        def one(q: Column, i: Column) -> Column:
            weight = F.get(own["total"], i) + F.get(own["kinds"], i)
            return F.when(weight > 0, (F.get(own["n"], i) + F.get(own["kinds"], i) * q) / weight).otherwise(q)

        return F.transform(p, one)

    start = F.array(*[F.lit(FLAT)] * len(MODELS))
    return x.groupBy("hi", "lo").agg(levels.alias("levels")).select("hi", "lo", F.aggregate("levels", start, smoothed).alias("p"))


def ratios(texts: DataFrame, grams: DataFrame, contexts: DataFrame, rows: int | None = None) -> DataFrame:
    """texts (u, url, ...) with taught and whole: the models' differences in log-likelihood per character; u tells rows apart."""
    own = C.written(texts.select("u", "url").mapInArrow(_windows_of, "u long, hi long, lo long, n long"), "windows", rows=None if rows is None else A_URL * rows)
    p = F.col("p")
    gains = probabilities(own.select("hi", "lo").distinct(), grams, contexts)
    gains = gains.select("hi", "lo", *[(F.log(F.get(p, F.lit(b))) - F.log(F.get(p, F.lit(a)))).alias(c) for c, a, b in (("taught", 0, 2), ("whole", 1, 3))])
    sums = own.join(gains, ["hi", "lo"]).groupBy("u").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("taught", "whole")])
    chars = F.greatest(F.length("url"), F.lit(1))
    return texts.join(sums, "u", "left").select(*texts.columns, *[(F.coalesce(c, F.lit(0.0)) / chars).alias(c) for c in ("taught", "whole")])


def scored(ruled: DataFrame, asked: DataFrame, sample: int) -> DataFrame | None:
    """(url, block_probability) of the distinct urls of asked, learned from all of (url, ruled); None without examples of both verdicts.

    One URL of five of each verdict, or fewer, calibrates models of the others. A verdict
    that would be left without URLs on either side uses all of them on both.
    """
    urls = ruled.select("url", (F.col("ruled") == "block").cast("int").alias("blocked")).distinct()
    sizes = {r["blocked"]: r["count"] for r in urls.groupBy("blocked").count().collect()}  # two rows
    n = sum(sizes.values())
    if len(sizes) < 2:
        return None
    one_of = {b: 5 * max(1, -(-n // (5 * max(sample, 1)))) for b, n in sizes.items()}
    every = F.when(F.col("blocked") == 1, F.lit(one_of[1])).otherwise(F.lit(one_of[0]))
    urls = C.written(urls.withColumn("held", F.pmod(F.xxhash64("url"), every) == 0), "ruled", rows=n)
    sides = {(r["blocked"], r["held"]) for r in urls.where("url <> ''").groupBy("blocked", "held").count().collect()}
    split = F.lit(False)
    for b in (0, 1):
        split = F.when(F.col("blocked") == b, F.lit({(b, True), (b, False)} <= sides)).otherwise(split)
    urls = urls.withColumns({"taught": (~(F.col("held") & split)).cast("int"), "calibrates": F.col("held") | ~split})
    texts = urls.where("calibrates").select("url", "blocked").unionByName(asked.select("url").distinct().withColumn("blocked", F.lit(-1)))
    m = asked.count()
    texts = C.written(texts.withColumn("u", F.monotonically_increasing_id()), "asked", rows=n + m)
    rated = C.written(ratios(texts, *models(urls.select("url", "blocked", "taught"), n), n + m), "ratios", rows=n + m)
    found = rated.where("blocked >= 0").select("blocked", "taught").toPandas()  # about 2 x sample rows
    side, ratio = found["blocked"].to_numpy(), found["taught"].to_numpy()
    slope, shift = calibrated(np.sort(ratio[side == 0]), np.sort(ratio[side == 1]))
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col("whole") + shift))
    return rated.where("blocked < 0").select("url", F.round(1 / (1 + F.exp(-odds)), 12).alias("block_probability"))


def judge_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every row.

    A null url, or one without ``://``, has empty host and path, so no rule fits. A url that no
    rule fits gets the models' verdict: block from a calibrated probability of one half on;
    without examples of both verdicts, and for a null url, allow. Rows are independent: repeats,
    nulls and further columns change nothing else; an empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    x = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(rules)
    x = x.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    asked = x.where("ruled is null and url is not null")
    found = scored(x.where("ruled is not null").select("url", "ruled"), asked, sample)
    none = F.lit(None).cast("double").alias("block_probability")
    made = ["page_id", "host", "path", "rule", "ruled", "block_probability"]
    if found is None:
        out = x.select(*made[:-1], none)
    else:
        settled = x.where("ruled is not null or url is null").select(*made[:-1], none)
        out = settled.unionByName(asked.join(found, "url").select(*made))
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_probability")
