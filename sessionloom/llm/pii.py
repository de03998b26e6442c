"""Personal data by weak supervision.

Patterns propose spans. Labelers of three sorts - the pattern's own form checks, gazetteers
(issuers, domains, calling codes) and the words around a span - vote yes, no or abstain.
Expectation-maximisation on the counts of vote patterns (bounded by kinds x 3 ** labelers)
estimates each labeler's reliability; its posteriors train a logistic span classifier on the
same bounded table, and that classifier decides on proposed spans. Spans of the base
patterns stay whatever it says. All work on rows is DataFrame expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import fit

KINDS = ("email", "ip", "card", "phone", "secret")

#: The patterns. Look-behinds and possessive repeats only spare the matcher
#: retries; a match begins where its first run of characters begins, or where the last ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HIDDEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = (
    r"(?<![A-Za-z0-9+/_-])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<=(?:assword|asswd|pwd|oken|ecret|PASSWORD|TOKEN|SECRET|[_-]key|_KEY)[\x22']?\x20{0,2}[=:]\x20{0,2}[\x22']?)[A-Za-z0-9+/_-]{8,}+)"
)
IP_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|br|mx|ar|au|jp|cn|in"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|60|64|65|62)"
CALLING_CODES = r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-8])"
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|ruf",
    "secret": "pass|pwd|token|secret|key|login",
}
NEGATIVE_CONTEXT = r"(?i)(?:version|release|isbn|page|chapter|section|license|v)\.?\x20?$"
LABELERS = ("form", "gazetteer", "context", "edges", "texture")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _base_check(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(IP_RANGE)
    digits = _digits(m)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


#: Proposal name: (pattern, kind, plain strings of which a text must hold one - "0" stands for any digit -, whether base checks apply).
PROPOSALS = {
    "email": (EMAIL, "email", ("@",), True),
    "ip": (IP, "ip", ("0",), True),
    "card": (CARD, "card", ("0",), True),
    "phone": (PHONE, "phone", ("+",), True),
    "hidden": (HIDDEN_EMAIL, "email", ("at)", "at]"), False),
    "local": (LOCAL_PHONE, "phone", ("0",), False),
    "secret": (SECRET, "secret", ("=", ":", "AKIA"), False),
}
SPAN = "array<struct<s:int,k:int,e:int,base:boolean,form:int,gazetteer:int,context:int,edges:int,texture:int>>"


def _vote(no: Column, yes: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _span(kind: str, base: bool, m: Column, s: Column, before: Column, after: Column) -> Column:
    k = KINDS.index(kind)
    sound = _base_check(kind, m) if base else F.lit(False)
    digits = _digits(m)
    if base:
        form = F.when(sound, 1).otherwise(-1)
    elif kind == "secret":
        form = _vote(F.length(m) < 12, m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    else:
        form = F.lit(1 if kind == "email" else 0)
    gazetteer = {
        "email": lambda: _vote(F.lit(True), m.rlike(rf"(?i)[.)\] ](?:{DOMAINS})$")),
        "ip": lambda: _vote(m.rlike("^(?:0|127)\\."), ~m.rlike(r"^(?:10|192\.168)\.")),
        "card": lambda: _vote(F.lit(True), digits.rlike(ISSUERS)),
        "phone": lambda: _vote(F.lit(False), m.rlike(CALLING_CODES)),
        "secret": lambda: _vote(F.lit(False), m.rlike("^AKIA")),
    }[kind]()
    context = _vote(before.rlike(NEGATIVE_CONTEXT), before.rlike(rf"(?i)(?:{CONTEXT[kind]})"))
    edges = _vote(F.lit(True), ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]"))
    texture = _vote(m.rlike(r"(.)\1{5}"), m.rlike("[0-9]") & (F.length(m) >= 7))
    return F.struct(
        s.cast("int").alias("s"), F.lit(k).alias("k"), (s + F.length(m)).cast("int").alias("e"), (sound if base else F.lit(False)).alias("base"),
        *[v.cast("int").alias(x) for x, v in zip(LABELERS, (form, gazetteer, context, edges, texture), strict=True)],
    )


def proposed(docs: DataFrame) -> DataFrame:
    """(row, spans): the rows of docs as structs, and all proposals of their texts with base flag and votes."""
    x = docs.select(F.struct(*[F.col(C.quoted(c)) for c in docs.columns]).alias("row"))
    x = x.withColumn("body", F.coalesce(F.col("row")["text"], F.lit("")))
    x = x.withColumn("digits", F.col("body").rlike("[0-9]"))
    found = {}
    for name, (pattern, _, needs, _) in PROPOSALS.items():
        holds = F.col("digits") if needs == ("0",) else reduce(Column.__or__, [F.col("body").contains(n) for n in needs])
        found[f"m_{name}"] = F.when(holds, F.regexp_extract_all("body", F.lit(pattern), 0))
    x = x.withColumns(found)
    pieces = {}
    for name, (pattern, *_) in PROPOSALS.items():
        parts = F.transform(F.split("body", pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(24)).alias("tail"), F.left(p, F.lit(1)).alias("head")))
        pieces[f"p_{name}"] = F.when(F.size(f"m_{name}") > 0, parts)
    x = x.select("row", *found, *[v.alias(k) for k, v in pieces.items()])

    def located(name: str) -> Column:
        """(start, index) of each match: what the pieces and matches before it take."""
        ms, ps = F.col(f"m_{name}"), F.col(f"p_{name}")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.get(ps, i)["n"]
            return F.struct((s + F.length(F.get(ms, i))).alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))

        return F.when(F.size(ms) > 0, F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), start, step)["out"])

    x = x.select("row", *found, *pieces, *[located(n).alias(f"s_{n}") for n in PROPOSALS])

    def voted(name: str, kind: str, base: bool):
        ms, ps = F.col(f"m_{name}"), F.col(f"p_{name}")
        return lambda s, i: _span(kind, base, F.get(ms, i), s, F.get(ps, i)["tail"], F.get(ps, i + 1)["head"])

    lists = []
    for name, (_, kind, _, base) in PROPOSALS.items():
        spans = F.transform(f"s_{name}", voted(name, kind, base))
        if kind in ("ip", "phone") and base:
            spans = F.filter(spans, lambda c: c["base"])
        elif kind == "card":
            spans = F.filter(spans, lambda c: c["base"] | (c["e"] - c["s"]).between(12, 24))
        lists.append(F.coalesce(spans, F.array()).cast(SPAN))
    return x.select("row", F.concat(*lists).alias("spans"))


def _features(k: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(k == i) for i in range(1, len(KINDS))], *map(float, votes)]


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    n = len(b)
    a = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def train(rows: list[tuple[int, tuple[int, ...], int]], ridge: float = 1.0, rounds: int = 25) -> list[float]:
    """Weights of the span classifier from (kind, votes, count) rows: EM posteriors, then ridge logistic regression."""
    start = {-1: (0.05, 0.5), 0: (0.25, 0.3), 1: (0.7, 0.2)}
    prior, table = fit([(votes, n) for _, votes, n in rows], start=start)
    soft = []
    for k, votes, n in rows:
        odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, votes, strict=True))
        soft.append((_features(k, votes), 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), n))
    width = len(KINDS) + len(LABELERS)
    w = [0.0] * width
    for _ in range(rounds):
        h = [[ridge * (i == j) for j in range(width)] for i in range(width)]
        g = [-ridge * x for x in w]
        for x, y, n in soft:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i in range(width):
                g[i] += n * (y - p) * x[i]
                for j in range(width):
                    h[i][j] += n * max(p * (1 - p), 1e-6) * x[i] * x[j]
        w = [a + b for a, b in zip(w, _solve(h, g), strict=True)]
    return w


def weights(spans: DataFrame) -> list[float]:
    """The span classifier's weights, from the counts of vote patterns in a column `spans`."""
    one = F.col("c")
    # explode_outer: for explode() the planner would filter on the size of the array first, and find all spans twice.
    rows = spans.select(F.explode_outer("spans").alias("c")).where("c is not null").groupBy(one["k"].alias("k"), *[one[v].alias(v) for v in LABELERS]).count().collect()  # at most kinds x 3 ** labelers
    return train(sorted((r["k"], tuple(r[v] for v in LABELERS), r["count"]) for r in rows))


def decided(table: DataFrame, w: list[float]) -> DataFrame:
    """table, which has spans, with `base` spans and `all`: these and what the classifier accepts, as sorted struct(s, k, e, base)."""

    def accepted(c: Column) -> Column:
        odds = F.lit(w[0])
        for i in range(1, len(KINDS)):
            odds = odds + F.when(c["k"] == i, w[i]).otherwise(0.0)
        for v, x in zip(LABELERS, w[len(KINDS) :], strict=True):
            odds = odds + c[v] * F.lit(x)
        return odds >= 0

    def plain(c: Column) -> Column:
        return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))

    base = table.withColumn("base", F.filter("spans", lambda c: c["base"]))
    more = F.filter("spans", lambda c: ~c["base"] & accepted(c) & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])))
    return base.withColumn("all", F.sort_array(F.transform(F.concat("base", more), plain)))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"], c["e"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every document.

    Counts and base_sha256 are of the base spans; spans holds these and what the classifier
    adds, ``kind:start:end`` in code points by start, then kind, and n_spans their number. Null text is empty: zero
    counts, the hash of the empty string, empty spans. Repeated rows and null ids come back
    as they are; other columns are ignored; an empty table gives an empty result.
    """
    spans = C.written(proposed(docs.select("doc_id", "text")).select(F.col("row")["doc_id"].alias("doc_id"), "spans"), "pii")
    x = decided(spans, weights(spans))

    def of_kind(i: int):
        return lambda c: c["k"] == i

    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return x.select("doc_id", *counts, F.sha2(_text(F.filter("all", lambda c: c["base"])), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of find_pii replaced by its kind in brackets; overlaps become one.

    Null text stays null, texts without a span stay as they are, and so do all other columns,
    whatever their names; repeated rows stay. The spans are found twice, once to count votes
    and once to cut, so nothing but those counts is shuffled or stored and no row carries a copy of its text.
    """
    x = decided(proposed(docs), weights(proposed(docs.select("text"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row")["text"]

    def step(acc: Column, c: Column) -> Column:
        gap = F.when(c["s"] > acc["at"], F.substr(text, acc["at"] + 1, c["s"] - acc["at"])).otherwise(F.lit(""))
        mark = F.when(c["s"] >= acc["at"], F.get(names, c["k"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("all") > 0, cut).otherwise(text)
    return x.select(*[new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
