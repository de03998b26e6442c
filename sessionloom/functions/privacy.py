"""The privacy gate: credentials are dropped, then personal identifiers masked, rule by rule.

Each rule sees the text that the rules before it have left; a rule hits if it matches there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import B, S

#: Rule name, pattern, replacement - first the credential rules, then the identifier rules.
CREDENTIAL_RULES = [
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----[\s\S]*?-----END[^-]*-----", "[REDACTED-PRIVATE-KEY]"),
    ("password_kv", rf"(?i){B}(?:pass(?:word|wd)?|mat{S}?khau|mk|pwd){B}{S}*[:=]{S}*[^\s]+", "[REDACTED-PASSWORD]"),
    ("api_key_kv", rf"(?i){B}(?:api[_\- ]?key|secret[_\- ]?key|access[_\- ]?key|client[_\- ]?secret|auth[_\- ]?token|token){B}{S}*[:=]{S}*[^\s]+", "[REDACTED-APIKEY]"),
    ("bearer_hdr", rf"(?i)bearer{S}+[A-Za-z0-9._\-]{{12,}}", "[REDACTED-BEARER]"),
    ("basic_hdr", rf"(?i)basic{S}+[A-Za-z0-9+/=]{{16,}}", "[REDACTED-BASIC]"),
    ("known_secret", rf"{B}(?:sk-[A-Za-z0-9_\-]{{12,}}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{{12,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{12,}}|AIza[0-9A-Za-z_\-]{{20,}}|xox[baprs]-[A-Za-z0-9\-]{{10,}}|glpat-[A-Za-z0-9_\-]{{16,}}){B}", "[REDACTED-SECRET]"),
    ("conn_string", rf"(?i){B}(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqp)://[^\s\"']+", "[REDACTED-CONNSTRING]"),
    ("jwt", rf"{B}eyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}{B}", "[REDACTED-JWT]"),
]
IDENTIFIER_RULES = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("vn_id", rf"{B}[0-9]{{12}}{B}|{B}[0-9]{{9}}{B}", "[ID]"),
    ("vn_phone", r"(?:(?:\+?84)|0)(?:[0-9][ \-.]?){8,10}[0-9]", "[PHONE]"),
    ("bank_acct", rf"{B}[0-9]{{8,19}}{B}", "[ACCT]"),
    ("money", rf"(?iu)\${S}?[0-9][0-9.,]{{2,}}|{B}[0-9][0-9.,]{{2,}}{S}?(?:vnd|vnđ|đ|usd|\$)", "[MONEY]"),
    ("cust_code", rf"(?i){B}(?:KH|HD|MKH|CUS|INV)[\-_]?[0-9]{{4,}}{B}", "[CODE]"),
]
RULES = CREDENTIAL_RULES + IDENTIFIER_RULES

#: What a lower-cased text must hold for a rule to match at all: one string of each group.
NEEDS: dict[str, list[list[str]]] = {
    "private_key": [["-----begin"]],
    "password_kv": [["pass", "khau", "mk", "pwd"], [":", "="]],
    "api_key_kv": [["key", "secret", "token"], [":", "="]],
    "bearer_hdr": [["bearer"]],
    "basic_hdr": [["basic"]],
    "known_secret": [["sk-", "k_live_", "k_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "akia", "aiza", "xox", "glpat-"]],
    "conn_string": [["://"]],
    "jwt": [["eyj"]],
    "email": [["@"]],
    "money": [["$", "vnd", "vnđ", "đ", "usd"]],
    "cust_code": [["kh", "hd", "cus", "inv"]],
}
#: What a text must hold for any rule to match; each rule's own need is an alternative.
SOME = r"[:=@]|[0-9][0-9.,]{2}|[0-9](?:[ \-.]?[0-9]){8}|-----BEGIN|(?i:bearer|basic)|sk-|[srp]k_(?:live|test)_|gh[pousr]_|AKIA|AIza|xox[baprs]-|glpat-|eyJ"
#: Runs of digits, with their separators, that a rule needs.
DIGITS = {"vn_id": r"[0-9]{9}", "vn_phone": r"[0-9](?:[ \-.]?[0-9]){8}", "bank_acct": r"[0-9]{8}", "money": r"[0-9][0-9.,]{2}", "cust_code": r"[0-9]{4}"}


def _may_match(name: str, low: Column) -> Column:
    out = F.lit(True)
    for group in NEEDS.get(name, []):
        some = F.lit(False)
        for w in group:
            some = some | low.contains(w)
        out = out & some
    return out & low.rlike(DIGITS[name]) if name in DIGITS else out


def sanitize(df: DataFrame, column: str = "text") -> DataFrame:
    """df with clean_text, hits (rule names in order), had_credential and n_strong_pii of `column` (null: empty).

    The rules run as one projection each, so that a rule's text is built once. As long as no
    rule has hit, a rule runs only on texts that hold the plain strings it needs.
    """
    df = df.withColumn("_t0", F.coalesce(F.col(column), F.lit(""))).withColumn("_low", F.lower("_t0"))
    may = {name: _may_match(name, F.col("_low")) for name, _, _ in RULES}
    df = df.withColumn("_may", F.array(*may.values()))
    df = df.withColumn("_any", F.exists("_may", lambda m: m))
    for i, (_, pattern, mask) in enumerate(RULES):
        now = F.col(f"_t{i}")
        tried = F.col("_any") & (F.get("_may", F.lit(i)) | (now != F.col("_t0")))
        df = df.withColumn(f"_t{i + 1}", F.when(tried, F.regexp_replace(now, pattern, mask.replace("$", r"\$"))).otherwise(now))
    hits = F.array_compact(F.array(*[F.when(F.col(f"_t{i}") != F.col(f"_t{i + 1}"), F.lit(n)) for i, (n, _, _) in enumerate(RULES)]))
    df = df.withColumn("clean_text", F.col(f"_t{len(RULES)}")).withColumn("hits", hits)
    df = df.drop(*[f"_t{i}" for i in range(len(RULES) + 1)], "_low", "_may", "_any")
    credential, strong = (_among(F.col("hits"), rules) for rules in (CREDENTIAL_RULES, IDENTIFIER_RULES))
    return df.withColumns({"had_credential": credential > 0, "n_strong_pii": strong})


def _among(hits: Column, rules: list) -> Column:
    return F.size(F.array_intersect(hits, F.array(*[F.lit(n) for n, _, _ in rules]))).cast("bigint")


def opted_out(text: Column, markers: list[str]) -> Column:
    """The first marker that the lower-cased text holds; null if none."""
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        out = F.when(F.lower(text).contains(m), F.lit(m)).otherwise(out)
    return out
