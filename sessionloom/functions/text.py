"""Text functions of the turn classifier and the miner, as Column expressions.

Regular expressions use an ASCII word boundary and the JavaScript white-space class, so
accented text gives the same result on every engine. Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary, and white space as ECMAScript defines it.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
S = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

INTERRUPT_MARKER = "[Request interrupted by user]"
#: Word and phrase lists of the classifier.
APPROVALS = ["ok", "okay", "yes", "yep", "yeah", "go", "go ahead", "continue", "lgtm", "perfect", "great", "thanks", "thank you", "do it", "sounds good", "proceed", "👍"]
CORRECTIONS = ["no ", "no,", "nope", "actually", "instead", "wait", "that's wrong", "thats wrong", "wrong", "revert", "undo", "not ", "don't", "dont", "stop"]
LOG_TOKENS = ["rsync:", "xfer#", "to-check=", "reset by peer", "broken pipe", "client_loop:", "traceback (most recent call last)", "send disconnect", "connection reset", "permission denied (publickey"]
REQUEST_CUES = ["?", "can you", "could you", "please", "let", "write", "add", "create", "make", "fix", "update", "remove", "implement", "how", "why", "what", "should", "i want", "i need", "i think"]
STOPWORDS = (
    "the a an and or but to of in on for with is it this that i you we u me my your can should add also do let make "
    "update use using need want will be are now just some each its have has not no yes go ok fix"
).split()
#: Canonical task types by pattern, the first that matches wins.
TASK_TYPES = [
    (r"^(bug ?fix|fix ?bug|bug|fixe?s?|fixing|defect|hotfix|patch)$", "bug fix"),
    (r"^(feature|feature implementation|new feature|implement(ation)?|build feature)$", "feature"),
    (r"^(refactor(ing)?|cleanup|clean up|restructur(e|ing))$", "refactor"),
    (r"^(test(ing)?|add tests?|unit tests?|write tests?)$", "testing"),
    (r"^(docs?|documentation|document(ing)?|readme)$", "documentation"),
    (r"^(config(uration)?|setup|set up|configure)$", "configuration"),
    (r"^(deploy(ment)?|release|ship(ping)?|publish)$", "deployment"),
    (r"^(perf(ormance)?|optimiz(e|ation)|speed ?up)$", "performance"),
    (r"^(research|investigat(e|ion)|explore|exploration|spike)$", "research"),
    (r"^(review|code review|pr review)$", "review"),
    (r"^(question|q ?and ?a|qa|ask|query)$", "question"),
    (r"^(ui|ux|ui ?\/? ?ux|styling|style|css|design)$", "ui"),
    (r"^(data|data analysis|analysis|analytics)$", "data analysis"),
]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value built once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(x: Column, words: list[str], test: str = "contains") -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (x.contains(w) if test == "contains" else x.startswith(w))
    return out


def js_trim(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def one_line(x: Column, n: int = 100) -> Column:
    return F.left(js_trim(F.regexp_replace(x, f"{S}+", " ")), F.lit(n))


def normalize_ack(x: Column) -> Column:
    return js_trim(F.regexp_replace(F.lower(x), f"(?:{S}|[.!,])+$", ""))


def is_approval(x: Column) -> Column:
    def said(norm: Column) -> Column:
        words = F.split(norm, f"{S}+")
        return norm.isin(APPROVALS) | ((F.length(norm) <= 20) & (F.size(words) <= 3) & F.forall(words, lambda w: w.isin(APPROVALS)))

    return F.when(F.length(x).between(1, 40), bound(normalize_ack(x), said)).otherwise(F.lit(False))


def is_correction(x: Column) -> Column:
    def starts(t: Column) -> Column:
        return t.isin("no", "nope") | _any(t, CORRECTIONS, "startswith") | t.rlike(f"^still{B}")

    return bound(F.lower(F.left(js_trim(x), F.lit(24))), starts)  # longer than any of the phrases


def is_continuation_cue(x: Column) -> Column:
    t = js_trim(F.lower(x))
    return t.rlike(f"^(?:also|then|plus){B}") | t.rlike(f"^and{S}+")


def has_request_cue(x: Column) -> Column:
    return bound(F.lower(x), lambda t: _any(t, REQUEST_CUES))


def is_paste(x: Column) -> Column:
    """Pasted output: log tokens, shell echoes, stack frames, listings, process tables, or mostly non-letter lines.

    Plain string tests stand before the patterns that need them, and lines are trimmed once.
    """

    def listed(s: Column) -> Column:
        load = s.contains("%") & s.rlike(rf"{B}[0-9]{{2,}}%{B}.*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}")
        return (F.left(s, F.lit(1)).isin("-", "d") & s.rlike(r"^[-d][rwx-]{9}")) | load

    def table_row(s: Column) -> Column:
        def counted(cols: Column) -> Column:
            return (F.size(cols) >= 6) & (F.size(F.filter(cols, lambda c: c.rlike(r"^[0-9][0-9.,%]*$"))) >= 4)

        return s.rlike(rf"(?:[0-9][0-9.,%]*{S}+(?:.*{S})?){{3}}[0-9]") & bound(F.split(s, f"{S}+"), counted)

    def odd(s: Column) -> Column:
        first = F.left(s, F.lit(1))
        return ~(first.between("A", "Z") | first.between("a", "z"))

    def judged(z: Column) -> Column:
        lines, low = z["lines"], z["low"]
        shell = (x.contains("@") | x.contains("$ ")) & F.exists(lines, lambda s: s.rlike(rf"[A-Za-z0-9_]+@[A-Za-z0-9_.-]+.*[%$]{S}") | s.rlike(rf"^{S}*\$ "))
        frames = (x.contains("at") & x.rlike(rf"\n{S}*at{S}+[^\s]+:[0-9]+")) | (x.contains('File "') & x.rlike(r'File ".*", line [0-9]+'))

        def by_lines(trimmed: Column) -> Column:
            listing = F.size(F.filter(trimmed, listed)) >= 2
            table = F.size(F.filter(trimmed, table_row)) >= 2

            def by_filled(filled: Column) -> Column:
                first = F.coalesce(F.get(filled, F.lit(0)), F.lit(""))
                ratio = (F.size(filled) >= 4) & (F.size(F.filter(filled, odd)) >= 0.6 * F.size(filled))
                # `first` is the untrimmed line where that matters: its length.
                asks = F.exists(F.slice(F.filter(lines, lambda s: js_trim(s) != ""), 1, 1), lambda s: s.contains("?") & (F.length(s) < 120))
                return F.when(_any(low, LOG_TOKENS) | shell | frames | listing | table, ~asks).otherwise(ratio & ~_any(low, REQUEST_CUES) & (first != ""))

            return bound(F.filter(trimmed, lambda s: s != ""), by_filled)

        return bound(F.transform(lines, js_trim), by_lines)

    whole = F.struct(F.split(x, "\n", -1).alias("lines"), F.lower(x).alias("low"))
    return F.when(F.length(x) >= 60, bound(whole, judged)).otherwise(F.lit(False))


def heuristic_role(text: Column, n_images: Column) -> Column:
    """interruption, approval, paste, continuation (images only), correction, else new_task - the ambiguous one."""
    return (
        F.when(text.contains(INTERRUPT_MARKER), "interruption")
        .when(is_approval(text), "approval")
        .when(is_paste(text), "paste")
        .when((text == "") & (n_images > 0), "continuation")
        .when(is_correction(text), "correction")
        .otherwise("new_task")
    )


def keywords(x: Column) -> Column:
    """Distinct lower-case tokens of three characters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^a-z0-9_./]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def path_segments(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[/.]"), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def containment(a: Column, b: Column) -> Column:
    """Share of a that is in b; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def normalize_task_type(x: Column) -> Column:
    s = js_trim(F.lower(F.coalesce(x, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(s, r"[_/]+", " "), r"[^a-z0-9 ]+", "")
    s = js_trim(F.regexp_replace(s, r"\s+", " "))
    singular = F.regexp_replace(s, r"(?<![a-z0-9])([a-z0-9]{3,}[a-hj-rtv-z0-9])s(?![a-z0-9])", "$1")

    def named(t: Column) -> Column:
        out = t
        for pattern, name in reversed(TASK_TYPES):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return F.when(t == "", "uncategorized").otherwise(out)

    return F.get(F.transform(F.array(singular), named), F.lit(0))  # the text is built once, not once a pattern


def slugify(x: Column, other: str = "uncategorized", most: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(js_trim(F.lower(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    if most:
        s = F.regexp_replace(F.left(s, F.lit(most)), r"-+$", "")
    return F.when(s == "", other).otherwise(s)


def pattern_signature(steps: Column) -> Column:
    return F.array_join(F.filter(F.transform(steps, lambda p: js_trim(F.lower(p))), lambda p: p != ""), ">")


def hash31(x: Column) -> Column:
    """32-bit hash h = 31 h + unit over the UTF-16 units, as eight lower-case hex digits."""

    def units(c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        high, low = F.floor((code - 65536) / 1024) + 55296, (code - 65536) % 1024 + 56320
        return F.when(code > 65535, F.array(high.cast("bigint"), low)).otherwise(F.array(code))

    codes = F.flatten(F.transform(F.split(x, ""), units))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.when(x == "", "00000000").otherwise(F.lpad(F.lower(F.hex(h)), 8, "0"))


def json_object(x: Column) -> Column:
    """The first balanced {...} of a text - of its first fenced block, if it has one -, aware of strings and escapes; null if there is none."""
    inner = F.when(x.contains("```") & x.rlike(FENCE), F.regexp_extract(x, FENCE, 1)).otherwise(x)
    return bound(inner, lambda t: bound(F.when(F.locate("{", t) > 0, F.substr(t, F.locate("{", t))), _balanced))


def greedy(x: Column, opens: str = "{", closes: str = "}") -> Column:
    """From the first opening to the last closing mark; null if there is no such span."""
    a, back = F.locate(opens, x), F.locate(closes, F.reverse(x))
    n = F.length(x) - a - back + 2
    return F.when((a > 0) & (back > 0) & (n > 1), F.substr(x, a, n))


FENCE = r"(?is)```(?:json)?\s*(.*?)```"
#: A brace, or a run of what is none: strings, open to the end if not closed, and anything between them.
JSON_TOKEN = r'(?s)[{}]|(?:[^"{}]++|"(?:[^"\\]|\\.)*+"?)++'


def _balanced(body: Column) -> Column:
    """The balanced object that a text begins with, token by token."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, token: Column) -> Column:
        at = a["at"] + F.length(token)
        depth = a["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        end = F.when((a["end"] == 0) & (token == "}") & (depth == 0), at).otherwise(a["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(F.regexp_extract_all(body, F.lit(JSON_TOKEN), 0), start, step)["end"]
    return bound(end, lambda n: F.when(n > 0, F.left(body, n)))
