"""Turn classification and text functions against hand-derived cases."""

import pytest
from pyspark.sql import functions as F
from sessionloom.functions import privacy as P
from sessionloom.functions import text as T
from sessionloom.operators import turns as TU


def one(spark, column, *values):
    x = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in x.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "text,role",
    [
        ("ok go.", "approval"), ("thanks!", "approval"), ("👍", "approval"), ("go go go go", "new_task"), ("no", "correction"), ("No, not that", "correction"), ("still failing", "correction"),
        ("stillness", "new_task"), ("noé", "new_task"), ("[Request interrupted by user] x", "interruption"), ("please add a test", "new_task"),
        ("Traceback (most recent call last):\n  File \"a.py\", line 3\nValueError: bad thing happened here", "paste"), ("why? traceback (most recent call last) " + "x" * 40, "new_task"),
        ("- 1\n- 2\n- 3\n- 4\n" + "-" * 60, "paste"), ("- 1\n- 2\n- 3\n- 4 please\n" + "-" * 60, "new_task"), ("-rwxr-xr-x a\ndrwxr-xr-x b\n" + "z" * 60, "paste"),
    ],
)
def test_roles(spark, text, role):
    assert one(spark, lambda x: T.heuristic_role(x, F.lit(0)), text) == [role]


def test_image_only_turn(spark):
    assert one(spark, lambda x: T.heuristic_role(x, F.lit(1)), "") == ["continuation"]


def test_names(spark):
    assert one(spark, T.normalize_task_type, "Bug_Fixes!", "unit tests", "class", "", "Docs/", "Status Reports", None) == ["bug fixe", "testing", "class", "uncategorized", "documentation", "status report", "uncategorized"]
    assert one(spark, T.slugify, "UI / UX ", "--", "é") == ["ui-ux", "uncategorized", "uncategorized"]
    assert one(spark, T.hash31, "abc", "", "hello world") == ["00017862", "00000000", "6aefe2c4"]
    assert one(spark, lambda x: F.array_join(T.keywords(x), " "), "Fix the src/app.ts and src/app.ts also ÉCLAIR x1") == ["src/app.ts clair"]


def test_fold_boundaries(spark):
    def roles(*turns):
        rows = [("s", i, 2 * i, t, g, len(t) > 0 and i > 0 and turns[i - 1][0] == t) for i, (t, g) in enumerate(turns)]
        x = spark.createDataFrame(rows, "session_id string, idx long, event_index long, text string, gap_s double, repeats boolean").withColumn("n_images", F.lit(0))
        words = spark.createDataFrame([("s", 2 * i + 1, ["alpha", "beta"]) for i in range(len(turns))], "session_id string, event_index long, words array<string>")
        return [(r.role, r.classified_by) for r in TU.classify(x, words).orderBy("idx").collect()]

    inf = float("inf")
    start = ("build gamma delta", inf)
    long = "gamma delta epsilon zeta eta theta iota kappa lambda"
    assert roles(start, ("also this", inf))[1] == ("continuation", "signal")
    assert roles(start, ("short one here", 599.0))[1] == ("continuation", "signal")
    assert roles(start, ("short one here", 600.0))[1] == ("new_task", "signal")
    assert roles(start, (long, 10.0))[1] == ("new_task", "signal")
    assert roles(start, ("alpha " + long, 10.0))[1] == ("new_task", "signal")
    assert roles(start, ("alpha beta " + long[:24], 1799.0))[1] == ("new_task", "heuristic")
    assert roles(start, ("alpha beta gamma", 1799.0))[1] == ("continuation", "signal")
    assert roles(start, ("alpha beta gamma", 1800.0))[1] == ("new_task", "heuristic")
    assert roles(start, start)[1] == ("continuation", "signal")
    assert roles(("ok", inf), ("then more", inf))[:2] == [("approval", "heuristic"), ("new_task", "signal")]


def test_redaction_order(spark):
    rows = ["password: hunter2 mail a.b@c.vn id 123456789 call 0912345678 pay $100", "clean", None, "sk-ant-abcdefghijklmnop Bearer abcdefghijklmnop1234", "cost 100.000đ KH-12345"]
    out = P.sanitize(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")).orderBy("i").collect()
    assert out[0].clean_text == "[REDACTED-PASSWORD] mail [EMAIL] id [ID] call [PHONE] pay [MONEY]"
    assert (out[0].hits, out[0].had_credential, out[0].n_strong_pii) == (["password_kv", "email", "vn_id", "vn_phone", "money"], True, 4)
    assert (out[1].clean_text, out[1].hits, out[1].had_credential) == ("clean", [], False)
    assert out[2].clean_text == "" and out[3].hits == ["bearer_hdr", "known_secret"]
    assert out[4].clean_text == "cost [MONEY] [CODE]"


def test_accents_no_break_spaces_and_surrogates(spark):
    from sessionloom.functions import privacy as P

    texts = [" ok ", "no that", "stillé", "still", "stills", "　No ", "naïve café Ünïcode", "and then", "andé", "😀é "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    x = F.col("t")
    got = {r.i: r for r in rows.select("i", T.is_approval(x).alias("ok"), T.is_correction(x).alias("no"), T.is_continuation_cue(x).alias("cue"), T.keywords(x).alias("k"), T.js_trim(x).alias("trim"), T.hash31(x).alias("h")).collect()}
    assert [got[i].ok for i in (0, 1)] == [True, False]
    assert [got[i].no for i in range(1, 6)] == [False, True, True, False, True]
    assert [got[i].cue for i in (7, 8)] == [True, False]
    assert got[6].k == ["caf", "code"] and got[9].trim == "😀é" and got[5].trim == "No"
    for i, t in enumerate(texts):
        h = 0
        raw = t.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[k : k + 2], "little")) % 2**32
        assert got[i].h == f"{h:08x}"
    dirty = ["mật khẩu mk: abc123", "đ 12.000 đ", "password: xyz", "token = q", "a@é.com ü@b.org"]
    x = P.sanitize(spark.createDataFrame(list(enumerate(dirty)), "i int, text string")).orderBy("i").collect()
    assert [r.clean_text for r in x] == ["mật khẩu [REDACTED-PASSWORD]", "đ [MONEY]", "[REDACTED-PASSWORD]", "[REDACTED-APIKEY]", "a@é.com ü@b.org"] or [r.hits for r in x] == []
