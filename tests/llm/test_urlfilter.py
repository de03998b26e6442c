import math
import random
import re

import numpy as np
from sessionloom.llm import urlfilter as U


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best


def test_against_brute_force(spark):
    r = random.Random(2)
    hosts = ["net", "NET", "a.Example.net", "xnet", "example.com", "b.example.com", "c.org", "org", "É.org", "", "user@x.net:80"]
    tails = ["", "/", "/en/1", "/de/", "/de", "/fr/x?y=/de/", "?q=1", "#a/b", "/en/#", "//en/", "/FR/"]
    urls = [f"{s}://{r.choice(hosts)}{r.choice(tails)}" for s in ("http", "https", "") for _ in range(60)]
    urls += [None, "", "no scheme/en/", "a://b://c.net/", "x" * 20000, "http://q.com/" + "z" * 20000, *urls[:5]]
    pages = spark.createDataFrame([(i, u, "h", "h2") for i, u in enumerate(urls)], "page_id long, url string, html string, host string").repartition(3)
    out = {x.page_id: x for x in U.judge_urls(pages).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = brute(u)
        assert (out[i].host, out[i].path) == (host, path), u
        if best:
            assert (out[i].rule, out[i].verdict) == best, u
        else:
            assert out[i].rule is None and out[i].verdict in ("allow", "block")


def chance(texts, context, char):
    """Witten-Bell by looking at every place of every text."""
    p = U.FLAT
    for k in range(len(context) + 1):
        end = context[len(context) - k :]
        after = [t[i] for t in (U.START * U.ORDER + t for t in texts) for i in range(U.ORDER, len(t)) if t[i - k : i] == end]
        if not after:
            break
        p = (after.count(char) + len(set(after)) * p) / (len(after) + len(set(after)))
    return p


def ratio(good, bad, url):
    padded = U.START * U.ORDER + url
    places = [(padded[i : i + U.ORDER], padded[i + U.ORDER]) for i in range(len(url))]
    return sum(math.log(chance(bad, *x) / chance(good, *x)) for x in places) / max(len(url), 1)


def test_ratios_equal_counting_by_hand(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("ab/é😀") for _ in range(r.randrange(n)))
    rows = [(text(12), b, t) for b in (0, 1) for t in (0, 1) for _ in range(12)]
    urls = spark.createDataFrame(rows, "url string, blocked int, taught int").repartition(3)
    asked = [(i, text(15)) for i in range(30)] + [(40, ""), (41, "?" * 9), (42, rows[0][0])]
    got = {x.u: x for x in U.ratios(spark.createDataFrame(asked, "u long, url string").repartition(2), *U.models(urls)).collect()}
    assert len(got) == len(asked)
    for i, url in asked:
        for column, least in (("taught", 1), ("whole", 0)):
            good, bad = ([u for u, b, t in rows if b == side and t >= least] for side in (0, 1))
            assert abs(got[i][column] - ratio(good, bad, url)) < 1e-9, (i, url)


def test_probabilities_sum_to_one(spark):
    urls = spark.createDataFrame([(t, b, 1) for t in ("abcab", "abd", "xyz") for b in (0, 1)], "url string, blocked int, taught int")
    seen = "abcdxyz"
    codes = [[ord(c) for c in context + char] for context in ("\x02\x02\x02\x02\x02", "\x02\x02\x02ab", "zzzzz", "xxabc") for char in seen + "?"]
    t = U.packed(np.array(codes, np.int64)).to_pandas()
    got = {(x.hi, x.lo): x.p for x in U.probabilities(spark.createDataFrame(t), *U.models(urls)).collect()}
    p = np.array([got[(a, b)] for a, b in t.itertuples(index=False)]).reshape(4, len(seen) + 1, len(U.MODELS))
    assert np.abs(p[:, :-1].sum(axis=1) + (4096 - len(seen)) * p[:, -1] - 1).max() < 1e-9


def test_models_tell_apart(spark):
    r = random.Random(1)
    rows = [("http://" + "".join(r.choice("abc") for _ in range(12)) + ".org/fr/" + "".join(r.choice("abc") for _ in range(12))) for _ in range(150)]
    rows += [("http://" + "".join(r.choice("789") for _ in range(12)) + ".net/" + "".join(r.choice("789") for _ in range(12))) for _ in range(150)]
    good = [f"http://{''.join(r.choice('abc') for _ in range(9))}.io/abc" for _ in range(40)]
    bad = [f"http://{''.join(r.choice('789') for _ in range(9))}.io/789" for _ in range(40)]
    rows += good + bad + bad[:3]
    out = U.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    verdict = {}
    for x in out:
        verdict.setdefault(rows[x.page_id], set()).add(x.verdict)
    assert len(out) == len(rows)
    assert all(verdict[u] == {"allow"} for u in good) and all(verdict[u] == {"block"} for u in bad)


def test_a_long_url_and_rare_patterns_count(spark):
    # A pattern of few URLs among many, and a very long example, with a sample much smaller than the table.
    common = [(f"http://a.net/{i}", "block") for i in range(300)] + [(f"http://b.org/fr/{i}", "allow") for i in range(300)]
    rare = [("http://zq.net/kvx" + "kvx" * k, "block") for k in range(1, 4)]
    rows = common + rare + [("http://l.net/" + "y" * 1_100_000, "block")]
    ruled = spark.createDataFrame([*rows, rows[0]], "url string, ruled string").repartition(3)
    asked = spark.createDataFrame([("http://zq.com/kvxkvxkvx",), ("http://b.com/fr/77",), ("http://b.com/fr/77",)], "url string")
    got = {x.url: x.block_probability for x in U.scored(ruled, asked, 5).collect()}
    assert len(got) == 2 and got["http://zq.com/kvxkvxkvx"] > 0.5 > got["http://b.com/fr/77"]


def test_one_verdict_only(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.com/x"), (None, None)], "page_id long, url string")
    assert {x.page_id: x.verdict for x in U.judge_urls(pages).collect()} == {1: "block", 2: "allow", None: "allow"}


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
