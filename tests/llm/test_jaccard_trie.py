import random
import re

import numpy as np
import pytest
from sessionloom.llm import jaccard_trie as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    ids = sorted(sets, key=lambda i: -1 if i is None else i)
    comp = {i: i for i in ids}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)), key=lambda v: -1 if v is None else v)
                comp[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "é"]
    line = [r.choice(vocab) for _ in range(12)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 4, 30, 60, 120]))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(r.choice(base[:6] if i % 2 else base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[r.randrange(len(words))] = r.choice(vocab)
        if r.random() < 0.3:
            words = [r.choice(vocab) for _ in range(40)] + line
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows + [(900, None), (901, " \n"), (902, ""), (903, rows[4][1]), (None, rows[5][1]), (904, "x y"), (905, "X  y"), (906, "a " * 2000)]


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_against_brute_force(spark, width, percent, seed, monkeypatch):
    monkeypatch.setattr(J, "HUB_ROUNDS", 1 if seed == 3 else 2)
    rows = corpus(seed, 60 if seed == 3 else 150)
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, grams string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)
    left = {r.doc_id for r in J.near_copies_removed(docs, width, percent).collect()}
    assert left == {i for i, (_, c) in brute(rows, width, percent).items() if c == i}


def test_frequent_grams_go_last(spark):
    r = random.Random(5)
    rows = [(i, "common line of five " + " ".join(str(r.randrange(10**6)) for _ in range(9))) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_key long, text string")
    late = J.frequent_grams(texts, 4, least=50)
    assert len(late) == 1
    order = J.Order(late)
    assert order(np.sort(np.concatenate((late, np.array([1, 2**63 - 1], np.uint64))))).tolist() == [1, 2**63 - 1, 2**63]


def jaccard(a, b):
    return 100 * len(np.intersect1d(a, b)) / len(np.union1d(a, b))


@pytest.mark.parametrize("percent", [30, 60, 85])
def test_trie_of_whole_sets(percent):
    r = np.random.default_rng(percent)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    sets += [s[:-1] for s in sets[:20] if len(s) > 1] + [sets[3]] + [np.arange(n, dtype=np.uint64) for n in (1, 2, 300, 301, 340)]
    sizes = [len(s) for s in sets]
    trie = J.Trie(sets, sizes, sizes)
    for probe in sets:
        assert sorted(trie.links(probe, len(probe), len(probe), percent)) == [i for i, s in enumerate(sets) if jaccard(s, probe) >= percent]


def test_subtrees_are_left_as_a_whole(monkeypatch):
    far = [np.concatenate((np.arange(1000, 1040), [2000 + i])).astype(np.uint64) for i in range(500)]
    trie = J.Trie(far, [41] * 500, [41] * 500)
    asked = []
    find = np.searchsorted
    monkeypatch.setattr(J.np, "searchsorted", lambda a, v: asked.append(len(v)) or find(a, v))
    assert trie.links(np.arange(41, dtype=np.uint64), 41, 41, 80) == []
    assert len(asked) <= 1  # the shared path of all 500 is looked at once


def test_trie_of_prefixes_keeps_every_link():
    r = np.random.default_rng(7)
    base = [np.unique(r.integers(0, 10**6, 60).astype(np.uint64)) for _ in range(8)]
    sets = [np.unique(np.concatenate((np.delete(b, r.integers(0, len(b), 4)), r.integers(0, 10**6, 3).astype(np.uint64)))) for b in base for _ in range(12)]
    sizes = [len(s) for s in sets]
    heads = [s[: J._prefix_length(len(s), 80)] for s in sets]
    trie = J.Trie(heads, sizes, sizes)
    for i, p in enumerate(heads):
        got = set(trie.links(p, sizes[i], sizes[i], 80))
        want = {j for j, s in enumerate(sets) if jaccard(s, sets[i]) >= 80}
        assert want <= got and len(got) < 30


def test_groups_that_hubs_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, 4, 85).collect()} == brute(rows, 4, 85)


def test_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 2)
    rows = [(i, "one two three four five") for i in range(5)] + [(9, "a b c d e"), (8, "a b c d e"), (10, None)]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(5)}, 8: 8, 9: 8, 10: 10}


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t[:n], t[:n].translate({97: 98, 98: 97})


def test_words_that_polynomials_of_machine_words_confuse(spark):
    rows = [(i, t) for i, t in enumerate([*thue_morse(1024), *thue_morse(4096)])]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(4)}


def test_repeated_rows_and_rows_without_an_id(spark):
    a, b, c = ("x " + " ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, a), (None, b), (None, b), (4, b + " tail"), (5, c), (5, c), (6, c + " end"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, `_key` int")
    comps = sorted(((r.doc_id, r.component_id) for r in J.jaccard_components(docs).collect()), key=str)
    assert comps == sorted([(None, None)] * 3 + [(4, None), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8)], key=str)
    left = J.near_copies_removed(docs.withColumnRenamed("_key", "n")).collect()
    assert sorted(((str(r.doc_id), r.text) for r in left), key=str) == sorted([("None", a), ("None", b), ("5", c), ("7", None), ("8", "")], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(docs).count() == 0
    assert J.near_copies_removed(docs).count() == 0
