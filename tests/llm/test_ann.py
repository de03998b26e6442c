import numpy as np
from pyspark.sql import functions as F
from sessionloom.llm import ann as A


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        x = np.array(rows[q], float)
        d = sorted((float(np.sqrt(((np.array(v, float) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = d[:k]
    return out


def asked():
    return F.col("vec_id") % 100 == 0


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    rows = {i: (centres[i % 30] + 0.4 * r.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows.items()], "vec_id long, embedding array<float>, part int").repartition(5)
    got = {}
    for x in A.search(df, asked()).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.score, x.vec_id)
    want = brute(rows, [i for i in rows if i % 100 == 0])
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        assert [found[k] for k in range(1, 11)] == sorted(found.values())
        for s, i in found.values():
            assert abs(s - np.sqrt(((np.array(rows[i], float) - np.array(rows[q], float)) ** 2).sum())) < 1e-12
        hits += len({i for _, i in found.values()} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors_ties_and_hot_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (200, [nan, 0.0])]
    rows += [(i, [1.0, 2.0]) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = A.search(df, asked()).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.vec_id, x.score) for x in got if x.query_id == 0] == [(0, i, 0.0) for i in [100, 1000, *range(1001, 1009)]]
    assert {x.query_id for x in got} == {0, 100, 1000}


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x["rank"], x.vec_id) for x in A.search(df, asked()).collect()] == [(0, 1, 7)]
    assert A.search(df.limit(0), asked()).count() == 0
    assert A.search(df.where("vec_id = 7"), asked()).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    part = A.balanced_parts(x, A.nearest(x, x, 11), 8)
    assert np.bincount(part).max() <= 138 and np.bincount(part).min() > 0


def test_double_precision_and_extreme_values(spark):
    rows = {0: [1e-60, 0.0], 100: [1e39, 1.0], 200: [1.0, 1.0 + 2**-50], 1: [1.0, 1.0], 2: [1e300, -1e300], 3: [-1.7e308, 1.7e308], 4: [2e-200, 0.0], 5: [3e-200, 0.0], 300: [1e308, -1e308], 400: [1e-200, 0.0]}
    got = {}
    for x in A.search(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), asked()).collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got.keys() == {0, 100, 200, 300, 400} and all(len(v) == 9 for v in got.values())
    assert dict(got[200])[1] == 2**-50 and got[200][0][0] == 1
    assert got[400][0] == (4, 1e-200) and abs(got[400][1][1] / 2e-200 - 1) < 1e-12
    assert abs(dict(got[300])[2] / (1e300 * (1e8 - 1) * 2**0.5) - 1) < 1e-9
    assert dict(got[300])[3] == float("inf")  # beyond the range of doubles
    assert [s for _, s in got[100]] == sorted(s for _, s in got[100])


def test_repeated_ids_ask_with_the_least_vector(spark):
    rows = [(100, [5.0, 5.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [5.0, 5.1]), (2, [5.0, 5.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(x.vec_id, x.score) for x in A.search(df, asked()).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 2] and got[0][1] == 0.5


def test_blocks_of_a_part_meet(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = {i: r.normal(size=4).tolist() for i in range(0, 6000, 10)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(A, "BLOCK", 7)
    got = {}
    for x in A.search(df, asked(), recall=1.1).collect():  # all parts visited: exact
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = brute(rows, [i for i in rows if i % 100 == 0])
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_parts_grow_with_the_table():
    assert [A.parts_for(n, 8192) for n in (0, 10**6, 2 * 10**6, 10**7, 10**8, 10**10)] == [16, 16, 32, 256, 512, 512]
