import numpy as np
import pytest
from pyspark.sql import functions as F
from sessionloom.llm import common as C


def slow(word, seed, lower):
    word = word.lower() if lower else word
    value = sum((c + 1) * pow(C._base(seed), i, C.PRIME) for i, c in enumerate(word)) % C.PRIME
    return int(C.mix(np.array([(value + len(word) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_hashed_in_a_prime_field(lower):
    words = [b"a", b"A", b"\x00", b"\xc3\xa9Z", b"xY" * 100, b"q" * C.SEGMENT, b"Q" * (C.SEGMENT + 1), b"ab" * (2 * C.SEGMENT)]
    raw = np.frombuffer(b" \t".join(words), np.uint8)
    got = C.Words(raw, np.array([0, len(raw)])).hashes(5, lower)
    assert got.tolist() == [slow(w, 5, lower) for w in words]


def test_keys_of_rows_without_an_id(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (None, None), (None, "a"), (5, "a"), (-3, None)], "doc_id long, text string")
    keys = [r[0] for r in rows.select(C.ided("doc_id", "text").alias("k")).collect()]
    assert keys[0] == keys[3] != keys[1] and len(set(keys)) == 5 and keys[4:] == [5, -3] and all(C.NULL_ID <= k < C.NO_ID_END for k in keys[:4])
    assert [r[0] for r in rows.select(C.ided("doc_id", "text").alias("k")).select(C.un_ided("k")).collect()] == [None] * 4 + [5, -3]
    with pytest.raises(Exception, match="is kept for rows without an id"):
        spark.createDataFrame([(C.NULL_ID + 7, "x")], "doc_id long, text string").select(C.ided("doc_id", "text")).collect()


def test_small_tables_become_few_files(spark):
    df = spark.range(1000).repartition(40, F.col("id"))
    few = C.written(df, "few", rows=1000)
    assert few.count() == 1000 and len(few.inputFiles()) <= C.FILES
    mark = C.made_so_far()
    one, two = C.written(df.limit(3), "one"), C.written(df.limit(4), "two")
    C.drop_since(mark, [two])
    assert two.count() == 4 and len(C.made_since(mark)) == 1 and one.columns == ["id"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Hadoop:
        def __init__(self, fs):
            self.get = lambda *a: fs

    def session(master, fs):
        context = type("Context", (), {"applicationId": f"{master}{fs}", "master": master, "_jsc": type("J", (), {"hadoopConfiguration": staticmethod(lambda: Hadoop(fs))})})
        return type("Session", (), {"conf": Conf, "sparkContext": context})

    assert C.shared_dir(session("yarn", "hdfs://a/")).startswith("hdfs://a/tmp/")
    assert C.shared_dir(session("local[4]", "file:///")).startswith("file:///tmp/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(session("spark://h:1", "file:///"))
