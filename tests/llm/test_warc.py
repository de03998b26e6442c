import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest
from sessionloom.llm import common as C
from sessionloom.llm import warc as W

LONG = "é<p>WARC/1.0\r\n\r\nWARC/1.0\r\nx</p>" * 9


def rows():
    body = [LONG, LONG + "1", "short", "", None, "x" * 99, "y" * 100, "é" * 50, "é" * 49, "z" * 300000, " " + LONG]
    out = [(i, f"http://h/{i}\r\nX-Page-Id: 77", body[i % len(body)]) for i in range(60)]
    return out + [(5, None, LONG), (None, "u", LONG), (None, None, "only null " * 30), (200, "a", "\r\n\r\n" * 60)]


def brute(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min([x for x in (i, first.get(b)) if x is not None], default=None)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] is not None and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


def key(r):
    return tuple(str(x) for x in r)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, record_type string").repartition(3)
    got = [tuple(r) for r in W.archived(pages).collect()]
    assert sorted(got, key=key) == sorted(brute(rows()), key=key)


def test_payloads_and_pushdown(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    path = C.new_path(spark, "warc")
    W.write_warc(W.with_revisits(pages), path)
    df = W.read_warc(spark, path, ("X-Page-Id", "WARC-Target-URI"))
    some = df.where("record_type = 'response' and `X-Page-Id` in ('1', '9')")
    assert {r["X-Page-Id"]: bytes(r.payload).decode() for r in some.collect()} == {"1": LONG + "1", "9": "z" * 300000}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "record_type" not in plan.split("BatchScan")[0]
    assert df.where("`WARC-Target-URI` like 'http://h/1%'").count() == 11
    assert df.where("record_type <> 'revisit'").count() + df.where("record_type = 'revisit'").count() == len(rows())


class Spy(io.BytesIO):
    most = got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.most, self.got = max(self.most, len(out)), self.got + len(out)
        return out


BLOCK = b"x" * 5000
ONE = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 5000\r\n\r\n" + BLOCK + b"\r\n\r\n"


def test_unwanted_blocks_are_not_read():
    f = Spy(ONE * 3)
    assert [h["x-long"] for h, _ in W.records(f, lambda h: True, False)] == ["a b"] * 3 and f.most == 1
    assert list(W.records(Spy(ONE * 3), lambda h: False, True)) == []
    assert [p for _, p in W.records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(ONE) * 2)), lambda h: True, True)] == [BLOCK] * 2
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(b"junk\r\n"), lambda h: True, True))


def test_members_are_skipped_packed():
    noise = random.Random(1).randbytes(400_000)
    record = lambda kind, block: b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    raw = [record(b"a", noise), record(b"b", b"small"), record(b"a", noise), record(b"b", b"")]
    data = b"".join(map(W.member, raw))
    assert gzip.decompress(data) == b"".join(raw)  # any gzip reader reads it as one stream
    f = Spy(data)
    got = list(W.members(f, len(data), lambda h: h["warc-type"] == "b", True))
    assert [p for _, p in got] == [b"small", b""] and f.got < 40_000
    assert len(list(W.members(Spy(data), len(data), lambda h: True, False))) == 4
    at = len(W.member(raw[0]))  # a record can be read by its offset
    f = io.BytesIO(data)
    f.seek(at)
    assert next(W.members(f, len(data), lambda h: True, True))[1] == b"small"


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("keep", [True, False])
def test_cut_archives_raise(payload, keep):
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(ONE[:-100]), lambda h: keep, payload))
    data = W.member(ONE) + W.member(ONE)[:-20]
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(data), len(data), lambda h: keep, payload))
    with pytest.raises((ValueError, EOFError)):
        list(W.records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(ONE[:-100]))), lambda h: keep, payload))


def test_ids_and_references(spark):
    pages = spark.createDataFrame([*rows(), rows()[0], rows()[2]], "page_id long, url string, html string").repartition(3)
    path = C.new_path(spark, "warc")
    W.write_warc(W.with_revisits(pages), path)
    found = W.read_warc(spark, path, ("WARC-Record-ID", "WARC-Refers-To", "X-Page-Id", "X-Refers-To-Page"), payload=False).collect()
    ids = [r["WARC-Record-ID"] for r in found]
    assert len(ids) == len(rows()) + 2 == len(set(ids))
    of = {r["WARC-Record-ID"]: r for r in found}
    for r in found:
        assert (r["WARC-Refers-To"] is not None) == (r.record_type == "revisit")
        if r.record_type == "revisit":
            assert of[r["WARC-Refers-To"]]["X-Page-Id"] == r["X-Refers-To-Page"] and of[r["WARC-Refers-To"]].record_type == "response"


def test_only_committed_files_are_read(spark, tmp_path):
    w = W.WarcWriter(f"file://{tmp_path}")
    batch = pa.RecordBatch.from_pylist([{"record_type": "response", "record_id": None, "head": "\r\nX-Page-Id: 1", "block": b"x"}])
    lost, done = w.write(iter([batch])), w.write(iter([batch]))
    w.commit([done, None])
    assert W.read_warc(spark, f"file://{tmp_path}").count() == 1
    w.abort([lost])
    assert len(list(tmp_path.iterdir())) == 1


def test_empty(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
