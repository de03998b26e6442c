import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import sentencepiece
from sessionloom.llm import merge_dropout as M

TEXTS = ["", " ", "  Hello  world\n\tx é 😀  ", "ciónmente  leaux", "a" * 300, "the cat\n\n  sat", " x <s> <0x0A> </s>", "漢字かな ñandú", "x" * 40 + " y" * 30, "\n", "   "]
MARKS = ["a▁b", "▁", "▁▁ x ▁y", "the▁ cat▁", " ▁ "]


def texts():
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    return TEXTS + [t for t in rows if t][:120]


def test_rate_zero_is_the_tokenizer():
    sp = sentencepiece.SentencePieceProcessor(model_file=M.VOCABULARY)
    own = texts()
    got = M.Encoder(rate=0).encode_batch(own, [0] * len(own))
    assert [x.tolist() for x in got] == sp.encode(own)


def test_arrays_equal_the_heap():
    v = M.Vocabulary(M.VOCABULARY)
    r = random.Random(1)
    chunks = list({c for t in texts() for c in M.CHUNK.findall(M.MARK + t.replace(" ", M.MARK)) if len(c) <= 60})
    keys = np.array([r.getrandbits(64) for _ in chunks], np.uint64)
    for rate in (0.0, 0.1, 0.5, 1.0):
        symbols, sizes = M.merge_many(v, chunks, keys, rate)
        assert [x.tolist() for x in np.split(symbols, np.cumsum(sizes)[:-1])] == [M.merge_one(v, c, int(k), rate) for c, k in zip(chunks, keys, strict=True)]


def test_varied_lossless_and_seeded():
    own = texts()
    a, again, b = (M.Encoder(seed=s, rate=0.2) for s in (1, 1, 2))
    own += MARKS
    variants = [i % 4 for i in range(len(own))]
    one = a.encode_batch(own, variants)
    assert all(np.array_equal(x, y) for x, y in zip(one, again.encode_batch(own, variants), strict=True))
    assert sum(not np.array_equal(x, y) for x, y in zip(one, b.encode_batch(own, variants), strict=True)) > 100
    assert [a.decode(x) for x in one] == own
    # The rest of the batch and the heap do not matter.
    assert all(np.array_equal(x, a.encode_batch([t], [k])[0]) for x, t, k in zip(one[:40], own, variants, strict=False))
    assert all(np.array_equal(x, y) for x, y in zip(one, M.Encoder(seed=1, rate=0.2, wide=5).encode_batch(own, variants), strict=True))


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(texts() + MARKS)] + [(900, None), (None, "null id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, document int").repartition(3)
    ids = M.encode(docs, seed=5)
    assert {r.doc_id: r.text for r in M.decode(ids).collect()} == {i: t or "" for i, t in rows}
    short = {r.doc_id: r for r in M.encode(docs, seed=5, digest=True).collect()}
    assert all(r.lossless for r in short.values())
    assert {r.doc_id: r.n_ids for r in ids.collect()} == {i: r.n_ids for i, r in short.items()}
    assert M.encode(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "international understanding of segmentations " * 20
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (None, text + "x")]
    got = M.encode(spark.createDataFrame(rows, "doc_id long, text string"), seed=1, rate=0.3, digest=True).collect()
    of = [r.ids_sha256 for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_ids))]
    assert len(got) == 6 and of[0] == of[1] and len(set(of)) == 4


def slow_hash(x):
    x &= 2**64 - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def by_hand(sp, text, document, seed, rate):
    """Pieces by looking at all pairs again after each merge; a candidate is skipped by the hash of its place."""
    known = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    start = int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), "little")
    own = slow_hash(document ^ start)
    out = []
    for place, chunk in enumerate(re.findall("▁+[^▁\n]*|[^▁\n]+|\n", "▁" + text.replace(" ", "▁"))):
        key = slow_hash(own + (place + 1) * 0x9E3779B97F4A7C15)
        parts = [(i, i + 1) for i in range(len(chunk))]
        while True:
            best = None
            for (a, b), (_, c) in zip(parts, parts[1:]):
                at = a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9
                whole = all(chunk[x:y] in known for x, y in ((a, b), (b, c), (a, c)))
                if whole and slow_hash(key ^ slow_hash(at)) >= int(rate * 2**64) and (best is None or (known[chunk[a:c]], a) < best[:2]):
                    best = (known[chunk[a:c]], a, b, c)
            if best is None:
                break
            parts = [p for p in parts if p not in ((best[1], best[2]), (best[2], best[3]))] + [(best[1], best[3])]
            parts.sort()
        for a, b in parts:
            out += [sp.piece_to_id(chunk[a:b])] if chunk[a:b] in known else [sp.piece_to_id(f"<0x{x:02X}>") for x in chunk[a:b].encode()]
    return out


def test_dropout_against_brute_force():
    sp = sentencepiece.SentencePieceProcessor(model_file=M.VOCABULARY)
    own = [t[:400] for t in texts() if t][:40]
    documents = [5, 2**40 + 1, 7] * 14
    for rate in (0.1, 0.4):
        got = M.Encoder(seed=9, rate=rate).encode_batch(own, documents[: len(own)])
        assert [x.tolist() for x in got] == [by_hand(sp, t, d, 9, rate) for t, d in zip(own, documents, strict=False)]


def test_occurrences_differ():
    e = M.Encoder(seed=3, rate=0.3)
    word = "international"
    for many in ([f" {word}" * 2000], [word] * 2000):
        ids = e.encode_batch(many, list(range(len(many))))
        text = [tuple(x) for x in ids] if len(many) > 1 else [tuple(x) for x in np.split(ids[0], np.flatnonzero([e.v.texts[i].startswith(M.MARK) for i in ids[0]]))[1:]]
        assert len(set(text)) > 8


def test_shared_drops_equal_each_alone():
    # Every occurrence is merged as if no other stood for it, whatever its number of candidates and the rate.
    own = [t for t in texts() if t][:60]
    for rate in (0.05, 0.5, 1.0):
        e = M.Encoder(seed=4, rate=rate)
        documents = [7 * i - 100 for i in range(len(own))]
        split = [M.CHUNK.findall(M.MARK + t.replace(" ", M.MARK)) for t in own]
        keys = iter(M.occurrence_keys(4, np.array(documents), np.array([len(s) for s in split])))
        for s, x in zip(split, e.encode_batch(own, documents), strict=True):
            one = [M.merge_one(e.v, c, int(next(keys)), rate) for c in s]
            assert [i for c in one for y in c for i in ([y] if y >= 0 else e._bytes(y))] == x.tolist()
