"""Substring deduplication by recompression.

Each round renames runs of one symbol, then pairs whose left symbol falls in the
round's left half of the alphabet and whose right symbol falls in its right half.
Names are hashes of what they stand for, so they are global without any dictionary
exchange, and equal substrings get equal symbols wherever a symbol's *context* - the
words that decided its parse - lies inside the substring. Every window therefore has
a representative that depends on its content alone: the least symbol of the highest
level whose context it holds, named with that context (the window's own hash, if it
holds none).

Plan: representatives of all documents -> those that occur twice -> only windows with
such a representative are verified, by a 128-bit cryptographic digest of their words ->
the first place of each digest -> words under a window that is not in its first place go.
Symbols and representatives are fast hashes: that two texts share one by chance makes a
window a candidate and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 20
ROUNDS = 2


class Level:
    """Symbols of one level over a run of rows, in order, with the words that decided each."""

    def __init__(self, sym: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.sym, self.row, self.lo, self.hi = sym, row, lo, hi


def next_level(x: Level, first: np.ndarray, step: int) -> Level:
    """One round of recompression: runs, then pairs. first: the first word of each row, and the end."""
    sym, row, lo, hi = x.sym, x.row, x.lo, x.hi
    if not len(sym):
        return x
    with np.errstate(over="ignore"):
        # Runs. That a symbol ends its run is seen from its neighbours, which join its context.
        joint = row[1:] == row[:-1]
        head = np.concatenate(([True], ~((sym[1:] == sym[:-1]) & joint)))
        at = np.flatnonzero(head)
        size = np.diff(np.concatenate((at, [len(sym)])))
        last = at + size - 1
        joint = np.concatenate(([False], joint, [False]))
        low = np.where(joint[at], lo[at - 1], first[row[at]] - 1)
        high = np.where(joint[last + 1], hi[np.minimum(last + 1, len(sym) - 1)], first[row[at] + 1] + 1)
        named = C.mix(sym[at] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        sym = np.where(size > 1, named, sym[at])
        row, lo, hi = row[at], low, high
        # Pairs: left half then right half.
        right = (C.mix(sym ^ np.uint64(0x3C79AC492BA7B653 + step)) & np.uint64(1)).astype(bool)
        joint = row[1:] == row[:-1]
        opens = np.concatenate((~right[:-1] & right[1:] & joint, [False]))
        closes = np.concatenate(([False], opens[:-1]))
        joint = np.concatenate(([False], joint, [False]))
        after = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
        pair = C.mix(sym * np.uint64(0xC2B2AE3D27D4EB4F) + C.mix(sym[after] + np.uint64(step + 1)))
        low = np.where(opens | ~right, lo, np.where(joint[:-1], np.concatenate((lo[:1], lo[:-1])), first[row] - 1))
        high = np.where(opens, hi[after], np.where(right, hi, np.where(joint[1:], hi[after], first[row + 1] + 1)))
    kept = ~closes
    return Level(np.where(opens, pair, sym)[kept], row[kept], low[kept], high[kept])


class Windows:
    """The windows of a run of rows and their representatives."""

    def __init__(self, words: C.Words, window: int, rounds: int):
        h = words.hashes(1)
        n = len(h)
        row, first = words.row, words.first
        at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        self.at, self.h, self.row = at, h, row[at] if len(at) else np.zeros(0, np.int64)
        levels = [Level(h, row, np.arange(n), np.arange(1, n + 1))]
        for step in range(rounds):
            levels.append(next_level(levels[-1], first, step))
        sums = _Sums(h)
        rep = np.zeros(len(at), np.uint64)
        place = np.full(len(at), -1, np.int64)
        for depth in range(rounds, 0, -1):
            todo = np.flatnonzero(place < 0)
            if not len(todo):
                break
            found, where = _least(levels[depth], at[todo], window, n)
            hit = where >= 0
            x = levels[depth]
            rep[todo[hit]] = C.mix(found[hit] + np.uint64(depth) + sums.between(x.lo[where[hit]], x.hi[where[hit]]))
            place[todo[hit]] = where[hit] * (rounds + 1) + depth
        todo = np.flatnonzero(place < 0)
        if len(todo):
            rep[todo] = C.run_hash(h, at[todo], window, 5)
            place[todo] = at[todo] * (rounds + 1)
        self.rep, self.place = rep, place


class _Sums:
    """Hashes of word ranges by sums up to each word."""

    BASE = 0xDA942042E4DD58B5

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(len(h) + 1, pow(self.BASE, -1, 2**64), np.uint64), dtype=np.uint64)
            up = np.cumprod(np.full(len(h), self.BASE, np.uint64), dtype=np.uint64)
            self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C.mix((self.sum[hi] - self.sum[lo]) * self.power[lo] + (hi - lo).astype(np.uint64))


def _least(x: Level, at: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least symbol whose context it holds, and where that stands (-1: none)."""
    below = np.cumsum(np.bincount(np.maximum(x.lo + 1, 0), minlength=n + 3))  # [i]: symbols with lo < i
    ended = np.cumsum(np.bincount(x.hi, minlength=n + 3))  # [i]: symbols with hi <= i
    a, b = below[at], ended[at + window]
    width = b - a
    value, where = np.zeros(len(at), np.uint64), np.full(len(at), -1, np.int64)
    some = np.flatnonzero(width > 0)
    if not len(some):
        return value, where
    a, b, width = a[some], b[some], width[some]
    best, span = np.arange(len(x.sym)), 1
    while True:
        now = np.flatnonzero((width >= span) & (width < 2 * span))
        if len(now):
            p, q = best[a[now]], best[b[now] - span]
            take = np.where(x.sym[q] < x.sym[p], q, p)
            value[some[now]], where[some[now]] = x.sym[take], take
        if 2 * span > width.max():
            return value, where
        p, q = best[:-span], best[span:]
        best = np.where(x.sym[q] < x.sym[p], q, p)
        span *= 2


def representatives(window: int, rounds: int):
    """Arrow map: (doc_key, text) -> (symbol, doc_key, places), places 1 or 2 (twice or more in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_key").to_numpy(zero_copy_only=False)
            raw, offs = C.text_parts(batch.column("text"))
            for a, b in C.row_chunks(offs):
                w = Windows(C.Words(raw, offs[a : b + 1]), window, rounds)
                if not len(w.at):
                    continue
                new = np.concatenate(([True], (w.place[1:] != w.place[:-1]) | (w.row[1:] != w.row[:-1])))
                rep, row, place = w.rep[new], w.row[new], w.place[new]
                order = np.lexsort((place, rep, row))
                rep, row, place = rep[order], row[order], place[order]
                fresh = np.concatenate(([True], (rep[1:] != rep[:-1]) | (row[1:] != row[:-1])))
                moved = np.concatenate(([False], ~fresh[1:] & (place[1:] != place[:-1])))
                at = np.flatnonzero(fresh)
                twice = np.add.reduceat(moved.astype(np.int64), at) > 0
                yield pa.RecordBatch.from_arrays(
                    [C.signed(rep[at]), pa.array(keys[a + row[at]]), pa.array(np.where(twice, 2, 1).astype(np.int32))],
                    ["symbol", "doc_key", "places"],
                )
            C.trim()

    return run


def _candidates(words: C.Words, flags: np.ndarray, flag_row: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of the windows whose representative is flagged in their row."""
    w = Windows(words, window, rounds)
    if not len(w.at) or not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        salt = np.uint64(0x9E3779B97F4A7C15)
        known = np.sort(C.mix(flags.view(np.uint64) + flag_row.astype(np.uint64) * salt))
        asked = C.mix(w.rep + w.row.astype(np.uint64) * salt)
    hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
    return w.at[hit], w.row[hit]


def digests(words: C.Words, at: np.ndarray, window: int) -> np.ndarray:
    """A 128-bit BLAKE2b digest, as two integers, of the `window` words from each of `at`, joined by one space."""
    lens = words.ends - words.starts
    starts = np.cumsum(lens) - lens + np.arange(len(lens))
    text = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    text[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = words.data[words.used]
    raw, blake = text.tobytes(), hashlib.blake2b
    spans = zip(starts[at].tolist(), (starts[at + window - 1] + lens[at + window - 1]).tolist(), strict=True)
    made = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in spans])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def window_names(window: int, rounds: int):
    """Arrow map: (doc_key, text, symbols) -> (name_a, name_b, doc_key, start), each name's first start in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_key").to_numpy(zero_copy_only=False)
            raw, offs = C.text_parts(batch.column("text"))
            flags, flag_row = C.list_parts(batch.column("symbols"))
            for a, b in C.row_chunks(offs):
                words = C.Words(raw, offs[a : b + 1])
                mine = slice(*np.searchsorted(flag_row, (a, b)))
                at, row = _candidates(words, flags[mine], flag_row[mine] - a, window, rounds)
                if not len(at):
                    continue
                name = digests(words, at, window)
                order = np.lexsort((at, name[:, 0], row))  # one word of the digest is enough to bring equal ones together
                at, row, name = at[order], row[order], name[order]
                new = np.concatenate(([True], (name[1:] != name[:-1]).any(axis=1) | (row[1:] != row[:-1])))
                at, row, name = at[new], row[new], name[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(keys[a + row]), pa.array((at - words.first[row]).astype(np.int32))],
                    ["name_a", "name_b", "doc_key", "start"],
                )
            C.trim()

    return run


def _cut(doc: bytes, starts: np.ndarray, ends: np.ndarray, lost: np.ndarray) -> bytes:
    """doc without its lost words: of what stood between words, what follows a removed run goes with it (at the end, what precedes it)."""
    keep = np.flatnonzero(~lost)
    if not len(keep):
        return b""
    out, last = [], len(lost) - 1
    for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1):
        i, j = run[0], run[-1]
        end = len(doc) if j == last else ends[j] if j == keep[-1] else starts[j + 1]
        out.append(doc[starts[i] if i else 0 : end])
    return b"".join(out)


def kept_words(window: int, rounds: int, with_text: bool):
    """Arrow map: (doc_key, text, symbols, starts) -> what is left of each document; other columns pass."""

    def covered_words(batch: pa.RecordBatch) -> Iterator[tuple[int, C.Words, int, np.ndarray]]:
        """(row, words of its chunk, row in that, which of its words go) of the rows that lose any."""
        flagged = pa.compute.indices_nonzero(pa.compute.greater(pa.compute.fill_null(pa.compute.list_value_length(batch.column("symbols")), 0), 0)).to_numpy()
        some = batch.take(pa.array(flagged))  # the others lose nothing
        raw, offs = C.text_parts(some.column("text"))
        flags, flag_row = C.list_parts(some.column("symbols"))
        firsts, first_row = C.list_parts(some.column("starts"))
        for a, b in C.row_chunks(offs):
            words = C.Words(raw, offs[a : b + 1])
            mine, own = (slice(*np.searchsorted(x, (a, b))) for x in (flag_row, first_row))
            at, _ = _candidates(words, flags[mine], flag_row[mine] - a, window, rounds)
            at = at[~np.isin(at, words.first[first_row[own] - a] + firsts[own])]
            edge = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for r in np.unique(words.row[covered]):
                yield int(flagged[a + r]), words, int(r), covered[words.first[r] : words.first[r + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_parts(batch.column("text"))
            docs = [raw[offs[r] : offs[r + 1]].tobytes() for r in range(batch.num_rows)]
            n_removed = np.zeros(len(docs), np.int64)
            out: dict[int, bytes] = {}
            for r, words, k, lost in covered_words(batch):
                n_removed[r] = lost.sum()
                own = slice(words.first[k], words.first[k + 1])
                out[r] = _cut(docs[r], words.starts[own] - words.offs[k], words.ends[own] - words.offs[k], lost) if with_text else b" ".join(compress(docs[r].split(), ~lost))
            cols = {name: batch.column(name) for name in batch.schema.names if name not in ("text", "symbols", "starts")}
            cols |= {"n_words": pa.array([len(d.split()) for d in docs], pa.int64()), "n_removed": pa.array(n_removed)}
            if with_text:
                cols["text"] = pa.array([out[r].decode("utf-8") if r in out else t for r, t in enumerate(batch.column("text").to_pylist())], pa.string())
            else:
                cols["kept_sha256"] = pa.array([hashlib.sha256(out[r] if r in out else b" ".join(d.split())).hexdigest() for r, d in enumerate(docs)], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            C.trim()

    return run


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(symbols of each document that occur twice, starts of each document's candidate windows that come first)."""
    texts, mark = C.doc_frame(docs), C.made_so_far()
    seen = C.written(texts.mapInArrow(representatives(window, rounds), "symbol long, doc_key long, places int"), "seen")
    twice = seen.groupBy("symbol").agg(F.sum("places").alias("n")).where("n >= 2").select("symbol")
    flagged = C.written(seen.select("symbol", "doc_key").join(twice, "symbol").groupBy("doc_key").agg(F.collect_list("symbol").alias("symbols")), "symbols", release=True)
    C.drop_since(mark, [flagged])
    names = texts.join(flagged, "doc_key").mapInArrow(window_names(window, rounds), "name_a long, name_b long, doc_key long, start int")
    first = names.groupBy("name_a", "name_b").agg(F.min("doc_key").alias("doc_key"), F.min_by("start", "doc_key").alias("start"))
    # Written, so that the names' shuffle files go before the texts are shuffled again.
    starts = C.written(first.groupBy("doc_key").agg(F.collect_list(F.col("start").cast("long")).alias("starts")), "starts", release=True)
    return flagged, starts


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """Remove every word under a `window`-word sequence that also starts earlier.

    Earlier: in a smaller doc_id, or in the same document at an earlier word. Judged on
    the input. Null text and documents under `window` words lose nothing. Rows without a
    doc_id come before all others, in an order by hash of their texts, each text a document
    of its own; repeated rows are one document and get the same result. Further columns are
    ignored, or with_text=True kept beside the new text: a text that loses nothing stays as
    it is, null included, from others only the removed words and the space next to them go.
    """
    flagged, starts = repeats(docs, window, rounds)
    if with_text:
        rest = [F.col(C.quoted(c)) for c in docs.columns if c != "text"]
        base = docs.select(C.ided("doc_id", "text").alias("doc_key"), "text", F.struct(*rest).alias("rest"))
    else:
        base = C.doc_frame(docs)
    joined = base.join(flagged, "doc_key", "left").join(starts, "doc_key", "left")
    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    if not with_text:
        made = T.StructType([T.StructField("doc_key", T.LongType()), *counts, T.StructField("kept_sha256", T.StringType())])
        out = joined.mapInArrow(kept_words(window, rounds, False), made)
        return out.select(C.un_ided("doc_key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    made = T.StructType([T.StructField("doc_key", T.LongType()), base.schema["rest"], *counts, T.StructField("text", T.StringType())])
    out = joined.mapInArrow(kept_words(window, rounds, True), made)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns], "n_words", "n_removed")
