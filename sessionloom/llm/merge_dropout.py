"""SentencePiece merge-type encoding with seeded dropout, and decoding.

A chunk - a run of word-start marks and what follows - begins as characters. The agenda
holds its adjacent pairs whose joint text is a piece; the best pair (earliest piece, then
leftmost) merges and brings in its new neighbours. A candidate is skipped for good if the
keyed hash of (seed, document, place of the chunk in it, place of the pair) falls under the
dropout. So a seed fixes every segmentation, seeds, documents and the occurrences of a word
in a document differ, rate 0 is the tokenizer's own encoding, and decoding always gives back
the text. For that a mark that stands in the text itself is encoded as its bytes, where the
tokenizer would take it for a space.

What a chunk merges to depends on which of the candidates that can arise in it are dropped.
Occurrences of a frequent chunk that drop the same ones are merged once a run of documents,
the others each on its own, all in arrays; long chunks go through a heap.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark of the text itself while it is encoded; no text holds it, as it is half a surrogate pair.
OWN_MARK = "\ud800"
#: Candidates of a chunk whose drops are told apart by one integer.
BITS = 62
#: From so many occurrences in a run of documents on, those that drop the same are looked for; results do not depend on it.
OFTEN = 32
#: Distinct chunks whose candidates a worker remembers.
KNOWN = 200_000
#: Chunks of more characters are merged on a heap.
WIDE = 48
NONE = np.int32(2**31 - 1)
CHUNK = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")


@dataclass
class Vocabulary:
    """Symbols: pieces by id, then characters that no piece is; pairs: (left, right) -> joint piece."""

    path: str
    texts: list[str] = field(default_factory=list)
    symbol: dict[str, int] = field(default_factory=dict)
    codes: dict[str, np.ndarray] = field(default_factory=dict)  # place_codes() of chunks met so far

    def __post_init__(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        self.size = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.symbol = {self.texts[i]: i for i in plain}
        self.bytes = {model.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        rows = []
        for i in plain:
            t = self.texts[i]
            for k in range(1, len(t)):
                a, b = self.symbol.get(t[:k]), self.symbol.get(t[k:])
                if a is not None and b is not None:
                    rows.append((a << 32 | b, i, -model.get_score(i)))
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.joint = np.array([r[1] for r in rows], np.int32)
        order = {s: k for k, s in enumerate(sorted({r[2] for r in rows}))}
        self.rank = np.array([order[r[2]] for r in rows], np.int32)
        self.by_pair = {int(k): (int(r), int(j)) for k, r, j in zip(self.keys, self.rank, self.joint, strict=True)}
        self.sketch = np.zeros(1 << 20, bool)
        self.sketch[C.mix(self.keys.astype(np.uint64)) >> np.uint64(44)] = True

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joint piece) of symbol pairs; rank NONE where their text is no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -1
        rank, joint = np.full(len(key), NONE, np.int32), np.full(len(key), -1, np.int32)
        some = np.flatnonzero(self.sketch[C.mix(key.astype(np.uint64)) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        hit = self.keys[at] == key[some]
        rank[some[hit]], joint[some[hit]] = self.rank[at[hit]], self.joint[at[hit]]
        return rank, joint


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path; a worker builds it once."""
    return Vocabulary(path)


def place_key(chunk: np.ndarray, start, split, end, whole: bool = True) -> np.ndarray:
    """Hash of a candidate: its chunk's key and where its halves begin, meet and end; not whole: the part without the key."""
    with np.errstate(over="ignore"):
        at = np.asarray(start, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(split, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(end, np.uint64) * np.uint64(0x165667B19E3779F9)
        return C.mix(chunk ^ C.mix(at)) if whole else C.mix(at)


def occurrence_keys(seed: int, documents: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key of each chunk: by seed, document and place among the document's chunks."""
    start = int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), "little")
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        own = C.mix(np.asarray(documents, np.int64).astype(np.uint64) ^ np.uint64(start))
        return C.mix(np.repeat(own, counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def limit_of(rate: float) -> int:
    return min(int(rate * 2**64), 2**64 - 1)


def place_codes(v: Vocabulary, text: str) -> np.ndarray:
    """What place_key() mixes into a chunk's key, for every candidate that can arise in it under any drops."""
    n = len(text)
    sym = [v.symbol.get(c) for c in text]
    # Spans that a symbol can cover, by their end: (start, symbol).
    ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    found: list[tuple[int, int, int]] = []
    for e in range(1, n + 1):
        if sym[e - 1] is None:
            continue
        own = {e - 1: sym[e - 1]}
        for m in range(e - 1, 0, -1):
            right = own.get(m)
            if right is None:
                continue
            for a, left in ending[m]:
                hit = v.by_pair.get(left << 32 | right)
                if hit:
                    found.append((a, m, e))
                    own[a] = hit[1]
        ending[e] = list(own.items())
    at = np.array(found, np.uint64).reshape(-1, 3)
    return place_key(np.uint64(0), at[:, 0], at[:, 1], at[:, 2], False)


def merge_one(v: Vocabulary, text: str, key: int, rate: float) -> list[int]:
    """Symbols of one chunk by agenda on a heap; a character that is no piece is -1 - its code."""
    sym = [v.symbol.get(c, -1 - ord(c)) for c in text]
    n, limit = len(sym), limit_of(rate)
    nxt, prv, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= n or sym[i] < 0 or sym[j] < 0:
            return
        found = v.by_pair.get(sym[i] << 32 | sym[j])
        if found and not (limit and int(place_key(np.uint64(key), i, j, ends[j])) < limit):
            heapq.heappush(heap, (found[0], i, j, ends[j], found[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, end, joint = heapq.heappop(heap)
        if not alive[i] or not alive[j] or nxt[i] != j or ends[j] != end:
            continue
        sym[i], ends[i], alive[j] = joint, end, False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    return [s for s, a in zip(sym, alive, strict=True) if a]


def merge_many(v: Vocabulary, chunks: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """merge_one for many chunks of like length at once: (all their symbols, how many each has)."""
    lens = np.array([len(c) for c in chunks])
    n, width = len(chunks), int(lens.max())
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.flatnonzero(np.bincount(codes))
    of_code = np.zeros(int(kinds[-1]) + 1, np.int32)
    of_code[kinds] = [v.symbol.get(chr(c), -1 - int(c)) for c in kinds]
    flat = of_code[codes]
    sym = np.full((n, width + 1), -(2**31) + 1, np.int32)
    sym[np.arange(width + 1)[None, :] < lens[:, None]] = flat
    pos = np.tile(np.arange(width + 2, dtype=np.int32), (n, 1))  # where each symbol begins; the next one tells where it ends
    pos = np.minimum(pos, lens[:, None].astype(np.int32))
    limit = np.uint64(limit_of(rate))
    rank = np.full((n, width + 1), NONE, np.int32)
    joint = np.full((n, width + 1), -1, np.int32)
    every = np.arange(n)
    live = lens.copy()

    def offer(rows: np.ndarray, i: np.ndarray) -> None:
        r, j = v.pairs(sym[rows, i], sym[rows, i + 1])
        if limit:
            some = np.flatnonzero(r != NONE)
            a, b = rows[some], i[some]
            lost = place_key(keys[a], pos[a, b], pos[a, b + 1], pos[a, b + 2]) < limit
            r[some[lost]] = NONE
        rank[rows, i], joint[rows, i] = r, j

    for i in range(width - 1):
        rows = np.flatnonzero(lens > i + 1)
        offer(rows, np.full(len(rows), i))
    active = every[lens > 1]
    while len(active):
        best = np.argmin(rank[active], axis=1)
        go = rank[active, best] != NONE
        active, best = active[go], best[go]
        if not len(active):
            break
        sym[active, best] = joint[active, best]
        # Close the gap behind the merged symbol.
        span = int(live[active].max())
        column = np.arange(span)[None, :]
        take = np.minimum(column + (column > best[:, None]), width)
        rows = active[:, None]
        sym[active, :span] = sym[rows, take]
        rank[active, :span], joint[active, :span] = rank[rows, take], joint[rows, take]
        pos[active, :span] = pos[rows, take]
        pos[active, span] = pos[active, span + 1] if span + 1 <= width + 1 else pos[active, span]
        live[active] -= 1
        left = best > 0
        offer(active[left], best[left] - 1)
        offer(active, best)
        active = active[live[active] > 1]
    return sym[np.arange(width + 1)[None, :] < live[:, None]], live


class Encoder:
    """Encodes texts of one (seed, rate); decode() undoes any of them."""

    def __init__(self, path: str = VOCABULARY, seed: int = 0, rate: float = 0.1, wide: int = WIDE):
        self.v, self.seed, self.rate, self.wide = vocabulary(path), seed, rate, wide

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def _bytes(self, symbol: int) -> list[int]:
        """The ids of a character that is no piece."""
        c = chr(-1 - symbol)
        return [self.v.byte_ids[b] for b in (MARK if c == OWN_MARK else c).encode("utf-8", "surrogatepass")]

    def _ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many chunks, and how many each has, with characters that are no pieces as bytes."""
        odd = np.unique(symbols[symbols < 0])
        if not len(odd):
            return symbols, sizes
        own = {int(x): (np.flatnonzero(symbols == x), self._bytes(int(x))) for x in odd}
        width = np.ones(len(symbols), np.int64)
        for at, ids in own.values():
            width[at] = len(ids)
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]), np.int32)
        out[ends - width] = symbols
        for at, ids in own.values():
            for k, i in enumerate(ids):
                out[(ends - width)[at] + k] = i
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return out, np.diff(upto)

    def drops(self, words: list[str], word: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of each occurrence of words: the set of dropped candidates as an integer, or -1 where it is not told.

        Words that are longer than `wide` or rarer than OFTEN are not told; of more than BITS candidates only the empty set (0) is.
        """
        out = np.zeros(len(word), np.int64)
        if not self.rate:
            return out
        known = self.v.codes
        if len(known) > KNOWN:
            known.clear()
        own = []
        for w, often in zip(words, np.bincount(word, minlength=len(words)) >= OFTEN, strict=True):
            if not often or len(w) > self.wide:
                own.append(None)
                continue
            c = known.get(w)
            if c is None:
                c = known[w] = place_codes(self.v, w)
            own.append(c)
        size = np.array([-1 if c is None else len(c) for c in own])
        first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        pool = np.concatenate([np.zeros(0, np.uint64), *[c for c in own if c is not None]])
        limit = np.uint64(limit_of(self.rate))
        out[size[word] < 0] = -1
        for a in range(0, len(word), 1 << 17):
            part = word[a : a + (1 << 17)]
            order = np.argsort(-size[part], kind="stable")
            n, at, key = size[part][order], first[part][order], keys[a : a + (1 << 17)][order]
            got = np.zeros(len(part), np.int64)
            many = int(np.searchsorted(-n, -BITS))  # those before it have more than BITS
            for k in range(int(n[0]) if len(n) else 0):
                live = int(np.searchsorted(-n, -k))  # more than k candidates
                lost = C.mix(key[:live] ^ pool[at[:live] + k]) < limit
                cut = min(many, live)
                got[:cut][lost[:cut]] = -1
                if k < BITS:
                    got[cut:live] |= lost[cut:].astype(np.int64) << k
            told = n >= 0
            out[a + order[told]] = got[told]
        return out

    def encode_batch(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of each text; documents: the key of each one's document."""
        split = [self.chunks(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        flat = [c for s in split for c in s]
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        if any(MARK in t for t in texts):  # pandas cannot tell half surrogates apart
            known: dict[str, int] = {}
            word = np.array([known.setdefault(c, len(known)) for c in flat], np.int64)
            words = list(known)
        else:
            word, found = pd.factorize(np.array(flat, object))
            words = found.tolist()
        every = occurrence_keys(self.seed, np.array(documents, np.int64), counts)
        dropped = self.drops(words, word, every)
        # Occurrences with the same drops stand for each other.
        alone = np.flatnonzero(dropped < 0)
        told = np.flatnonzero(dropped >= 0)
        by = told[np.lexsort((dropped[told], word[told]))]
        new = np.ones(len(by), bool)
        new[1:] = (word[by[1:]] != word[by[:-1]]) | (dropped[by[1:]] != dropped[by[:-1]])
        some = np.concatenate((by[new], alone))
        of = np.empty(len(word), np.int64)
        of[by], of[alone] = np.cumsum(new) - 1, int(new.sum()) + np.arange(len(alone))
        keys = every[some]
        lens = np.array([len(w) for w in words])[word[some]]
        order = np.argsort(lens, kind="stable")
        short = int(np.searchsorted(lens[order], self.wide, "right"))
        parts, sizes = [], []
        for a in range(0, short, 16384):
            own = order[a : min(a + 16384, short)]
            symbols, n = merge_many(self.v, [flat[i] for i in some[own].tolist()], keys[own], self.rate)
            parts.append(symbols)
            sizes.append(n)
        for i in order[short:]:
            parts.append(np.array(merge_one(self.v, flat[some[i]], int(keys[i]), self.rate), np.int32))
            sizes.append(np.array([len(parts[-1])]))
        pool, size = self._ids(np.concatenate(parts).astype(np.int32), np.concatenate(sizes))
        first, sizes = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
        first[order], sizes[order] = np.cumsum(size) - size, size
        got = sizes[of]
        ends = np.cumsum(got)
        spread = pool[np.repeat(first[of] - (ends - got), got) + np.arange(int(ends[-1]))]
        cuts = np.concatenate(([0], ends))[np.cumsum(counts)]
        return np.split(spread, cuts[:-1])

    def decode(self, ids) -> str:
        """The text of ids: bytes become characters, marks spaces, the first space goes."""
        out = bytearray()
        for i in ids:
            b = self.v.bytes.get(int(i))
            if b is not None:
                out.append(b)
            else:
                out += self.v.texts[int(i)].replace(MARK, " ").encode("utf-8")
        return bytes(out).decode("utf-8", "surrogatepass")[1:]


def _pieces_table(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, where each begins) with marks as spaces, for decoding in arrays."""
    parts = [bytes([v.bytes[i]]) if i in v.bytes else v.texts[i].replace(MARK, " ").encode("utf-8") for i in range(v.size)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def encoded(path: str, seed: int, rate: float, digest: bool):
    """Arrow map: (doc_key, document, text) -> ids of each text, or their count, hash and whether they decode to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, seed, rate)
        table, first = _pieces_table(encoder.v)
        gc.disable()  # millions of short texts, and no cycles among them
        for batch in batches:
            _, offs = C.text_parts(batch.column("text"))
            for a, b in C.row_chunks(offs, 8 * C.CHUNK_BYTES):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = encoder.encode_batch(texts, part.column("document").to_pylist())
                n = pa.array([len(x) for x in ids], pa.int64())
                if not digest:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    made = {"n_ids": n, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}
                else:
                    whole = []
                    for t, x in zip(texts, ids, strict=True):
                        size = first[x + 1] - first[x]
                        ends = np.cumsum(size)
                        raw = table[np.repeat(first[x] - (ends - size), size) + np.arange(int(ends[-1]))] if len(x) else table[:0]
                        whole.append(raw[1:].tobytes() == t.encode("utf-8"))
                    made = {"n_ids": n, "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), "lossless": pa.array(whole, pa.bool_())}
                yield pa.RecordBatch.from_arrays([part.column("doc_key"), *made.values()], ["doc_key", *made])
        gc.enable()

    return run


def encode(docs: DataFrame, seed: int = 0, rate: float = 0.1, path: str = VOCABULARY, digest: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids) of every document; digest: ids_sha256 and lossless in place of ids.

    ids_sha256 is over the ids as 32-bit little-endian integers; lossless says that the ids
    decode to the very text. Null and empty texts have no ids. Dropout depends on doc_id (on the
    text, where that is null) and the place in the text, so repeated rows are encoded alike.
    Other columns are ignored; an empty table gives an empty result.
    """
    document = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    x = docs.select(C.ided("doc_id").alias("doc_key"), document.alias("document"), "text")
    made = "ids_sha256 string, lossless boolean" if digest else "ids array<int>"
    out = x.mapInArrow(encoded(path, seed, rate, digest), f"doc_key long, n_ids long, {made}")
    return out.select(C.un_ided("doc_key").alias("doc_id"), *out.columns[1:])


def decode(encodings: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from encode()'s rows. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
