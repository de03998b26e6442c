"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

Each language has a probability for every piece of a public vocabulary. A word (with its
word-start mark) scores the sum, over all ways to cut it into pieces, of the product of the
pieces' probabilities: the forward algorithm, which keeps the states of the last characters
only, so words of any length are scored whole. A text's log-score is the sum over its words.
Training is one expectation step: posterior piece counts of all learning texts under a flat
start (forward-backward), summed by language and smoothed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
#: Probability of a character that no piece covers.
RARE = 1e-7
#: Characters of a word that are held at a time; a longer word goes on from the state of its last ones, so it is never cut.
BLOCK = 512
#: Numbers that one step's states hold, about, over words, characters and languages.
CELLS = 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> list[str]:
    """The text pieces of a public tokenizer's model, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """Lookup of pieces by the hash of their characters, for each length."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        lens = np.array([len(p) for p in pieces], np.int64)
        self.tables = {}
        for n in np.unique(lens[lens > 0]).tolist():
            own = np.flatnonzero(lens == n)
            codes = np.frombuffer("".join(pieces[i] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * _FACTOR + C.mix(codes[:, k].astype(np.uint64) + np.uint64(1))
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], own[order].astype(np.int32))
        self.lengths = sorted(self.tables)
        self.sketch = np.zeros((self.lengths[-1] + 1, 1 << 18), bool)  # which top bits occur among the pieces of a length
        for n, (known, _) in self.tables.items():
            self.sketch[n, known >> np.uint64(46)] = True

    def find(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat places, piece ids) of the hashes that are pieces."""
        known, ids = self.tables[n]
        hashes = hashes.ravel()
        some = np.flatnonzero(self.sketch[n][hashes >> np.uint64(46)])
        asked = hashes[some]
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        same = known[at] == asked
        return some[same], ids[at[same]]


_known: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The pieces of a vocabulary; a worker builds them once."""
    if path not in _known:
        _known[path] = Pieces(read_vocabulary(path))
    return _known[path]


def word_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with 0, lengths) of words, each with its start mark."""
    lens = np.array([len(w) + 1 for w in words], np.int64)
    codes = np.zeros((len(words), int(lens.max()) if len(words) else 1), np.uint32)
    codes[:, 0] = MARK
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    inside = np.arange(codes.shape[1])[None, :] < lens[:, None]
    inside[:, 0] = False
    codes[inside] = flat
    return codes, lens


class Cuts:
    """The pieces that end at the places a + 1 .. b of a word matrix: at[j - a] holds (size, words, piece ids) for end place j."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, lens: np.ndarray, a: int = 0, b: int | None = None):
        b = codes.shape[1] if b is None else b
        self.a, self.b, self.span = a, b, pieces.lengths[-1]
        c = max(0, a - self.span + 1)  # pieces may begin before the block
        part = codes[:, c:b]
        n, width = part.shape
        self.at: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(b - a + 1)]
        self.lost: list[np.ndarray] = [np.zeros(0, np.int64)]  # by end place: words whose character before it is no piece
        with np.errstate(over="ignore"):
            mixed = np.ascontiguousarray(C.mix(part.astype(np.uint64) + np.uint64(1)).T)  # places x words
            for size in range(1, min(self.span, width) + 1):
                # h[j]: hash of the `size` characters of each word that begin at place j
                h = h[:-1] * _FACTOR + mixed[size - 1 :] if size > 1 else mixed  # noqa: F821
                if size not in pieces.tables:
                    continue
                skip = max(0, a - c - size + 1)  # those that end at a or before
                where, ids = pieces.find(h[skip:], size)
                place, word = np.divmod(where, n)
                place += skip + size + c
                inside = lens[word] >= place
                place, word, ids = place[inside], word[inside], ids[inside]
                cuts = np.searchsorted(place, np.arange(a + 1, b + 2))
                for j in range(a + 1, b + 1):
                    own = slice(cuts[j - a - 1], cuts[j - a])
                    if own.start < own.stop:
                        self.at[j - a].append((size, word[own], ids[own]))
        for j in range(a + 1, b + 1):
            lost = lens >= j
            for size, word, _ in self.at[j - a]:
                if size == 1:
                    lost[word] = False
            self.lost.append(np.flatnonzero(lost))


def fresh(span: int, n: int, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(alphas, log scales) of the places before a word and of its start; the last row is the start."""
    alpha, scale = np.zeros((span + 1, n, langs)), np.zeros((span + 1, n))
    alpha[-1] = 1.0
    return alpha, scale


def forward(cuts: Cuts, state: tuple[np.ndarray, np.ndarray], lens: np.ndarray, prob: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alphas (scaled) and their log scales for the places from a - span to b, given those up to a; fills out for words that end in the block.

    prob: pieces x languages, with one row more (the last) of zeros for "no piece". out: words x languages.
    """
    span, steps, n, langs = cuts.span, cuts.b - cuts.a, len(lens), prob.shape[1]
    alpha, scale = np.empty((span + 1 + steps, n, langs)), np.empty((span + 1 + steps, n))
    alpha[: span + 1], scale[: span + 1] = state[0][-span - 1 :], state[1][-span - 1 :]
    for i in range(1, steps + 1):
        j = span + i
        now = np.zeros((n, langs))
        for size, hit, ids in cuts.at[i]:
            back = np.exp(scale[j - size][hit] - scale[j - 1][hit])[:, None]
            now[hit] += alpha[j - size][hit] * prob[ids] * back
        lost = cuts.lost[i]
        now[lost] += alpha[j - 1][lost] * RARE
        top = now.max(axis=1)
        top[top <= 0] = 1.0
        alpha[j] = now / top[:, None]
        scale[j] = scale[j - 1] + np.log(top)
        done = lens == cuts.a + i
        if done.any():
            out[done] = np.log(np.maximum(alpha[j][done], 1e-300)) + scale[j][done][:, None]
    return alpha, scale


def _blocks(width: int) -> list[tuple[int, int]]:
    return [(a, min(width, a + BLOCK)) for a in range(0, width, BLOCK)]


def word_scores(pieces: Pieces, codes: np.ndarray, lens: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all its segmentations."""
    out = np.zeros((len(lens), prob.shape[1]))
    state = fresh(pieces.lengths[-1], len(lens), prob.shape[1])
    for a, b in _blocks(codes.shape[1]):
        state = forward(Cuts(pieces, codes, lens, a, b), state, lens, prob, out)
    return out


def expected_counts(pieces: Pieces, codes: np.ndarray, lens: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posterior counts of pieces (one language), the words weighted by weight (words x groups): pieces x groups.

    Backward over the same blocks; held are the states between blocks and the inside of one.
    """
    span, n, blocks = pieces.lengths[-1], len(lens), _blocks(codes.shape[1])
    states, total = [fresh(span, n, 1)], np.zeros((n, 1))
    kept = None
    for a, b in blocks:
        kept = Cuts(pieces, codes, lens, a, b)
        alpha, scale = forward(kept, states[-1], lens, prob, total)
        states.append((alpha[-span - 1 :].copy(), scale[-span - 1 :].copy()))
    after = np.zeros((span + 1, n))  # what pieces that end in the next block give to places up to its start
    piece, share, word = [], [], []
    every = np.arange(n)
    for k in range(len(blocks) - 1, -1, -1):
        a, b = blocks[k]
        if k < len(blocks) - 1:
            kept = Cuts(pieces, codes, lens, a, b)
            alpha, scale = forward(kept, states[k], lens, prob, np.zeros((n, 1)))
        # beta[j]: sum over the ways from place j on, times exp(scale[j] - total): at most 1 by this.
        beta = np.zeros((span + 1 + b - a, n))
        beta[-span - 1 :] += after[max(0, len(after) - len(beta)) :]
        for i in range(b - a, 0, -1):
            j = span + i
            done = every[lens == a + i]
            beta[j][done] = np.exp(scale[j][done] - total[done, 0])
            for size, hit, ids in kept.at[i]:
                way = prob[ids, 0] * beta[j][hit] * np.exp(scale[j - size][hit] - scale[j][hit])
                beta[j - size][hit] += way
                piece.append(ids)
                share.append(alpha[j - size][hit, 0] * way)
                word.append(hit)
            lost = kept.lost[i]
            beta[j - 1][lost] += RARE * beta[j][lost] * np.exp(scale[j - 1][lost] - scale[j][lost])
        after = beta[: span + 1]
    ids, share, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (piece, share, word))
    return np.stack([np.bincount(ids, share * weight[word, g], prob.shape[0]) for g in range(weight.shape[1])], axis=1)


def _texts(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offs = C.text_parts(batch.column("text"))
    for a, b in C.row_chunks(offs, limit):
        yield a, b, batch.column("text").slice(a, b - a).to_pylist()


def _unique(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct lower-cased words, word of each occurrence, text of each occurrence)."""
    split = [(t or "").lower().split() for t in texts]
    at, words = pd.factorize(np.array(list(chain.from_iterable(split)), object))
    return list(words), at, np.repeat(np.arange(len(split)), [len(x) for x in split])


def _steps(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """Indices of words in steps of similar length, so padding is small, and of bounded states."""
    lens = np.array([len(w) for w in words])
    order = np.argsort(lens, kind="stable")
    b = len(order)
    while b:  # from the longest on
        width = min(int(lens[order[b - 1]]) + 1, BLOCK)
        a = max(0, b - max(1, min(16384, CELLS // (width * max(langs, 1)))))
        yield order[a:b]
        b = a


def piece_counts(vocabulary: str, langs: list[str]):
    """Arrow map: (text, lang) -> (lang, piece, n): expected piece counts under the flat start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        start = np.full((pieces.size + 1, 1), 1.0 / pieces.size)
        start[-1] = 0
        code = {x: i for i, x in enumerate(langs)}
        sums = np.zeros((pieces.size + 1, len(langs)))
        for batch in batches:
            own = [code.get(x, -1) for x in batch.column("lang").to_pylist()]
            for a, b, texts in _texts(batch, 12 * C.CHUNK_BYTES):
                words, at, row = _unique(texts)
                if not words:
                    continue
                lang = np.array(own[a:b])[row]
                keep = lang >= 0
                weight = np.bincount(at[keep] * len(langs) + lang[keep], minlength=len(words) * len(langs)).reshape(len(words), len(langs)).astype(float)
                for step in _steps(words, 1):
                    codes, lens = word_matrix([words[i] for i in step])
                    sums += expected_counts(pieces, codes, lens, start, weight[step])
            C.trim()
        piece, lang = np.nonzero(sums > 0)
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in lang], pa.string()), pa.array(piece.astype(np.int32)), pa.array(sums[piece, lang])], ["lang", "piece", "n"])

    return run


def scored(vocabulary: str, langs: list[str], prob: np.ndarray):
    """Arrow map: (doc_key, held_out, text) -> (doc_key, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            preds: list[str] = []
            scores: list[float] = []
            for _, _, texts in _texts(batch, 12 * C.CHUNK_BYTES):
                words, at, row = _unique(texts if langs else [])
                logs = np.zeros((len(words), len(langs)))
                for step in _steps(words, len(langs)):
                    codes, lens = word_matrix([words[i] for i in step])
                    logs[step] = word_scores(pieces, codes, lens, prob)
                for r, t in enumerate(texts):
                    mine = at[slice(*np.searchsorted(row, (r, r + 1)))]
                    if not langs or t is None or not any(map(str.isalpha, t)):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = logs[mine].sum(axis=0)
                    odds = np.exp(total - total.max())
                    best = int(np.argmax(total))
                    preds.append(langs[best])
                    scores.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_key", "held_out", "lang_pred", "score"])
            C.trim()

    return run


def fit(texts: DataFrame, vocabulary: str = VOCABULARY, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from (text, lang) rows; rows with null text or lang teach nothing.

    What comes to the driver is languages x pieces at most, whatever the corpus.
    """
    texts = texts.where("text is not null and lang is not null").select("text", "lang")
    langs = sorted(r[0] for r in texts.select("lang").distinct().collect())
    counted = texts.mapInArrow(piece_counts(vocabulary, langs), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    size = len(read_vocabulary(vocabulary))
    counts = np.full((size + 1, len(langs)), smoothing)
    code = {x: i for i, x in enumerate(langs)}
    np.add.at(counts, (rows["piece"].to_numpy(int), rows["lang"].map(code).to_numpy(int)), rows["n"].to_numpy(float))
    counts[-1] = 0
    return langs, counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-300)


def predict_languages(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Learns from the texts and non-null langs of documents whose crc32 of the id's text, mod 4,
    is not 2 (held_out). Null text or one without a letter is `und` with score 0, as is every
    text if there is nothing to learn from; of equal scores the first language by name wins.
    A null doc_id is not held out; repeated rows and other columns change nothing else.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(C.ided("doc_id").alias("doc_key"), held.alias("held_out"), "text", "lang")
    langs, prob = fit(rows.where("not held_out"), vocabulary)
    out = rows.select("doc_key", "held_out", "text").mapInArrow(scored(vocabulary, langs, prob), "doc_key long, held_out boolean, lang_pred string, score double")
    return out.select(C.un_ided("doc_key").alias("doc_id"), "held_out", "lang_pred", "score")
