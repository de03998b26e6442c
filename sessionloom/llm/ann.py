"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts with few edges between
them; a small classifier learns which parts a vector's neighbours lie in. Every vector is
stored in its most probable part, every query visits its most probable parts, and what it
finds there is ranked by exact distance. How many parts a query visits is set on held-out
vectors of the sample so that the wanted recall is reached.

Bounds: the graph and the classifier see SAMPLE vectors at most; every vector is indexed.
Parts grow with the table, so a part stays at about PART_ROWS vectors as long as the sample
tells that many parts apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 8192
NEIGHBOURS = 10
#: Least number of parts; vectors of a part, about; vectors of the sample that a part needs.
PARTS, PART_ROWS, PART_SAMPLE = 16, 1 << 16, 16
HIDDEN = 128
RECALL = 0.95
#: Vectors, and queries, that one search task holds.
BLOCK = 8192


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest vectors of each query (all, if fewer), in no order."""
    k = min(k, len(vectors))
    norms = (vectors**2).sum(1)
    out = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), 512):
        d = norms[None, :] - 2 * queries[a : a + 512] @ vectors.T
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(vectors) else np.arange(k)
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 0.1, seed: int = 1) -> np.ndarray:
    """A part for each vertex of the neighbour graph: halved along main directions, then moved to cut fewer edges.

    No part grows over (1 + slack) times the mean.
    """
    n = len(vectors)
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            x = vectors[own] - vectors[own].mean(0)
            axis = np.linalg.eigh(x.T @ x)[1][:, -1]
            far = own[np.argsort(x @ axis, kind="stable")[len(own) // 2 :]]
            part[far] = p + size
        size *= 2
    ends = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    starts = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    order = np.argsort(starts, kind="stable")
    ends, at = ends[order], np.searchsorted(starts[order], np.arange(n + 1))
    most = int(np.ceil((1 + slack) * n / size))
    count = np.bincount(part, minlength=size)
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(n):
            near = np.bincount(part[ends[at[v] : at[v + 1]]], minlength=size)
            best = int(np.argmax(np.where(count < most, near, -1)))
            if near[best] > near[part[v]]:
                count[part[v]] -= 1
                count[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


class Scaled:
    """Brings vectors of any magnitude to the middle and spread of a sample; only routing sees what this makes of them."""

    def __init__(self, sample: np.ndarray):
        self.middle = np.median(sample, axis=0)
        with np.errstate(over="ignore"):
            off = np.abs(sample - self.middle)
        some = off[off > 0]
        self.spread = float(np.median(some)) if len(some) else 1.0

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((vectors - self.middle) / self.spread, -30, 30)


class Router:
    """One hidden layer; trained on which parts hold a vector and its neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, rounds: int = 40, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], target.shape[1]
        w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        self.w, step = w, 0
        for _ in range(rounds):
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[own] @ w[0] + w[1], 0)
                p = _softmax(h @ w[2] + w[3])
                e = (p - target[own]) / len(own)
                back = (e @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[own].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] -= 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each scaled vector, most probable first."""
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(vectors: np.ndarray, parts: int = PARTS, k: int = 10, recall: float = RECALL) -> tuple[Scaled, Router, int]:
    """(scale, router, parts to visit) from a sample of vectors."""
    scale = Scaled(vectors)
    vectors = scale(vectors)
    graph = nearest(vectors, vectors, min(NEIGHBOURS + 1, len(vectors)))
    part = balanced_parts(vectors, graph, parts)
    size = int(part.max()) + 1 if len(part) else 1
    target = np.zeros((len(vectors), size))
    for column in graph.T:
        target[np.arange(len(vectors)), part[column]] += 1
    target /= target.sum(1, keepdims=True)
    held = np.arange(len(vectors)) % 8 == 0 if len(vectors) >= 64 else np.zeros(len(vectors), bool)
    router = Router(vectors[~held], target[~held])
    if not held.any():
        return scale, router, size
    ranked = router.ranked(vectors)
    place = np.argsort(ranked[held], axis=1)  # of each part, for each held-out query
    found = np.take_along_axis(place, ranked[:, 0][nearest(vectors[held], vectors, k + 1)], axis=1)
    share = [(found < m).mean() for m in range(1, size + 1)]
    return scale, router, next((m for m, s in enumerate(share, 1) if s >= recall), size)


def sound(embedding: str = "embedding") -> Column:
    """Not null, not zero, and all components finite."""
    x = F.col(embedding)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _placed(scale: Scaled, router: Router, visit: int, d: int):
    """Arrow map: (vec_id, embedding) -> (vec_id, embedding, slot, part, visits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            ranked = router.ranked(scale(_matrix(batch.column("embedding"), d))).astype(np.int32)
            slot = C.mix(ids.view(np.uint64) + np.arange(seen, seen + len(ids)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)
            seen += len(ids)
            visits = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * visit, visit, np.int32)), pa.array(ranked[:, :visit].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), C.signed(slot), pa.array(ranked[:, 0]), visits], ["vec_id", "embedding", "slot", "part", "visits"])

    return run


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances; by scaled differences where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        dist = np.sqrt(((vectors - query) ** 2).sum(1))
        odd = np.flatnonzero(~((dist > 1e-140) & (dist < 1e150)))
        if len(odd):
            half = np.abs(vectors[odd] / 4 - query / 4)  # a difference of two doubles can overflow, one of quarters cannot
            most = half.max(axis=1, initial=0)
            dist[odd] = np.where(most > 0, np.sqrt(((half / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)) * most * 4, 0)
    return dist


def rerank(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows but those of id `own`: exact, ties to the smaller id."""
    other = np.flatnonzero(ids != own)
    if len(other) > k and norms.max(initial=0) < 1e290:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = norms[other] - 2 * (vectors[other] @ query)
            bound = np.partition(rough, k - 1)[k - 1]
            slack = 1e-9 * (1 + abs(bound) + norms.max() + float(query @ query))
        if np.isfinite(slack):
            other = other[rough <= bound + slack]
    dist = distances(query, vectors[other])
    best = np.lexsort((ids[other], dist))[:k]
    return ids[other][best], dist[best]


def _search(d: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, found, score = [], [], []
        if queries.num_rows and rows.num_rows:
            vectors, ids = _matrix(rows["embedding"], d), rows["vec_id"].to_numpy()
            with np.errstate(over="ignore"):
                norms = (vectors**2).sum(1)
            for x, i in zip(_matrix(queries["embedding"], d), queries["query_id"].to_numpy(), strict=True):
                got, dist = rerank(x, vectors, norms, ids, i, k)
                q.append(np.full(len(got), i))
                found.append(got)
                score.append(dist)
        out = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((q, np.int64), (found, np.int64), (score, np.float64))]
        return pa.table({"query_id": pa.array(out[0]), "vec_id": pa.array(out[1]), "score": pa.array(out[2])})

    return run


def parts_for(rows: int, sample: int) -> int:
    """A power of two: PARTS at least, for parts of about PART_ROWS, as far as the sample tells them apart."""
    wanted = max(PARTS, -(-rows // PART_ROWS))
    return max(PARTS, 1 << min((wanted - 1).bit_length(), (sample // PART_SAMPLE).bit_length() - 1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, parts: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by exact Euclidean distance in double precision.

    Rows of null id, and vectors that are null, zero or hold null or non-finite components take
    no part, nor do those of another length than most of the sample's, as they have no distance to
    these. Rows that share the query's id are its own; an id that is repeated asks once, with the
    least of its vectors, and is found as often as it stands. Ties go to the smaller id. Other
    columns are ignored; no queries or vectors: no rows. parts: by default grows with the table.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & sound())
    drawn = usable.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()["embedding"].combine_chunks()
    empty = usable.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    if not len(drawn):
        return empty
    lengths = drawn.value_lengths().to_numpy(zero_copy_only=False)
    d = int(np.bincount(lengths).argmax())
    of_d = usable.where(F.size("embedding") == d)
    parts = parts or parts_for(of_d.count(), sample)
    scale, router, visit = learn(_matrix(drawn.filter(pa.array(lengths == d)), d), parts, k, recall)
    made = "vec_id long, embedding array<double>, slot long, part int, visits array<int>"
    rows = C.written(of_d.select("vec_id", "embedding").mapInArrow(_placed(scale, router, visit, d), made), "vectors")
    asks = of_d.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(_placed(scale, router, visit, d), made)
    asks = C.written(asks.select(F.col("vec_id").alias("query_id"), "embedding", F.explode("visits").alias("part"), "slot"), "queries")

    def cuts(table: DataFrame, name: str) -> DataFrame:
        """How many blocks the rows of each part make: `parts` rows at most."""
        return table.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias(name))

    # Within a part every block of queries meets every block of vectors; a part of PART_ROWS has few of either.
    plan = F.broadcast(cuts(rows, "blocks").join(cuts(asks, "turns"), "part"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = asks.join(plan, "part").select("query_id", "embedding", "part", F.pmod("slot", F.col("turns")).alias("turn"), each("blocks").alias("block"))
    stored = rows.join(plan, "part").select("vec_id", "embedding", "part", each("turns").alias("turn"), F.pmod("slot", F.col("blocks")).alias("block"))
    keys = ["part", "turn", "block"]
    found = queries.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_search(d, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
