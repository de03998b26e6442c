"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest sequence. Pieces are dealt into
buckets of bounded size; each bucket is packed by best-fit decreasing: a piece goes to the
open bin with the least room that takes it. If there is none, a bin opens, of the length
that promises the least cost a token: for each permitted length the pieces not yet placed
are drawn, largest fitting first, and the cost of the sequence that holds what was drawn is
divided by its tokens. At last each bin is cut down to the shortest sequence that holds its
contents. The packings that open one length only are tried too, and the cheapest stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that one task packs, about.
BUCKET = 1 << 16
#: What a sequence costs beside its length, in tokens, and the length at which attention doubles its cost.
OVERHEAD, ATTENTION = 32, 65536


def cost(length: int) -> float:
    """What a sequence of this length costs, full or not."""
    return OVERHEAD + length * (1 + length / ATTENTION)


def shortest(lengths: tuple[int, ...], tokens: int) -> int:
    return next(n for n in lengths if n >= tokens)


def promising(size: int, count: list[int], lengths: tuple[int, ...]) -> int:
    """The length to open for a piece of `size`: least cost a token of what the unplaced pieces (count of each size) would fill."""
    some = 0  # bit s: a piece of s tokens is there
    for s, n in enumerate(count):
        if n:
            some |= 1 << s
    return _promising(size, count, some, lengths)


def _promising(size: int, count: list[int], some: int, lengths: tuple[int, ...]) -> int:
    best, least = 0, float("inf")
    for length in lengths:
        if length < size:
            continue
        room, drawn, have = length - size, {size: 1}, some
        if count[size] <= 1:
            have &= ~(1 << size)
        while room:
            s = (have & ((2 << room) - 1)).bit_length() - 1
            if s <= 0:
                break
            n = min(room // s, count[s] - drawn.get(s, 0))
            drawn[s] = drawn.get(s, 0) + n
            room -= n * s
            if drawn[s] == count[s]:
                have &= ~(1 << s)
        filled = length - room
        price = cost(shortest(lengths, filled)) / filled
        if price < least:
            best, least = length, price
    return best


def best_fit(sizes: list[int], lengths: tuple[int, ...], opening: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset in it, bin lengths) for pieces in falling order of size.

    A bin opens with the length that promises least cost or, if it is given, with `opening`
    tokens of room (the least permitted length that holds a larger piece), and is finally cut
    down to its contents.
    """
    stacks: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    room = 0  # bit r: some open bin has r tokens of room
    count = [0] * (lengths[-1] + 1)
    some = 0
    for size in sizes:
        count[size] += 1
        some |= 1 << size
    used: list[int] = []
    full: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                room &= ~(1 << left)
        else:
            b = len(used)
            used.append(0)
            full.append(max(opening, shortest(lengths, size)) if opening else _promising(size, count, some, lengths))
        count[size] -= 1
        if not count[size]:
            some &= ~(1 << size)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left = full[b] - used[b]
        if left:
            stacks[left].append(b)
            room |= 1 << left
    return bins, offsets, [shortest(lengths, u) for u in used]


def pack_pieces(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest best_fit: every bin choosing its length, or all opening one; of equals the first in this order."""
    tries = [best_fit(sizes, lengths, opening) for opening in (None, *lengths)]
    return min(tries, key=lambda t: sum(map(cost, t[2])))


def _packed(lengths: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        order = np.lexsort((table["row"].to_numpy(), table["piece"].to_numpy(), table["doc_key"].to_numpy(), -size))
        bins, offsets, full = pack_pieces(size[order].tolist(), lengths)
        bucket = table["bucket"][0].as_py()
        out = table.take(pa.array(order)).select(["doc_key", "piece", "start", "length"])
        out = out.append_column("bin_id", pa.array((bucket << 32) + np.array(bins, np.int64)))
        out = out.append_column("bin_offset", pa.array(offsets, pa.int32()))
        return out.append_column("capacity", pa.array([full[b] for b in bins], pa.int32()))

    return run


def word_tokens() -> Column:
    """Words of the text, as its length in tokens where no tokenizer is asked for."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\t-\r]+"))


def pack(docs: DataFrame, n_tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity): where each piece of each document goes.

    n_tokens is the length column (by default the number of words). A document longer than the
    longest permitted length is cut; one of no tokens (null text among them) has one piece of
    length 0 in no bin. Pieces are dealt by a number of their row, so repeated rows and null ids
    are packed and spread like any other; of pieces of one size the smaller doc_id goes first;
    other columns are ignored; an empty table gives no rows. `bucket` pieces, about, are packed
    together: more of them fill sequences better, in one task's memory.
    """
    lengths = tuple(sorted(lengths))
    top = F.lit(lengths[-1])
    n = (word_tokens() if n_tokens is None else F.greatest(F.coalesce(n_tokens, F.lit(0)), F.lit(0))).cast("long")
    cut = docs.select(C.ided("doc_id").alias("doc_key"), n.alias("n"))
    cut = cut.select("doc_key", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), top.cast("long"))).alias("piece", "start"))
    pieces = C.written(cut.select("doc_key", "piece", "start", F.least(F.col("n") - F.col("start"), top).cast("int").alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    some = pieces.where("length > 0")
    buckets = max(1, -(-some.count() // bucket))
    dealt = some.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    made = "doc_key long, piece int, start long, length int, bin_id long, bin_offset int, capacity int"
    packed = dealt.groupBy("bucket").applyInArrow(_packed(lengths), made)
    none = pieces.where("length = 0").drop("row").select("*", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"), F.lit(None).cast("int").alias("capacity"))
    return packed.unionByName(none).select(C.un_ided("doc_key").alias("doc_id"), "piece", "start", "length", "bin_id", "bin_offset", "capacity")
