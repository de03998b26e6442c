"""N-gram Jaccard join on prefix trees.

Every document becomes its set of distinct word n-grams (63-bit hashes), numbered in one
global order: frequent n-grams last, else by hash. Two sets of Jaccard similarity t or more
share at least l n-grams among the first n - ceil(t n) + l of each (their prefixes), so these
prefixes route sets to each other. What meets goes through tries: a task stores the ordered
sets of its block in a prefix tree, a probe walks it from the root, the overlap counted on a
node holds for all sets below it, and a subtree is left as a whole as soon as what remains of
its longest set, or of the probe, cannot reach the overlap that its smallest set needs.

Groups may be large. Equal sets are one class. Each prefix n-gram first links its classes
to one hub (linear in the group); groups whose classes then lie in one component need no
further pair, which settles the groups of near copies. In what remains mixed, classes of like
size and different components pair where what follows the shared n-gram can still suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Bound of the list of frequent n-grams that is broadcast (8 bytes each), and of each task's counters:
#: kept, and held between two prunings.
FREQUENT = 1 << 20
COUNTERS, HELD = 1 << 18, 1 << 20
#: N-grams that one verification block holds, about.
BLOCK = 1 << 18
#: Classes of more documents than this, and than one in HOT_SHARE of all, are dealt by broadcast: there are at most HOT_SHARE.
HOT, HOT_SHARE = 1024, 1 << 16
HUB_ROUNDS = 3
#: N-grams that the prefixes of a linked pair share at least (fewer for sets smaller than that).
SHARED = 8


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-gram hashes; a shorter row's whole sequence is one n-gram."""
    words = C.Words(raw, offs)
    h = words.hashes(3, lower=True)
    grams = C.run_hash(h, np.arange(max(0, len(h) - width + 1)), width, 9) >> np.uint64(1)
    for r in range(len(offs) - 1):
        a, b = int(words.first[r]), int(words.first[r + 1])
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield C.run_hash(h, np.array([a]), b - a, 100 + b - a) >> np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def _merged(grams: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal n-grams summed; if there are over `most`, the least frequent go."""
    if not len(grams):
        return grams, counts
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    grams, counts = grams[new], np.add.reduceat(counts, new)
    if len(grams) > most:
        kept = counts > np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        grams, counts = grams[kept], counts[kept]
    return grams, counts


def gram_counts(width: int):
    """Arrow map: text -> (gram, n) of the task's n-grams that occur in several documents, as far as its counters reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        held = 0
        for batch in batches:
            raw, offs = C.text_parts(batch.column("text"))
            for a, b in C.row_chunks(offs):
                found, n = np.unique(np.concatenate(list(shingle_sets(raw, offs[a : b + 1], width)) or [grams[0][:0]]), return_counts=True)
                grams.append(found)
                counts.append(n)
                held += len(found)
                if held > HELD:
                    one, two = _merged(np.concatenate(grams), np.concatenate(counts), COUNTERS)
                    grams, counts, held = [one], [two], len(one)
        one, two = _merged(np.concatenate(grams), np.concatenate(counts), COUNTERS)
        kept = two > 1
        yield pa.RecordBatch.from_arrays([C.signed(one[kept]), pa.array(two[kept])], ["gram", "n"])

    return run


def frequent_grams(texts: DataFrame, width: int, least: int = 8) -> np.ndarray:
    """The n-grams that stand at the end of the global order, by their count over all texts: FREQUENT at most.

    Counting is approximate where tasks run out of counters. That changes only the order, which
    any total order may replace: results do not depend on it, only how many candidates there are.
    """
    counted = C.written(texts.mapInArrow(gram_counts(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    size = F.floor(8 * F.log2("n"))
    steps = sorted(counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["size"])  # under 512 rows
    taken, lowest = 0, None
    for r in steps:
        taken += r["c"]
        if taken > FREQUENT:
            break
        lowest = r["size"]
    if lowest is None:
        return np.zeros(0, np.uint64)
    rows = counted.where(size >= lowest).toPandas().sort_values(["n", "gram"])
    return rows["gram"].to_numpy(np.int64).view(np.uint64)


PAIR = ("probe", "probe_n", "m", "m_n")


class Order:
    """Numbers n-grams in the global order: all others by hash, then the frequent n-grams by their count."""

    def __init__(self, frequent: np.ndarray):
        self.by = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable").astype(np.uint64) + np.uint64(2**63)  # the number of each, in hash order

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The numbers of grams (sorted by hash), sorted."""
        if not len(self.by) or not len(grams):
            return grams
        at = np.minimum(np.searchsorted(self.by, grams), len(self.by) - 1)
        late = self.by[at] == grams
        if not late.any():
            return grams
        return np.concatenate((grams[~late], np.sort(self.rank[at[late]])))


def prefixes(width: int, percent: int, order: Order):
    """Arrow map: (doc_key, text) -> (doc_key, n, set_a, set_b, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = C.text_parts(batch.column("text"))
            n, set_a, set_b, prefix = [], [], [], []
            for a, b in C.row_chunks(offs):
                for grams in shingle_sets(raw, offs[a : b + 1], width):
                    size = len(grams)
                    n.append(size)
                    with np.errstate(over="ignore"):
                        set_a.append(np.add.reduce(C.mix(grams)) if size else np.uint64(0))
                        set_b.append(np.bitwise_xor.reduce(C.mix(grams + np.uint64(77))) if size else np.uint64(0))
                    prefix.append(order(grams)[: _prefix_length(size, percent)])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_key"),
                    pa.array(n, pa.int64()),
                    C.signed(np.array(set_a, np.uint64)),
                    C.signed(np.array(set_b, np.uint64)),
                    pa.ListArray.from_arrays(pa.array(ends), C.signed(flat)),
                ],
                ["doc_key", "n", "set_a", "set_b", "prefix"],
            )

    return run


def _prefix_length(size: int, percent: int) -> int:
    least = (percent * size + 99) // 100
    return size - least + min(SHARED, least)


def ordered_sets(width: int, percent: int, order: Order):
    """Arrow map: (doc_key, text) -> (doc_key, prefix, grams in the global order)."""

    def listed(sets: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), C.signed(np.concatenate(sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_key")
            raw, offs = C.text_parts(batch.column("text"))
            for a, b in C.row_chunks(offs):
                sets = [order(g) for g in shingle_sets(raw, offs[a : b + 1], width)]
                prefix = [g[: _prefix_length(len(g), percent)] for g in sets]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), listed(prefix), listed(sets)], ["doc_key", "prefix", "grams"])

    return run


class Trie:
    """A prefix tree of ordered sets, edges compressed; nodes in depth-first order.

    paths: what is stored of each set. sizes: n-grams of the whole set. reach: n-grams of the
    whole set from where its path begins (more than the path holds, if that is a part).
    """

    def __init__(self, paths: list[np.ndarray], sizes: list[int], reach: list[int]):
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        self.paths, self.sizes, self.reach = paths, sizes, reach
        # A node: edge [begin, end) of the path of set `rep`, sets that end in it, children.
        top: list = [0, 0, -1, [], []]
        open_nodes, before = [top], np.zeros(0, np.uint64)
        for i in order:
            own = paths[i]
            m = min(len(before), len(own))
            differ = np.flatnonzero(before[:m] != own[:m])
            shared = int(differ[0]) if len(differ) else m
            while open_nodes[-1][0] >= shared and len(open_nodes) > 1:
                open_nodes.pop()
            node = open_nodes[-1]
            if node[1] > shared:  # its edge parts here
                lower = [shared, node[1], node[2], node[3], node[4]]
                node[1], node[3], node[4] = shared, [], [lower]
            if len(own) > shared:
                leaf = [shared, len(own), i, [i], []]
                node[4].append(leaf)
                open_nodes.append(leaf)
            else:
                node[3].append(i)
            before = own
        self.nodes: list[tuple[int, int, int, list[int]]] = []
        self.up: list[int] = []
        todo = [(top, -1)]
        while todo:
            node, above = todo.pop()
            k = len(self.nodes)
            self.nodes.append((node[0], node[1], node[2], node[3]))
            self.up.append(above)
            todo += [(child, k) for child in reversed(node[4])]
        n = len(self.nodes)
        self.behind = list(range(1, n + 1))  # the first node that is not below
        self.least, self.most, self.far = [2**62] * n, [0] * n, [0] * n  # sizes, and reach, of the sets below
        for k in range(n - 1, -1, -1):
            for i in self.nodes[k][3]:
                self.least[k], self.most[k], self.far[k] = min(self.least[k], sizes[i]), max(self.most[k], sizes[i]), max(self.far[k], reach[i])
            u = self.up[k]
            if u >= 0:
                self.least[u], self.most[u], self.far[u] = min(self.least[u], self.least[k]), max(self.most[u], self.most[k]), max(self.far[u], self.far[k])
                self.behind[u] = max(self.behind[u], self.behind[k])

    def links(self, probe: np.ndarray, size: int, reach: int, percent: int) -> list[int]:
        """The sets that can have a similarity of percent/100 with the probe's set: with whole paths, those that have it."""
        low, high = -(-percent * size // 100), 100 * size // percent
        overlap = [0] * len(self.nodes)
        found: list[int] = []
        k = 0
        while k < len(self.nodes):
            begin, end, rep, own = self.nodes[k]
            if self.most[k] < low or self.least[k] > high:
                k = self.behind[k]
                continue
            need = -(-percent * (size + self.least[k]) // (100 + percent))
            count, at, left = overlap[self.up[k]] if k else 0, begin, True
            while left and at < end:
                part = self.paths[rep][at : min(at + 128, end)]
                spot = np.searchsorted(probe, part)
                spot[spot == len(probe)] = 0
                hit = probe[spot] == part
                count += int(np.count_nonzero(hit))
                at += len(part)
                behind = reach - int(spot[-1]) - int(hit[-1]) if part[-1] <= probe[-1] else reach - len(probe)
                left = count + min(self.far[k] - at, behind) >= need
            if not left and (at < end or not own):
                k = self.behind[k]
                continue
            overlap[k] = count
            for i in own:
                rest = max(reach - len(probe), self.reach[i] - len(self.paths[i]))
                if low <= self.sizes[i] <= high and (100 + percent) * (count + rest) >= percent * (size + self.sizes[i]):
                    found.append(i)
            k = k + 1 if left else self.behind[k]
        return found


def verified(percent: int):
    """Arrow map: (probe, probe_grams, members list<struct<m, grams>>) -> links (a, b), from a trie of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for r in range(batch.num_rows):
                probe = np.asarray(batch.column("probe_grams")[r].values, np.int64).view(np.uint64)
                members = batch.column("members")[r].values
                ids = members.field("m").to_numpy(zero_copy_only=False)
                inner = members.field("grams")
                sets = [np.asarray(inner[i].values, np.int64).view(np.uint64) for i in range(len(ids))]
                sizes = [len(x) for x in sets]
                hit = Trie(sets, sizes, sizes).links(probe, len(probe), len(probe), percent)
                a += [batch.column("probe")[r].as_py()] * len(hit)
                b += [int(ids[i]) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            C.trim()

    return run


def _prefixes_suffice(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those whose shared prefix n-grams, with all that stands behind the prefixes, suffice for a link.

    Behind the prefix that ends first in the global order, the two share at most what its set has left.
    """
    for k in ("probe", "m"):
        pairs = pairs.join(sets.select(F.col("doc_key").alias(k), F.col("prefix").alias(f"{k}_prefix")), k)
    left = [_least(f"{k}_n", percent) - _shared_least(f"{k}_n", percent) for k in ("probe", "m")]
    need = F.ceil(percent * (F.col("probe_n") + F.col("m_n")) / F.lit(100 + percent))
    common = F.size(F.array_intersect("probe_prefix", "m_prefix"))
    return pairs.where(common + F.greatest(*left) >= need).select("probe", "m", "m_n")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (probe, probe_n, m, m_n) that link. One task gets a probe and a block of its partners."""
    pairs = C.written(_prefixes_suffice(pairs, sets, percent), "close")
    blocks = pairs.groupBy("probe").agg(F.ceil(F.sum("m_n") / F.lit(BLOCK)).alias("blocks"))
    # Written, so that the planner knows how small it is: few pairs are sent to the sets, not the sets to them.
    dealt = C.written(pairs.join(blocks, "probe").select("probe", "m", F.pmod(F.xxhash64("m"), F.col("blocks")).alias("block")), "dealt")
    members = (
        dealt.join(sets.select(F.col("doc_key").alias("m"), "grams"), "m")
        .groupBy("probe", "block")
        .agg(F.collect_list(F.struct("m", "grams")).alias("members"))
    )
    probes = sets.select(F.col("doc_key").alias("probe"), F.col("grams").alias("probe_grams")).join(dealt.select("probe"), "probe", "left_semi")
    return members.join(probes, "probe").select("probe", "probe_grams", "members").mapInArrow(verified(percent), "a long, b long")


def _least(n: str, percent: int):
    """The overlap that a set of n needs for any link."""
    return F.ceil(F.col(n) * percent / 100)


def _shared_least(n: str, percent: int):
    return F.least(F.lit(SHARED), _least(n, percent))


def _reaches(percent: int):
    """Whether the n-grams from a shared one on suffice for a link, had the sets nothing in common before it.

    Holds for the first n-gram that a linked pair shares.
    """
    need = F.ceil(percent * (F.col("probe_n") + F.col("m_n")) / F.lit(100 + percent))
    return F.least(F.col("probe_n") - F.col("probe_at"), F.col("m_n") - F.col("m_at")) >= need


def _cores(rows: DataFrame, sizes: DataFrame, percent: int, turns: int = 2) -> DataFrame:
    """rows (gram, cls, at, n) of n-grams with several classes and classes with enough such n-grams."""
    for turn in range(turns):
        shared = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
        rows = C.written(rows.join(shared, "gram"), "shared", release=True)
        full = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).join(sizes, "cls").where(F.col("c") >= _shared_least("n", percent)).select("cls")
        rows = rows.join(full, "cls", "left_semi")
    return C.written(rows.join(sizes, "cls").select("gram", "cls", "at", "n"), "cores")


def _classes(heads: DataFrame) -> DataFrame:
    """(doc_key, n, cls): cls is the least key with an equal set; a document without n-grams is its own."""
    alike = ["n", "set_a", "set_b"]
    classes = C.written(heads.where("n > 0").groupBy(*alike).agg(F.min("doc_key").alias("cls"), F.count(F.lit(1)).alias("c")), "alike")
    large = max(HOT, (classes.agg(F.sum("c")).first()[0] or 0) // HOT_SHARE)
    hot = classes.where(F.col("c") > large).select(*alike, F.col("cls").alias("hot"))  # HOT_SHARE rows at most
    seen = heads.select("doc_key", *alike).join(F.broadcast(hot), alike, "left")
    of_hot = seen.where("hot is not null").select("doc_key", "n", F.col("hot").alias("cls"))
    rest = seen.where("hot is null").drop("hot").join(classes.where(F.col("c") <= large).drop("c"), alike, "left")
    return C.written(of_hot.unionByName(rest.select("doc_key", "n", F.coalesce("cls", "doc_key").alias("cls"))), "classes")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``. Documents link when 100 x intersection
    >= percent x union of their distinct `width`-word shingles; a text of fewer words is one
    shingle; without words or text a document is alone. component_id: the smallest doc_id
    reachable. A null doc_id counts as smaller than any id and is returned as null; rows without
    an id are documents told apart by their texts; repeated rows are all returned and share
    their class; other columns are ignored.
    """
    comps = _components(C.doc_frame(docs), width, percent)
    return comps.select(C.un_ided("doc_key").alias("doc_id"), "n_shingles", C.un_ided("component").alias("component_id"))


def _components(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_key, n_shingles, component) of every row."""
    mark = C.made_so_far()
    order = Order(frequent_grams(texts, width))
    heads = C.written(texts.mapInArrow(prefixes(width, percent, order), "doc_key long, n long, set_a long, set_b long, prefix array<long>"), "prefixes")
    of = _classes(heads)
    heads = heads.join(of.where("cls = doc_key and n > 0").select("doc_key").distinct(), "doc_key", "left_semi")
    repeated = of.groupBy("doc_key").count().where("count > 1").limit(1).count()  # repeated rows are rare and stand for one
    heads = heads.dropDuplicates(["doc_key"]) if repeated else heads
    sizes = C.written(heads.select(F.col("doc_key").alias("cls"), "n").distinct(), "sizes")
    rows = _cores(heads.select(F.posexplode("prefix").alias("at", "gram"), F.col("doc_key").alias("cls")), sizes, percent)
    needed = rows.select(F.col("cls").alias("doc_key")).distinct()
    sets = texts.join(needed, "doc_key", "left_semi")
    sets = sets.dropDuplicates(["doc_key"]) if repeated else sets
    sets = C.written(sets.mapInArrow(ordered_sets(width, percent, order), "doc_key long, prefix array<long>, grams array<long>"), "sets", release=True)

    # Only these can be the first n-gram that a linked pair shares.
    rows = rows.where(F.col("n") - F.col("at") >= _least("n", percent)).withColumn("comp", F.col("cls"))
    tried = links = labels = None
    for turn in range(HUB_ROUNDS + 1):
        spread = rows.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("gram")
        rows = C.written(rows.join(spread, "gram").select("gram", "cls", "at", "n", "comp"), "mixed")
        if not rows.limit(1).count():
            break
        probe, m = (rows.select("gram", *[F.col(x).alias(k + y) for x, y in (("cls", ""), ("at", "_at"), ("n", "_n"), ("comp", "_comp"))]) for k in ("probe", "m"))
        apart = (F.col("probe_comp") != F.col("m_comp")) & _reaches(percent)
        if turn < HUB_ROUNDS:  # one hub a gram, drawn anew each turn, meets those of other components
            drawn = F.xxhash64("probe", "gram", F.lit(turn)) if turn else F.col("probe")
            probe = probe.withColumn("draw", drawn).groupBy("gram").agg(*[F.min_by(c, "draw").alias(c) for c in probe.columns[1:]])
            pairs = probe.join(m, (probe["gram"] == m["gram"]) & apart).select(*PAIR).distinct()
        else:  # those of one scale of sizes, or of it and the next, meet
            scale = lambda n, off=0.0: F.floor(F.log(F.col(n)) / F.log(F.lit(100 / percent)) + off)
            probe = probe.withColumn("scale", F.explode(F.sequence(scale("probe_n", -1e-9), scale("probe_n", 1 + 1e-9))))
            order = (F.col("probe_n") < F.col("m_n")) | ((F.col("probe_n") == F.col("m_n")) & (F.col("probe") < F.col("m")))
            pairs = probe.join(m.withColumn("scale", scale("m_n")), ["gram", "scale"]).where(apart & order).select(*PAIR).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["probe", "m"], "left_anti")
        pairs = C.written(pairs, "pairs")
        new = C.written(verify(pairs, sets, percent), "verified", release=True)
        both = pairs.select("probe", "m").union(pairs.select(F.col("m").alias("probe"), F.col("probe").alias("m")))
        tried = both if tried is None else tried.union(both)
        links = new if links is None else links.union(new)
        labels = components(links).select(F.col("node").alias("cls"), "component")
        rows = rows.drop("comp").join(labels, "cls", "left").select("gram", "cls", "at", "n", F.coalesce("component", "cls").alias("comp"))
    C.drop_since(mark, [of] if labels is None else [of, labels])
    comps = of.withColumn("component", F.lit(None).cast("long")) if labels is None else of.join(labels, "cls", "left")
    return comps.select("doc_key", F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("component"))


def near_copies_removed(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies: of each group only the document with the smallest doc_id stays.

    Of repeated rows of one document one stays, whichever; of rows without an id, which are
    documents told apart by their texts and smaller than any id, that with the least hash of
    the text. Documents without words stay.
    """
    comps = C.written(_components(C.doc_frame(docs), width, percent), "comps")
    groups = comps.where("doc_key <> component").select(F.col("doc_key").alias("_key")).distinct()
    key = C.ided("doc_id", "text")
    left = docs.join(groups, key == groups["_key"], "left_anti")
    again = comps.where("doc_key = component").groupBy("doc_key").count().where("count > 1").select(F.col("doc_key").alias("_key"))
    if not again.limit(1).count():
        return left
    row = F.struct(*[F.col(C.quoted(c)) for c in docs.columns])
    once = left.join(again, key == again["_key"], "left_semi").groupBy(key.alias("_key")).agg(F.first(row).alias("row"))
    once = once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return left.join(again, key == again["_key"], "left_anti").unionByName(once)
