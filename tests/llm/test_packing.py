import random
from collections import defaultdict

from sessionloom.llm import packing as P


def least(lengths, n):
    return next(x for x in lengths if x >= n)


def promised(size, rest, lengths):
    """The length whose greedy filling from the pieces in `rest` (with the piece itself) costs least a token."""
    rest = sorted(rest, reverse=True)
    rest.remove(size)
    prices = []
    for length in lengths:
        if length >= size:
            total = size
            for s in rest:
                if total + s <= length:
                    total += s
            prices.append((P.cost(least(lengths, total)) / total, length))
    return min(prices)[1]


def slow(sizes, lengths, opening=None):
    """Best-fit by looking at every open bin."""
    bins = []
    for k, s in enumerate(sizes):
        fit = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fit:
            min(fit, key=lambda b: b[0] - sum(b[1]))[1].append(s)
        else:
            bins.append([max(opening, least(lengths, s)) if opening else promised(s, sizes[k:], lengths), [s]])
    return sum(P.cost(least(lengths, sum(b[1]))) for b in bins), len(bins)


def test_best_fit_against_slow():
    r = random.Random(1)
    for k in range(120):
        lengths = (8, 16, 40) if k % 2 else P.LENGTHS
        sizes = sorted((r.randrange(1, r.choice([lengths[0], lengths[-1] + 1])) for _ in range(r.randrange(1, 60))), reverse=True)
        for opening in (None, *lengths):
            bins, _, full = P.best_fit(sizes, lengths, opening)
            assert (sum(map(P.cost, full)), len(full)) == slow(sizes, lengths, opening)
        best = sum(map(P.cost, P.pack_pieces(sizes, lengths)[2]))
        uniform = min(slow(sizes, lengths, o)[0] for o in lengths)
        assert best == min(uniform, slow(sizes, lengths)[0])


def test_bins_that_choose_their_length_beat_any_single_one():
    sizes = [1365] * 30 + [1024] * 40
    best = sum(map(P.cost, P.pack_pieces(sizes, P.LENGTHS)[2]))
    assert best == 10 * P.cost(4096) + 20 * P.cost(2048) < min(slow(sizes, P.LENGTHS, o)[0] for o in P.LENGTHS)


def test_promising_length_is_chosen_for_each_bin():
    lengths = (8, 16, 40)
    count = [0] * 41
    for s in (7, 7, 2):
        count[s] += 1
    assert P.promising(7, count, lengths) == promised(7, [7, 7, 2], lengths) == 16


def test_null_ids_and_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "w " * 10)] * 200 + [(1, "w " * 10)] * 200, "doc_id long, text string").repartition(2)
    out = P.pack(docs, lengths=(16, 32, 64), bucket=50).collect()
    assert len(out) == 400 and sum(x.length for x in out) == 4000
    assert len({x.bin_id >> 32 for x in out}) == 8
    assert all(x.bin_offset + x.length <= x.capacity for x in out)


def test_every_piece_has_its_place(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 3, 17, 64, 65, 200])) for i in range(200)] + [(300, None), (301, ""), (302, " \n"), (None, "a b c"), (7, "w w"), (303, "x " * 1000)]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, length int").repartition(3)
    out = P.pack(docs, lengths=(16, 32, 64), bucket=50).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len((t or "").split())
    got, bins = defaultdict(int), defaultdict(list)
    for x in out:
        got[x.doc_id] += x.length
        if x.length:
            bins[x.bin_id].append(x)
        else:
            assert x.bin_id is None and x.doc_id in (300, 301, 302)
    assert got == want
    for own in bins.values():
        own.sort(key=lambda x: x.bin_offset)
        assert [x.bin_offset for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        total = sum(x.length for x in own)
        assert {x.capacity for x in own} == {next(n for n in (16, 32, 64) if n >= total)}
    long = sorted((x.start, x.length, x.piece) for x in out if x.doc_id == 303)
    assert long == [(64 * k, min(64, 1000 - 64 * k), k) for k in range(16)]


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
