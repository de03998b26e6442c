import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from sessionloom.llm import common as C
from sessionloom.llm.recompression import dedup_substrings, representatives, window_names

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    docs = sorted((-1 if i is None else i, i, WORD.findall(t or "")) for i, t in rows)
    seen, out = set(), {}
    for _, doc_id, words in docs:
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}é" for i in range(60)]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(120):
        words = [r.choice(vocab[: r.choice([1, 2, 3, 60])]) for _ in range(r.choice([0, 5, 19, 20, 21, 60, 200]))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            cut = r.randrange(40)
            words[at:at] = passage[cut : cut + r.choice([19, 20, 25, 70])]
        if i % 10 == 7:
            words += words
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(500, None), (501, ""), (502, rows[9][1]), (503, rows[9][1] + " tail"), (None, " ".join(passage)), (504, "a " * 3000), (505, "a b " * 30)]
    return rows


@pytest.mark.parametrize("window,rounds", [(20, 2), (7, 1), (20, 3)])
def test_against_brute_force(spark, window, rounds):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, symbols string, doc_key long").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(docs, window, rounds).collect()}
    assert got == brute(rows, window)


def test_text_form_keeps_columns(spark):
    rows = [(1, " ".join(map(str, range(30))), "en"), (2, "x " + " ".join(map(str, range(25))), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `la.ng` string")
    out = {r.doc_id: r for r in dedup_substrings(docs, with_text=True).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "x" and out[2]["la.ng"] == "de"


def test_texts_stay_as_they_are(spark):
    long = "\n ".join(f"w{i}" for i in range(40))
    rows = [(1, " one\n\ntwo  "), (2, None), (3, ""), (4, long), (5, "a\tb " + long + "\n c\n\nd "), (6, " " + long + "  ")]
    out = {r.doc_id: r.text for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert [out[i] for i in range(1, 7)] == [rows[0][1], None, "", long, "a\tb c\n\nd ", ""]


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t[:n], t[:n].translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_of_machine_words_confuse(spark, n):
    one, two = thue_morse(n)
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_candidates_are_verified(monkeypatch):
    """With a hash that takes all words for one, every window is a candidate and only equal ones share a name."""
    monkeypatch.setattr(C.Words, "hashes", lambda self, seed, lower=False: np.zeros(len(self.starts), np.uint64))
    texts = [" ".join(f"w{(i // 2 * 7 + k) % 50}" for k in range(30)) for i in range(8)]
    batch = pa.record_batch({"doc_key": pa.array(range(8), pa.int64()), "text": texts})
    symbols = {k: set() for k in range(8)}
    for out in representatives(20, 2)(iter([batch])):
        for s, k in zip(out["symbol"].to_pylist(), out["doc_key"].to_pylist(), strict=True):
            symbols[k].add(s)
    batch = batch.append_column("symbols", pa.array([list(symbols[k]) for k in range(8)], pa.list_(pa.int64())))
    named = {}
    for out in window_names(20, 2)(iter([batch])):
        for r in out.to_pylist():
            named.setdefault((r["name_a"], r["name_b"]), set()).add(" ".join(texts[r["doc_key"]].split()[r["start"] :][:20]))
    assert len(named) > 20 and all(len(x) == 1 for x in named.values())
    assert len(named) == len({" ".join(t.split()[a : a + 20]) for t in texts for a in range(11)})


def test_rows_without_an_id_are_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{passage} {x}") for x in ("one", "two", "three")] + [(None, f"{passage} one"), (7, passage)]
    got = sorted(r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([0, 0, 30, 30, 30], [0, 30, 30, 30, 30])  # the repeated row goes with its like


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
