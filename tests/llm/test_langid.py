import zlib

import numpy as np
from sessionloom.llm import langid as L


def brute(word, table, langs):
    best = np.zeros((len(word) + 1, langs))
    best[0] = 1
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in table:
                best[j] += best[i] * table[word[i:j]]
        if word[j - 1] not in table:
            best[j] += best[j - 1] * L.RARE
    return np.log(best[-1])


def test_forward_sums_all_segmentations(monkeypatch):
    vocab = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "é"]
    r = np.random.default_rng(0)
    prob = np.vstack((r.random((len(vocab), 3)), np.zeros((1, 3))))
    table = {p: prob[i] for i, p in enumerate(vocab)}
    words = ["abc", "a", "", "xab", "cabcabcab", "é?é", "abc" * 15]
    pieces = L.Pieces(vocab)
    codes, lens = L.word_matrix(words)
    want = [brute("▁" + w, table, 3) for w in words]
    assert np.allclose(L.word_scores(pieces, codes, lens, prob), want)
    monkeypatch.setattr(L, "BLOCK", 4)  # states go from block to block
    assert np.allclose(L.word_scores(pieces, codes, lens, prob), want)


def test_expected_counts_by_enumeration(monkeypatch):
    vocab = ["▁", "a", "b", "ab", "▁a", "ba"]
    prob = np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2], [0]])
    word = "▁abab"

    def cuts(s):
        if not s:
            yield []
        for i, p in enumerate(vocab):
            if s.startswith(p):
                for rest in cuts(s[len(p) :]):
                    yield [i, *rest]

    want, total = np.zeros(7), 0.0
    for c in cuts(word):
        p = np.prod(prob[c, 0])
        total += p
        np.add.at(want, c, p)
    codes, lens = L.word_matrix(["abab", "b"])
    weight = np.array([[2.0, 1.0], [0.0, 0.0]])
    for block in (512, 3, 1):
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.expected_counts(L.Pieces(vocab), codes, lens, prob, weight)
        assert np.allclose(got, np.outer(want / total, [2, 1]))


def counted(word, size):
    """Posterior counts of the pieces of a word under the flat start."""
    n = len(word)
    p = lambda i, j: (1 / len(size) if word[i:j] in size else 0) + (L.RARE if j == i + 1 and word[i:j] not in size else 0)
    up, down = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        up[j] = sum(up[i] * p(i, j) for i in range(max(0, j - 20), j))
    for i in range(n - 1, -1, -1):
        down[i] = sum(p(i, j) * down[j] for j in range(i + 1, min(n, i + 20) + 1))
    out = {}
    for i in range(n):
        for j in range(i + 1, min(n, i + 20) + 1):
            if word[i:j] in size:
                out[word[i:j]] = out.get(word[i:j], 0) + up[i] * p(i, j) * down[j] / up[n]
    return out


def test_predictions_against_brute_force(spark):
    pieces = L.read_vocabulary(L.VOCABULARY)
    known = set(pieces)
    words = {"en": "the house river with them water", "de": "der hund katze nicht haus wasser", "fr": "la maison avec eux chat"}
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(words[k].split(), 6)) + (" " + "".join(r.choice(list("abdeé"), 60)) if i % 5 == 0 else ""), k) for i, k in enumerate(list(words) * 8)]
    rows += [(50 + i, " ".join(r.choice(sum((w.split() for w in words.values()), []), 2)), None) for i in range(12)]
    counts = {k: dict.fromkeys(pieces, 0.1) for k in words}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in t.split():
                for x, n in counted("▁" + w, known).items():
                    counts[k][x] += n
    sums = {k: sum(c.values()) for k, c in counts.items()}
    got = {x.doc_id: x for x in L.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        logs = []
        for k in sorted(words):
            total = 0.0
            for w in t.split():
                w = "▁" + w
                up = [1.0]
                for j in range(1, len(w) + 1):
                    up.append(sum(up[a] * (counts[k].get(w[a:j], 0) / sums[k] + (L.RARE if j == a + 1 and w[a:j] not in known else 0)) for a in range(max(0, j - 20), j)))
                total += np.log(up[-1])
            logs.append(total)
        odds = np.exp(np.array(logs) - max(logs))
        assert got[i].lang_pred == sorted(words)[int(np.argmax(odds))]
        assert abs(got[i].score - odds.max() / odds.sum()) < 1e-6


def test_long_words_are_scored_whole(spark):
    rows = [(k, "ab" * 30, "x") for k in range(8)] + [(k, "cd" * 30, "y") for k in range(8, 16)]
    rows += [(20, "q" * 47 + "ab" * 9, None), (21, "ab" * 3000, None), (22, "cd" * 3000, None), (23, " ".join(["abab"] * 50000), None)]
    got = {x.doc_id: x.lang_pred for x in L.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in (20, 21, 22, 23)] == ["x", "x", "y", "x"]


def test_ties_and_many_languages(spark):
    rows = [(i, "one two three", f"l{i % 40:02}") for i in range(160)]
    got = L.predict_languages(spark.createDataFrame([*rows, (200, "four", None)], "doc_id long, text string, lang string")).collect()
    learned = {f"l{i % 40:02}": 0 for i in range(160) if zlib.crc32(str(i).encode()) % 4 != 2}
    for i, _, k in rows:
        learned[k] = learned.get(k, 0) + (zlib.crc32(str(i).encode()) % 4 != 2)
    most = max(learned.values())
    assert {x.lang_pred for x in got if x.doc_id != 200} == {min(k for k, n in learned.items() if n == most)}


def test_predicts(spark):
    en, de = "the house and the river were there with them", "der hund und die katze sind nicht auf dem haus"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "12 !!", "de"), (102, "", None), (None, "the river and the house", None), (103, "x" * 5000, None), (1, en, "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(2)
    out = L.predict_languages(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id is None:
            assert r.lang_pred == "en"
        elif r.doc_id < 40:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
        elif r.doc_id < 103:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.predict_languages(docs).first().lang_pred == "und"
    assert L.predict_languages(docs.limit(0)).count() == 0
