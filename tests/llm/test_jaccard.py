import random

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import jaccard, textops


def words(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    """Texts with copies, near copies, shared passages and very short texts."""
    r = random.Random(seed)
    fresh = lambda k: [r.choice("aé") + str(r.randrange(10**6)) for _ in range(k)]
    passage, base = fresh(30), [fresh(r.randrange(1, 80)) for _ in range(n // 8)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.7 else fresh(r.randrange(0, 60))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            if w:
                w[r.randrange(len(w))] = fresh(1)[0]
        if r.random() < 0.3:
            w = w + passage
        sep = r.choice([" ", "\n", " \t "])
        rows.append((i, sep.join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in w)))
    return rows


def test_shingle_sets_equal_the_plain_definition(monkeypatch):
    texts = [t for _, t in corpus(1, 60)] + [None, "", " \n\t", "a", "a b c d e", "É x y z\x1fq 1 2 3", "w" * 5000 + " a b c d e f", "a " * 4000]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(textops, "CHUNK", chunk)
        got = [len(s) for s in textops.shingle_sets(pa.array(texts))]
        assert got == [len(shingles(t)) for t in texts]
    a, b = textops.shingle_sets(pa.array(["One two three four five six", "ONE  two\nthree four five six"]))
    assert (a == b).all()


def test_prefix_tree_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(15):
        base = [r.integers(0, 2**63, r.integers(1, 40)).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(50):
            s = base[r.integers(0, 4)].copy()
            for _ in range(r.integers(0, 4)):
                s[r.integers(0, len(s))] = r.integers(0, 2**63)
            sets.append(np.unique(s))

        def classes(links):
            root = list(range(50))
            for u, v in links:
                a, b = root[u], root[v]
                root = [b if x == a else x for x in root]
            return [[root[i] == root[j] for j in range(50)] for i in range(50)]

        overlap = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        want = [(i, j) for i in range(50) for j in range(i) if 5 * overlap(i, j) >= 4 * (len(sets[i]) + len(sets[j]) - overlap(i, j))]
        assert classes(jaccard.joined(np.arange(50), sets)) == classes(want)


@pytest.mark.parametrize("block,grid", [(512, 64), (4, 64), (4, 1)])
def test_components_against_brute_force(spark, monkeypatch, block, grid):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GRID", grid)
    rows = corpus(block + grid, 120)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, digest string, cid long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, ""), (4, "A b c d e f  g"), (5, "x"), (6, "x"), (7, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 0, 2), (3, 0, 3), (4, 3, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_without_is_an_anti_join(spark):
    df = spark.createDataFrame([(i, "t") for i in range(300)] + [(None, "u")], "doc_id long, text string")
    ids = spark.range(0, 300, 3).withColumnRenamed("id", "doc_id")
    assert sorted(r["doc_id"] or -1 for r in jaccard.without(df, ids).collect()) == [-1] + [i for i in range(300) if i % 3]
