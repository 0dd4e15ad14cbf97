"""Benchmark decontamination: rare-word retrieval, latent and weight gates, subsequence and answer checks.

1. Every document is cut into overlapping passages.  A passage is a vector of hashed words
   weighted by tf-idf; document frequencies count all documents.
2. The latent space is the leading right singular space of the passage matrix A, by a
   distributed randomised SVD: one pass sums A'(A W) for a fixed random W on the executors, in
   slices of the hashed words; the single-view (Nystrom) formula turns the sum into singular
   values and directions.
3. A passage of an item is any run of ``passage`` words of a document (about 1.5 to 2 times the
   item's words), at every offset.  One that holds T of the item's n words holds at least c of
   its n - T + c rarest: an inverted index of those finds every such passage, without a grid.
4. A passage counts if the words of the item that it holds, each taken once, carry half of the
   weight (-log frequency) of all its words, or if its cosine with the item in the latent space
   is at least ``COSINE``.  So what else stands in the passage can't outweigh a copy.
5. It must hold at least ``LCS`` of the item's words in order (longest common subsequence) and
   ``ANSWER`` of its answer: the words of column ``answer`` if the benchmark has one, else the
   last quarter of the item.  A given answer may stand up to its own length before or after
   the passage.

Null or empty texts and items without words match nothing.  Items are held by every task in
blocks of ``ITEM_BLOCK``, so a large benchmark takes several scans instead of more memory.  Repeated
rows are each reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .textops import LOWER, buffers, mix, slices, word_hashes

BITS = 11
FEATURES = 1 << BITS
RANK, EXTRA = 128, 16
SVD_PASSAGE = 64
COSINE = 0.35
WEIGHT = 0.5
LCS, ANSWER = 0.6, 0.5
FINE_BITS = 16  # buckets of word counts
ITEM_BLOCK = 4096
_U = np.uint64


_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words in lower case (Latin-1 letters too), with ASCII punctuation as white space."""
    data, offsets = buffers(texts)
    data = _PLAIN[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    data[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]] += 32
    return word_hashes(data, offsets)


def features(words: np.ndarray) -> np.ndarray:
    return (mix(words ^ _U(0x5EED)) >> _U(64 - BITS)).astype(np.int64)


def fine(words: np.ndarray) -> np.ndarray:
    return (mix(words ^ _U(0xF17E)) >> _U(64 - FINE_BITS)).astype(np.int64)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each hashed word; occurrences in finer buckets."""
    total, counts, docs = np.zeros(FEATURES, np.int64), np.zeros(1 << FINE_BITS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            words, at = plain_words(part.column("text"))
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            seen = np.zeros((len(at) - 1) * FEATURES, bool) if len(at) <= 2048 else None
            if seen is not None:
                seen[owner * FEATURES + features(words)] = True
                total += seen.reshape(-1, FEATURES).sum(axis=0)
            else:
                total += np.bincount(np.unique(owner * FEATURES + features(words)) % FEATURES, minlength=FEATURES)
            counts += np.bincount(fine(words), minlength=len(counts))
            docs += len(at) - 1
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.concatenate([total, counts, [docs]]).tobytes()], pa.binary())], ["slice", "sums"])


def _projection() -> np.ndarray:
    return np.random.default_rng(17).normal(size=(FEATURES, RANK + EXTRA)).astype(np.float32)


def _svd_sums(idf: np.ndarray):
    """Sums of A'(A W) over passages, in slices of the hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _projection() * idf[:, None]
        total, some = np.zeros((FEATURES, w.shape[1])), False
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, at = plain_words(part.column("text"))
                some |= len(at) > 1
                counts = np.diff(at)
                passages = -(-counts // SVD_PASSAGE)
                base = np.cumsum(passages) - passages
                owner = np.repeat(base, counts) + (np.arange(len(words)) - np.repeat(at[:-1], counts)) // SVD_PASSAGE
                n = int(passages.sum())
                f = features(words)
                for a in range(0, n, 1024):  # dense tf-idf rows of 1024 passages at a time
                    lo, hi = np.searchsorted(owner, [a, a + 1024])
                    rows = min(1024, n - a)
                    x = np.bincount((owner[lo:hi] - a) * FEATURES + f[lo:hi], minlength=rows * FEATURES).reshape(rows, FEATURES).astype(np.float32)
                    norm = np.sqrt(((x * idf) ** 2).sum(axis=1, keepdims=True))
                    y = (x @ w) / np.maximum(norm, 1e-6) ** 2
                    total += (x.T @ y) * idf[:, None]
        if some:
            for i, s in enumerate(np.split(total, 8)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([s.tobytes()], pa.binary())], ["slice", "sums"])

    return run


def _add(kind):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, kind) for b in pdf["sums"])
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "sums": [total.tobytes()]})

    return run


def _summed(texts: DataFrame, step, kind) -> list[np.ndarray]:
    """Sums over all partitions, added on the executors; their size is fixed."""
    rows = texts.mapInArrow(step, "slice long, sums binary").groupBy("slice").applyInPandas(_add(kind), "slice long, sums binary").collect()
    return [np.frombuffer(r["sums"], kind) for r in sorted(rows, key=lambda r: r["slice"])]


def latent_space(texts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """FEATURES x RANK: what a word adds to a passage's latent vector (idf included), and the corpus's word counts in fine buckets; None for an empty corpus."""
    ship(texts.sparkSession)
    got = _summed(texts, _frequency, np.int64)
    if not got:
        return None
    df, counts, docs = got[0][:FEATURES], got[0][FEATURES:-1], got[0][-1]
    idf = np.log((docs + 1) / (df + 0.5)).clip(0.01).astype(np.float32)
    z = np.concatenate([s.reshape(-1, RANK + EXTRA) for s in _summed(texts, _svd_sums(idf), np.float64)])
    # Single-view approximation of G = A'A from Z = G W: G ~ Z (W'Z)^-1 Z'.
    w = _projection().astype(np.float64)
    nu = 1e-9 * np.linalg.norm(z) + 1e-12
    z = z + nu * w
    c = w.T @ z
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    half = z @ (vectors / np.sqrt(np.maximum(values, 1e-12 * values.max())))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    # Whitened: every latent direction counts alike, so common words don't drown the rest.
    # Directions that a small corpus doesn't have stay out.
    weight = np.where(s[:RANK] > 1e-3 * s[0], np.sqrt(docs) / np.maximum(s[:RANK], 1e-12), 0)
    return (u[:, :RANK] * weight * idf[:, None]).astype(np.float32), counts


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Bit vector whose zeros mark a longest common subsequence; masks: positions of each word of the item, as bits."""
    v, full = (1 << n) - 1, (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, rows: pd.DataFrame, space: np.ndarray, counts: np.ndarray):
        words, at = plain_words(pa.array(rows["text"], pa.string()))
        self.ids = rows["item_id"].to_numpy()
        self.words = [words[a:b] for a, b in zip(at, at[1:])]
        self.size = np.diff(at)
        sums = np.concatenate([np.zeros((1, space.shape[1]), np.float32), np.cumsum(space[features(words)], axis=0, dtype=np.float64)])
        v = sums[at[1:]] - sums[at[:-1]]
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.masks, self.answer, self.reach = [], [], np.zeros(len(rows), np.int64)
        given = rows["answer"] if "answer" in rows else pd.Series([None] * len(rows))
        answers, at2 = plain_words(pa.array(given.where(given.notna(), None), pa.string()))
        for k, w in enumerate(self.words):
            m: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                m[x] = m.get(x, 0) | 1 << i
            self.masks.append(m)
            own = answers[at2[k] : at2[k + 1]]
            self.reach[k] = len(own)
            self.answer.append(own if len(own) else w[len(w) - max(1, len(w) // 4) :])
        # Passage lengths: at least one and a half times the item's words, in steps of a quarter.
        self.passage = np.where(self.size > 0, 12 * 1.25 ** np.ceil(np.log(np.maximum(1.5 * self.size, 12) / 12) / np.log(1.25)), 0).astype(np.int64)

        # The index: each item's rarest words, and how many of them a passage must hold.
        self.least = np.ceil(LCS * self.size - 1e-6).astype(np.int64)
        self.need = np.maximum(1, self.size // 5)
        self.weight, self.total, entries = [], [], []
        for k, w in enumerate(self.words):
            own, times = np.unique(w, return_counts=True)
            seen = counts[fine(own)]
            weight = np.log((counts.sum() + 1.0) / (seen + 0.5))
            self.weight.append(dict(zip(own.tolist(), weight.tolist())))
            self.total.append(float(weight.sum()))
            order = np.lexsort((own, seen))
            end = int(np.searchsorted(np.cumsum(times[order]), self.size[k] - self.least[k] + self.need[k])) + 1
            entries += [(int(own[i]), k, int(times[i])) for i in order[:end]]
        entries.sort()
        listed = np.array([e[0] for e in entries], np.uint64)
        self.vocabulary, first = np.unique(listed, return_index=True)
        self.first = np.append(first, len(entries))
        self.entry_item = np.array([e[1] for e in entries], np.int64)
        self.entry_times = np.array([e[2] for e in entries], np.int64)

    def places(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, from, to): ranges of words that hold every passage which can hold ``least`` words of the item."""
        if not len(self.vocabulary) or not len(words):
            return
        slot = np.searchsorted(self.vocabulary, words)
        slot[slot == len(self.vocabulary)] = 0
        where = np.flatnonzero(self.vocabulary[slot] == words)
        slot = slot[where]
        n = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where, item = np.repeat(where, n), self.entry_item[entry]
        # Documents lie further apart than two passages, and items than all documents.
        gap = 2 * int(self.passage.max())
        doc = np.searchsorted(at, where, "right") - 1
        key = item * (len(words) + gap * (len(at) + 1)) + doc * gap + where
        order = np.argsort(key, kind="stable")
        key, item, doc, where, times = key[order], item[order], doc[order], where[order], self.entry_times[entry[order]]
        sums = np.append(0, np.cumsum(times))
        held = sums[np.searchsorted(key, key + self.passage[item])] - sums[:-1]
        seed = np.flatnonzero(held >= self.need[item])
        key, item, doc, where = key[seed], item[seed], doc[seed], where[seed]
        # A passage whose first listed word is a seed starts at most its length before and ends at most its length after.
        cut = np.flatnonzero(np.append(True, np.diff(key) > 2 * self.passage[item[1:]]) if len(key) else [])
        for a, b in zip(cut, np.append(cut[1:], len(key))):
            d, k = int(doc[a]), int(item[a])
            p = int(self.passage[k] + self.reach[k])
            yield d, k, max(int(at[d]), int(where[a]) - p), min(int(at[d + 1]), int(where[b - 1]) + p)

    def check(self, k: int, words: np.ndarray, vectors: np.ndarray) -> float:
        """The greatest share of item k's words that a passage of these words holds in order; 0 if none is accepted.

        vectors: what each hashed word adds to a latent vector.
        """
        n, p, least, masks, weight = int(self.size[k]), int(self.passage[k]), int(self.least[k]), self.masks[k], self.weight[k]
        hit = np.flatnonzero(np.isin(words, self.words[k]))
        if len(hit) < least or sum(masks[w].bit_count() for w in set(words[hit].tolist())) < least:
            return 0.0  # too few of its words in any order
        # Every offset; passages that hold the same words of the item are tried once.
        start = np.arange(len(words))
        lo, hi = np.searchsorted(hit, start), np.searchsorted(hit, start + p)
        start = start[hi - lo >= least]
        pairs, group = np.unique(np.stack([lo, hi], axis=1)[start], axis=0, return_inverse=True)
        listed, best = words[hit].tolist(), 0.0
        for g, (a, b) in enumerate(pairs.tolist()):
            held = set(listed[a:b])
            if sum(masks[w].bit_count() for w in held) <= best * n or sum(masks[w].bit_count() for w in held) < least:
                continue
            share = (n - lcs(masks, n, listed[a:b]).bit_count()) / n
            if share < LCS or share <= best:
                continue
            own = start[group == g]
            near = own if sum(weight[w] for w in held) >= WEIGHT * self.total[k] else own[self._cosine(k, words, own, vectors) >= COSINE]
            if any(self._answered(k, words, s) for s in near.tolist()):
                best = share
                if best == 1:
                    break
        return best

    def _cosine(self, k: int, words: np.ndarray, start: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        a, b = int(start[0]), min(len(words), int(start[-1]) + int(self.passage[k]))
        sums = np.zeros((b - a + 1, vectors.shape[1]))
        np.cumsum(vectors[features(words[a:b])], axis=0, out=sums[1:])
        v = sums[np.minimum(start + self.passage[k], b) - a] - sums[start - a]
        return (v @ self.vectors[k]) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)

    def _answered(self, k: int, words: np.ndarray, start: int) -> bool:
        reach = int(self.reach[k])
        return np.isin(self.answer[k], words[max(0, start - reach) : start + self.passage[k] + reach]).mean() >= ANSWER


def _search(items: Items, space: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                words, at = plain_words(part.column("text"))
                best: dict[tuple[int, int], float] = {}
                for d, k, a, b in items.places(words, at):
                    if best.get((d, k), 0) < 1:
                        best[d, k] = max(best.get((d, k), 0.0), items.check(k, words[a:b], space))
                out = [(d, k, s) for (d, k), s in best.items() if s >= LCS]
                if out:
                    ids = part.column("doc_id").take(pa.array([d for d, _, _ in out]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([int(items.ids[k]) for _, k, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.float64())], ["doc_id", "item_id", "coverage"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage) of every benchmark item found in a document; coverage: its words held in order."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, coverage double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = ["item_id", "text"] + ["answer"] * ("answer" in benchmark.columns)
    items = benchmark.where("item_id is not null").select(*columns)
    n = items.count()
    latent = latent_space(texts) if n else None
    if latent is None:
        return spark.createDataFrame([], schema)
    space, counts = latent
    blocks = -(-n // ITEM_BLOCK)
    out = None
    for b in range(blocks):  # each block of the query set is bounded, and scans all documents
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").toPandas()
        if len(own):
            found = texts.mapInArrow(_search(Items(own, space, counts), space), schema)
            out = found if out is None else out.unionByName(found)
    return out


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
