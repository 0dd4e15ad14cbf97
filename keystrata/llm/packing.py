"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Sizes are UTF-8 bytes plus one end id (a byte-level vocabulary).  A document beyond the
capacity is cut into full sequences and a rest; full ones take a bin of their own.  The rest is
packed best-fit decreasing: pieces by size, largest first; open bins in order of their
residual.  A bin carries bitmaps of its tags: for sources one bitmap for "once", one for "twice" and so
on up to ``per_source``, for duplicate clusters one.  The successor search starts at the smallest
residual that holds the piece and goes on through larger ones until a bin's bitmaps are
compatible, so the tightest compatible bin wins; if there is none, a new bin opens.  No bin
gets two documents of one cluster, or more than ``per_source`` of one source.

The commonest tags also have a bitmap over residuals that marks where a bin is open to them, so a hot
tag doesn't visit the bins that it has closed.  Any other tag has closed few bins.

Packing is sequential, so documents are dealt by a hash into shards of about ``SHARD``
documents; a hot source or cluster spreads evenly over them, and so do documents without an id.
Each shard leaves a few open bins, which is all that splitting costs.

Null and empty texts are one end id.  A null source or cluster conflicts with nothing; a null
doc_id is packed like any other.  Equal rows are packed each.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 8192
PER_SOURCE = 2
SHARD = 20_000
TRACKED = 24


def _bits(tags: list[int], least: int) -> list[int]:
    """Bit numbers by frequency, the commonest first; -1 for tags that occur less than that often, which can't conflict."""
    common = [t for t, n in Counter(t for t in tags if t >= 0).most_common() if n >= least]
    bit = {t: k for k, t in enumerate(common)}
    return [bit.get(t, -1) for t in tags]


class Residuals:
    """Open bins by residual, with bitmaps over residuals: where any bin is, and where one is open to each tracked tag."""

    def __init__(self, capacity: int, tracked: int):
        self.bins: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.any = 0
        self.open = [0] * tracked
        self.closed: list[Counter] = [Counter() for _ in range(tracked)]  # residual -> bins there that are closed to the tag

    def _mark(self, r: int) -> None:
        n, bit = len(self.bins[r]), 1 << r
        self.any = self.any | bit if n else self.any & ~bit
        for k, shut in enumerate(self.closed):
            self.open[k] = self.open[k] | bit if n > shut[r] else self.open[k] & ~bit

    def put(self, r: int, b: int, closed_to: list[int]) -> None:
        self.bins[r][b] = None
        for k in closed_to:
            self.closed[k][r] += 1
        self._mark(r)

    def take(self, r: int, b: int, closed_to: list[int]) -> None:
        del self.bins[r][b]
        for k in closed_to:
            self.closed[k][r] -= 1
        self._mark(r)


def pack_shard(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, pieces in the order given; a source or cluster of -1 conflicts with nothing."""
    source, cluster = _bits(sources, per_source + 1), _bits(clusters, 2)
    kinds = Counter(("s", s) for s in source if s >= 0) + Counter(("c", c) for c in cluster if c >= 0)
    tracked = {t: k for k, (t, _) in enumerate(kinds.most_common(TRACKED))}
    low = {kind: [(k, 1 << t) for (own, t), k in tracked.items() if own == kind] for kind in "sc"}
    seen: list[list[int]] = []  # of each bin: bitmaps of the sources that it has once, twice, ...
    held: list[int] = []  # of each bin: bitmap of its clusters
    residual: list[int] = []
    free = Residuals(capacity, len(tracked))
    out = []

    def closed_to(b: int) -> list[int]:
        return [k for k, bit in low["s"] if seen[b][-1] & bit] + [k for k, bit in low["c"] if held[b] & bit]

    for size, s, c in zip(sizes, source, cluster):
        s_bit, c_bit = 1 << s if s >= 0 else 0, 1 << c if c >= 0 else 0
        mask = free.any
        for tag in (("s", s), ("c", c)):
            if tag in tracked:
                mask &= free.open[tracked[tag]]
        mask >>= size
        r, found = size, -1
        while mask and found < 0:  # the next residual that may have a compatible bin
            step = (mask & -mask).bit_length() - 1
            r, mask = r + step, mask >> step + 1
            found = next((b for b in free.bins[r] if not (seen[b][-1] & s_bit or held[b] & c_bit)), -1)
            r += found < 0
        if found < 0:
            found = len(residual)
            seen.append([0] * per_source), held.append(0), residual.append(capacity)
        else:
            free.take(r, found, closed_to(found))
        for k, bits in enumerate(seen[found]):  # the first bitmap that lacks the source gets it
            if not bits & s_bit:
                seen[found][k] = bits | s_bit
                break
        held[found] |= c_bit
        residual[found] -= size
        if residual[found]:
            free.put(residual[found], found, closed_to(found))
        out.append(found)
    return out


def _codes(column: pd.Series) -> list[int]:
    return pd.factorize(column)[0].tolist()  # nulls: -1


def _shard(capacity: int, per_source: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        whole = (pdf["size"] // capacity).to_numpy()
        rest = (pdf["size"] % capacity).to_numpy()
        shard = int(pdf["shard"].iloc[0])
        # Full sequences first, each a bin of its own.
        rows = np.repeat(np.arange(len(pdf)), whole)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)
        full = pd.DataFrame({"row": rows, "piece": piece, "n_tokens": capacity, "bin": np.arange(len(rows)), "bin_offset": 0})
        own = np.flatnonzero(rest > 0)
        own = own[np.argsort(-rest[own], kind="stable")]
        source, cluster = _codes(pdf["source"]), _codes(pdf["cluster"])
        bins = pack_shard(rest[own].tolist(), [source[i] for i in own], [cluster[i] for i in own], capacity, per_source)
        part = pd.DataFrame({"row": own, "piece": whole[own], "n_tokens": rest[own], "bin": np.array(bins, np.int64) + len(rows)})
        part["bin_offset"] = part.groupby("bin")["n_tokens"].cumsum() - part["n_tokens"]
        out = pd.concat([full, part], ignore_index=True)
        out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy()[out["row"]] if len(pdf) else []
        out["bin_id"] = (shard << 32) + out["bin"].astype("int64")
        return pd.DataFrame({"doc_id": pd.array(out["doc_id"], dtype="Int64"), "piece": out["piece"].astype("int64"), "bin_id": out["bin_id"], "bin_offset": out["bin_offset"].astype("int64"), "n_tokens": out["n_tokens"].astype("int64")})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: str | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, n_tokens) of every piece of every document.

    cluster: a column with the duplicate cluster, such as the near-duplicate join's component_id; without it,
    documents with equal words are one (their text in lower case, runs of white space as one space).

    Rows without doc_id are dealt by their place in docs, so docs should be stored data, which reads alike each time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        (F.xxhash64(F.when(F.col(cluster).isNotNull(), F.col(cluster).cast("string"))) if cluster else words).alias("cluster"),
        (F.col(cluster).isNull() if cluster else F.lit(False)).alias("alone"),
    ).withColumn("cluster", F.when(~F.col("alone"), F.col("cluster")))
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard))
    place = F.coalesce("doc_id", F.monotonically_increasing_id())
    key = F.pmod(F.xxhash64(place, "size", "source", "cluster", F.lit(9)), F.lit(shards)).alias("shard")
    columns = ["doc_id", "source", "size", "cluster", key]
    return sized.select(*columns).groupBy("shard").applyInPandas(_shard(capacity, per_source), "doc_id long, piece long, bin_id long, bin_offset long, n_tokens long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import ship

    ship(spark)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
