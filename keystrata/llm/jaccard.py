"""N-gram Jaccard join: sets of word shingles in a prefix tree, pruned by remaining lengths.

Documents link when 5 |x n y| >= 4 |x u y| (the default 0.8).  The whole join runs on
classes of equal sets, and in these steps:

1. One pass over the texts gives every document's set size and set digest; equal
   digests are one class, its smallest id the representative.
2. Exact filter.  If x links with y, both hold at least k common shingles among the
   |x| - ceil(0.8 |x|) + k first of their sets in any global order.  In hash order, with k
   a tenth of the set, those prefixes are dealt out by shingle; a class with too few
   shingles that another class has too can link with nothing and goes.
3. The whole sets of what is left are dealt out by shingle once more and every shingle
   gets its exact number of classes, which is the global order: rare first.  Shingles of one
   class match nothing, so a class with fewer than ceil(0.8 |x|) others goes.  Classes
   that share a shingle in their k = 1 prefixes are candidates; their connected
   components are candidate clusters.
4. Each cluster is joined in a prefix tree, sets ordered from frequent to rare so that
   they share paths.  A traversal carries the partial overlap down and leaves a subtree when
   that plus the shorter remaining length can't reach the overlap that is needed.
5. A cluster beyond ``BLOCK`` classes is first joined in two independent random
   blockings.  Then its members outside its largest component so far are joined with all
   its others, block by block; in a cluster beyond ``GRID`` blocks that is done within
   each posting list instead.  No pair with a common posting list and different components is
   left out, so the result is exact.

Null and empty texts, and texts of white space, have no shingles and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, join_by_key
from .textops import mix, shingle_sets, slices, tidy

NUM, DEN = 4, 5
BLOCK = 512
TOKENS = 1 << 20  # shingles in a block, about: long texts make smaller blocks
GRID = 64
BLOOM_BITS = 25
BLOOM_ROWS = 1 << 22  # beyond it the candidates' texts are found by a shuffled semi-join
_U = np.uint64


def _need(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that it links with."""
    return -(-NUM * n // DEN)


def digest(s: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    a, b = mix(s + _U(1)), mix(s ^ _U(0xA5A5A5A5A5A5A5A5))
    return np.array([a.sum(dtype=np.uint64), np.bitwise_xor.reduce(b) + _U(len(s))], dtype=np.uint64).tobytes()


def short(d: bytes) -> int:
    return int(np.frombuffer(d, np.int64).sum())


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                keys = [digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([None if k is None else short(k) for k in keys], pa.int64())], ["doc_id", "n_shingles", "digest", "short"])

    return run


def _dealt(keys: list[np.ndarray], owners: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """(shingle, owner) pairs packed into one row for each bucket of shingles."""
    k, o = np.concatenate(keys), np.concatenate(owners)
    b = (k % _U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    k, o, b = k[order], o[order], b[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (k, o)]
    return pa.RecordBatch.from_arrays([pa.array(b[cuts[:-1]], pa.int64()), *blobs], ["bucket", "keys", "owners"])


def _prefixes(n: int, buckets: int):
    """Packed (shingle, class) of the filter's prefixes, a blob for each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0

        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(part.column("text"), n):
                    if len(s):
                        p = len(s) - -(-NUM * len(s) // DEN) + -(-len(s) // 10)
                        keys.append(s[:p])
                        owners.append(np.full(p, short(digest(s)), np.int64))
                        held += p
                if held >= 1 << 20:
                    yield _dealt(keys, owners, buckets)
                    keys, owners, held = [], [], 0
        if held:
            yield _dealt(keys, owners, buckets)

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for every class, how many of its shingles another class has too."""
    tidy()
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    o = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]])
    order = np.lexsort((o, k))
    k, o = k[order], o[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    k, o = k[new], o[new]
    twice = np.zeros(len(k), bool)
    twice[1:] |= k[1:] == k[:-1]
    twice[:-1] |= k[1:] == k[:-1]
    who, count = np.unique(o[twice], return_counts=True)
    return pd.DataFrame({"short": who, "shared": count})


def _bits(ids: np.ndarray) -> np.ndarray:
    """Four positions of each id in the Bloom filter."""
    h = mix(ids.astype(np.int64).view(np.uint64) + _U(0x1234567))
    return np.concatenate([(mix(h + _U(i)) >> _U(64 - BLOOM_BITS)).astype(np.int64) for i in range(4)])


def _bloom(ids: DataFrame) -> bytes:
    """A filter of 2**25 bits over the ids, ORed together on the executors by slices."""
    size = (1 << BLOOM_BITS) // 8

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << BLOOM_BITS, bool)
        some = False
        for f in frames:
            bits[_bits(f["cid"].to_numpy())] = True
            some |= len(f) > 0
        if some:
            packed = np.packbits(bits)
            rows = [(i, packed[i * size // 16 : (i + 1) * size // 16].tobytes()) for i in range(16)]
            yield pd.DataFrame(rows, columns=["slice", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size // 16, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "bits": [out.tobytes()]})

    got = {r["slice"]: r["bits"] for r in ids.select("cid").mapInPandas(part, "slice int, bits binary").groupBy("slice").applyInPandas(merge, "slice int, bits binary").collect()}
    return b"".join(bytes(got.get(i, bytes(size // 16))) for i in range(16))


def _sets(n: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(bloom.value, np.uint8) if bloom is not None else None
        for batch in batches:
            if packed is not None:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                p = _bits(ids)
                hit = ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).reshape(4, -1).all(axis=0)
                batch = batch.filter(pa.array(hit))
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "n", "hashes"])
                yield out

    return run


def _whole(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            for cid, b in zip(batch.column("cid").to_pylist(), batch.column("hashes").to_pylist()):
                keys.append(np.frombuffer(b, np.uint64))
                owners.append(np.full(len(keys[-1]), cid, np.int64))
                held += len(keys[-1])
                if held >= 1 << 20:
                    yield _dealt(keys, owners, buckets)
                    keys, owners, held = [], [], 0
        if held:
            yield _dealt(keys, owners, buckets)

    return run


def _counted(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket of shingles: those of several classes with their number, packed by buckets of classes."""
        tidy()
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        o = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]])
        order = np.argsort(k, kind="stable")
        k, o = k[order], o[order]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
        df = np.repeat(np.diff(cuts), np.diff(cuts))
        k, o, df = k[df > 1], o[df > 1], df[df > 1]
        b = (mix(o.view(np.uint64)) % _U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        k, o, df, b = k[order], o[order], df[order], b[order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else [0]
        rows = [(int(b[i]), k[i:j].tobytes(), o[i:j].tobytes(), df[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        return pd.DataFrame(rows, columns=["bucket", "keys", "owners", "counts"])

    return run


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of classes: each with its shared shingles, rare first."""
    tidy()
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    o, df = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("owners", "counts"))
    order = np.lexsort((k, df, o))
    k, o = k[order], o[order]
    cuts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]]))
    return pd.DataFrame({"cid": o[cuts[:-1]], "shared": np.diff(cuts), "tokens": [k[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]})


def _postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The k = 1 prefixes; the shingles that no other class has come first in them and match nothing."""
    for f in frames:
        keys, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cid, n, m, b in zip(f["cid"], f["n"], f["shared"], f["tokens"]):
            p = int(n) - -(-NUM * int(n) // DEN) + 1 - (int(n) - int(m))
            keys.append(np.frombuffer(b, np.int64)[:p])
            who.append(np.full(len(keys[-1]), cid, np.int64))
        yield pd.DataFrame({"token": np.concatenate(keys), "cid": np.concatenate(who)})


class PrefixTree:
    """Sets of small integers, sorted ascending, in a compressed trie.

    Nodes are in order of depth.  ``tokens[at[i]:at[i+1]]`` is what node i adds to its
    parent's path; ``low``/``high`` bound the sizes of the sets that end at or below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        rows = [sets[i] for i in order]
        common = [0]
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[:m] != b[:m])
            common.append(int(diff[0]) if len(diff) else m)
        parent, depth, edge, level, ends = [-1], [0], [np.zeros(0, np.int64)], [0], [[]]
        stack = [0]
        for k, row in enumerate(rows):
            c = common[k]
            while depth[stack[-1]] > c and depth[parent[stack[-1]]] >= c:
                stack.pop()
            top = stack[-1]
            if depth[top] > c:  # split the edge
                above, cut = parent[top], c - depth[parent[top]]
                parent.append(above), depth.append(c), edge.append(edge[top][:cut]), level.append(0), ends.append([])
                parent[top], edge[top] = len(parent) - 1, edge[top][cut:]
                stack[-1] = len(parent) - 1
            if len(row) > c:
                parent.append(stack[-1]), depth.append(len(row)), edge.append(row[c:]), level.append(0), ends.append([order[k]])
                stack.append(len(parent) - 1)
            else:
                ends[stack[-1]].append(order[k])
        kids: list[list[int]] = [[] for _ in parent]
        for i, p in enumerate(parent):
            if p >= 0:
                kids[p].append(i)
        rank, levels = [0], [[0]]
        while levels[-1]:
            levels.append([j for i in levels[-1] for j in kids[i]])
            rank += levels[-1]
        new = {old: i for i, old in enumerate(rank)}
        self.parent = np.array([new[parent[i]] if parent[i] >= 0 else 0 for i in rank])
        self.depth = np.array([depth[i] for i in rank])
        self.tokens = np.concatenate([edge[i] for i in rank])
        self.at = np.concatenate([[0], np.cumsum([len(edge[i]) for i in rank])])
        self.ends = [ends[i] for i in rank]
        self.last = np.array([edge[i][-1] if len(edge[i]) else -1 for i in rank])
        # In order of depth the children of a node stand in a row.
        self.n_kids = np.array([len(kids[i]) for i in rank])
        self.first_kid = 1 + np.cumsum(self.n_kids) - self.n_kids
        self.is_end = np.array([bool(e) for e in self.ends])
        low, high = np.full(len(rank), 1 << 60), np.zeros(len(rank), np.int64)
        for i in range(len(rank) - 1, -1, -1):
            if self.ends[i]:
                low[i], high[i] = min(low[i], self.depth[i]), max(high[i], self.depth[i])
            if i:
                p = self.parent[i]
                low[p], high[p] = min(low[p], low[i]), max(high[p], high[i])
        self.low, self.high = low, high

    def matches(self, x: np.ndarray, member: np.ndarray) -> Iterator[int]:
        """Sets that link with x (sorted); member: the same as a table over all tokens, 0 or 1."""
        n = len(x)
        nodes, got = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            done = self.is_end[nodes] & (DEN * got >= NUM * (n + self.depth[nodes] - got))
            for i in nodes[done]:
                yield from self.ends[i]
            count = self.n_kids[nodes]
            had = np.repeat(got, count)
            nodes = np.repeat(self.first_kid[nodes] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            if not len(nodes):
                return
            # Sizes first: a subtree without a set of a fitting size isn't read.
            fits = (self.high[nodes] * DEN >= NUM * n) & (self.low[nodes] * NUM <= DEN * n)
            nodes, had = nodes[fits], had[fits]
            if not len(nodes):
                return
            length = self.at[nodes + 1] - self.at[nodes]
            starts = np.cumsum(length) - length
            where = np.repeat(self.at[nodes] - starts, length) + np.arange(int(length.sum()))
            got = had + np.add.reduceat(member[self.tokens[where]], starts)
            # Then what is left of x and of the longest set below.
            rest = np.minimum(n - np.searchsorted(x, self.last[nodes], "right"), self.high[nodes] - self.depth[nodes])
            least = np.maximum(self.low[nodes], self.depth[nodes])
            keep = (got + rest) * (NUM + DEN) >= NUM * (n + least)
            nodes, got = nodes[keep], got[keep]


def joined(ids: np.ndarray, sets: list[np.ndarray], asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among the sets; asks: only those with a member that it marks."""
    tokens, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    flat = rank[back]
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    rows = [np.sort(r) for r in np.split(flat, cuts)]
    tree = PrefixTree(rows)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    member, links = np.zeros(len(tokens), np.int64), []
    for i, x in enumerate(rows):
        if asks is not None and not asks[i]:
            continue
        member[x] = 1
        for j in tree.matches(x, member):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((int(ids[i]), int(ids[j])))
        member[x] = 0
    return links


def _tree_join(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid").drop_duplicates("cid")
    if len(pdf) < 2:
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    asks = pdf["asks"].to_numpy() if "asks" in pdf else None
    links = joined(pdf["cid"].to_numpy(), [np.frombuffer(b, np.uint64) for b in pdf["hashes"]], asks)
    return pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def _blocks(classes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(classes / F.lit(BLOCK)), F.ceil(shingles / F.lit(TOKENS)), F.lit(1)).cast("int")


def _rest(lists: DataFrame, sets: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """For lists (token, cid): members outside a list's largest component, joined with all its others."""
    own = lists.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")).join(sets.select("cid", "n"), "cid")
    lists = own.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.xxhash64("cid", F.lit(7)).cast("decimal(38,0)")).alias("s")).where("a <> b")
    lists = lists.groupBy("size", "x", "s").agg(F.min("token").alias("token"))  # equal lists once
    own = own.join(lists.select("token"), "token", "left_semi")
    sizes = own.groupBy("token", "label").agg(F.count("*").alias("c"))
    most = sizes.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("most"))
    own = scratch.table(own.join(most, "token").withColumn("asks", F.col("label") != F.col("most")), "open-lists")
    counts = own.groupBy("token").agg(_blocks(F.count_if("asks"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0))).alias("rows"), _blocks(F.count("*"), F.sum("n")).alias("cols"))
    own = own.join(counts, "token")
    # A grid of blocks: askers by rows, all members by columns.
    row, col = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("rows")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(4)), F.col("cols")).cast("int")
    asking = own.where("asks").select("token", row.alias("r"), F.explode(F.expr("sequence(0, cols - 1)")).alias("c"), "cid", F.lit(True).alias("asks"))
    asked = own.select("token", F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), col.alias("c"), "cid", F.lit(False).alias("asks"))
    cells = asking.unionByName(asked).groupBy("token", "r", "c", "cid").agg(F.max("asks").alias("asks"))
    return cells.join(sets.select("cid", "hashes"), "cid").groupBy("token", "r", "c").applyInPandas(_tree_join, "u long, v long")


def jaccard_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A row without doc_id links with nothing and has a null component_id.  Equal rows are
    equal in the result; of different texts under one doc_id each has its own class, and the
    smallest set among those that are a class's smallest id stands for that id in the
    join.  Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    profile = scratch.table(texts.mapInArrow(_profiles(n), "doc_id long, n_shingles long, digest binary, short long"), "profile")
    total, n_rows = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    texts = texts.where("doc_id is not null")
    classes = profile.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("short").alias("short"), F.count("*").alias("copies"))
    buckets = max(parts, int(total * 0.3) // (1 << 20))
    shared = texts.mapInArrow(_prefixes(n, buckets), "bucket long, keys binary, owners binary").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))
    keep = F.col("shared") >= F.ceil(F.ceil(F.col("n") * NUM / DEN) / 10)
    candidates = scratch.table(classes.join(shared, "short").where(keep).select("cid", "n"), "candidates", n_rows)
    found = candidates.count()
    named = classes.select("digest", F.col("cid").alias("component"), F.col("copies").alias("n"))
    finish = lambda named: join_by_key(profile, named, "digest", n_rows, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    if not found:
        return finish(named)
    if found <= BLOOM_ROWS:
        bloom = spark.sparkContext.broadcast(_bloom(candidates))
        sets = texts.mapInArrow(_sets(n, bloom), "cid long, n long, hashes binary")
    else:
        sets = texts.join(candidates.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(n, None), "cid long, n long, hashes binary")
    sets = scratch.table(sets.where("n > 0"), "sets")
    rows, ids = sets.agg(F.count("*"), F.countDistinct("cid")).first()
    if rows > ids:  # an id on several rows
        sets = scratch.table(sets.groupBy("cid").agg(F.min(F.struct("n", "hashes")).alias("s")).select("cid", "s.n", "s.hashes"), "sets")
    packed = "bucket long, keys binary, owners binary"
    size = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts, int(size) >> 20)
    counted = sets.mapInArrow(_whole(buckets), packed).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_counted(buckets), packed + ", counts binary")
    ordered = counted.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_ordered, "cid long, shared long, tokens binary")
    ordered = ordered.join(sets.select("cid", "n"), "cid").where(F.col("shared") * DEN >= F.col("n") * NUM)
    posts = scratch.table(ordered.mapInPandas(_postings, "token long, cid long"), "posts")
    heads = posts.groupBy("token").agg(F.min("cid").alias("head"), F.count("*").alias("size")).where("size > 1")
    posts = scratch.table(posts.join(heads.select("token", "head"), "token"), "lists", size)
    cluster = scratch.table(components(posts.where("cid <> head").select(F.col("cid").alias("u"), F.col("head").alias("v")), scratch).withColumnsRenamed({"id": "cid", "component": "cluster"}), "clusters", found)
    sizes = cluster.join(sets.select("cid", "n"), "cid").groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    sized = cluster.join(sizes, "cluster")
    salts = F.when(F.col("blocks") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    dealt = sized.select("cid", "cluster", "blocks", F.explode(salts).alias("salt")).withColumn("block", F.pmod(F.xxhash64("cid", "salt"), F.col("blocks")).cast("int"))
    links = dealt.join(sets.select("cid", "hashes"), "cid").groupBy("cluster", "salt", "block").applyInPandas(_tree_join, "u long, v long")
    links = scratch.table(links, "found")
    big = scratch.table(sized.where("blocks > 1").select("cid", "cluster", "blocks"), "big", found)
    label = components(links, scratch).withColumnsRenamed({"id": "cid", "component": "label"})
    if not big.isEmpty():
        label = scratch.table(label, "label", found)
        grids = big.where(F.col("blocks") <= GRID).select(F.col("cluster").alias("token"), "cid")
        lists = posts.join(big.where(F.col("blocks") > GRID).select("cid"), "cid", "left_semi").select("token", "cid")
        more = scratch.table(_rest(grids, sets, label, scratch).unionByName(_rest(lists, sets, label, scratch)), "more")
        label = components(links.unionByName(more), scratch).withColumnsRenamed({"id": "cid", "component": "label"})
    scratch.drop(candidates, sets, posts)
    named = classes.select("digest", "cid", "copies").join(label, "cid", "left").select("digest", F.coalesce("label", "cid").alias("component"), F.col("copies").alias("n"))
    return finish(named)


def _among(docs: DataFrame, ids: DataFrame, key: str) -> Column | None:
    """Whether a row's key may be among the ids, by a filter of fixed size; None where there are too many ids for it."""
    if ids.count() > BLOOM_ROWS:
        return None
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    @F.arrow_udf("boolean")
    def maybe(i: pa.Array) -> pa.Array:
        packed = np.frombuffer(bits.value, np.uint8)
        p = _bits(i.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).reshape(4, -1).all(axis=0))

    return maybe(F.col(key).cast("long"))


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key isn't among the ids (one column doc_id, stored): an anti-join.

    While the ids fit the fixed-size filter, only rows that it can't clear are shuffled.
    """
    ids = ids.select(F.col("doc_id").cast("long").alias("cid")).where("cid is not null").distinct()
    anti = lambda d: d.join(ids, d[key] == ids["cid"], "left_anti")
    hit = _among(docs, ids, key)
    return anti(docs) if hit is None else docs.where(~hit).unionByName(anti(docs.where(hit)))


def once(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row of docs for each key; ids (column doc_id, stored): the keys that several rows have."""
    ids = ids.select(F.col("doc_id").cast("long").alias("cid"))
    if ids.isEmpty():
        return docs
    hit = _among(docs, ids, key)
    return docs.dropDuplicates([key]) if hit is None else docs.where(~hit).unionByName(docs.where(hit).dropDuplicates([key]))


def op1_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.v) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n
"""
