"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on labelled rows; every path from a root to an inner node or a
leaf is a conjunction of thresholds, a rule.  A logistic model with an L1 penalty weighs the
rules and drops most.  The rest compile into one Spark column expression over the
statistics columns, so scoring needs no model object on the executors.

Statistics come from one vectorised pass over the whole texts.  Training sees at most
``SAMPLE`` labelled documents, the first by a hash of their id; that bound is the only sampling.

Null and empty texts have all statistics 0 and are scored like others.  Of several labels
of one document the smallest counts; null labels don't.  Without both labels in
the sample the score is the share of label 1 (0.5 without any).  Repeated documents are scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .textops import buffers, located_words, mix, slices

SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
LAMBDA = 3e-4

STATISTICS = (
    "bytes", "words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "stops", "wide",
    "distinct", "top_word", "twice", "lines", "line_bytes", "repeated_lines", "longest_word", "short_words",
)


def _in(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for a, b in ranges:
        t[a:b] = 1
    return t


_UPPER, _ASCII = _in((65, 91)), _in((65, 91), (97, 123))
_DIGIT = _in((48, 58))
_MARK = _in((35, 39), (42, 44), (60, 63), (64, 65), (91, 97), (126, 127))
_EXCLAIM, _BAR, _STOP, _WIDE, _NEWLINE = _in((33, 34)), _in((124, 125)), _in((44, 45), (46, 47), (58, 60)), _in((128, 256)), _in((10, 11))


def _per(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[at])


def statistics(texts: pa.Array) -> np.ndarray:
    """Documents x len(STATISTICS)."""
    data, offsets = buffers(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    count = {k: _per(t[data], offsets) for k, t in (("upper", _UPPER), ("ascii", _ASCII), ("digits", _DIGIT), ("marks", _MARK), ("exclaims", _EXCLAIM), ("bars", _BAR), ("stops", _STOP), ("wide", _WIDE))}
    words, at, first = located_words(data, offsets)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(n), n_words)
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)

    def repeats(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: distinct values, and how often the commonest occurs."""
        key = np.sort((who.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        run, whose = np.diff(cuts), (key[cuts[:-1]] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, whose, run)
        return np.bincount(whose, minlength=n), most

    distinct, top = repeats(words, owner)
    same = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    # A word's room: up to the next word of the document, or the document's end.
    room = np.append(first[1:], offsets[-1])[: len(first)]
    room = np.minimum(room, offsets[1:][owner] if len(owner) else room) - first
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, room)
    # Lines with words: the hash of a line sums its words' hashes by position.
    newlines = np.flatnonzero(data == 10)
    line = np.searchsorted(newlines, first) + owner
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words)))) if len(line) else np.zeros(0, np.int64)
    hashes = np.add.reduceat(mix(words + place.astype(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
    n_lines = np.bincount(owner[starts], minlength=n) if len(starts) else np.zeros(n, np.int64)
    distinct_lines, _ = repeats(mix(hashes), owner[starts]) if len(starts) else (np.zeros(n, np.int64), None)
    solid = size - _per((data == 32) | ((data >= 9) & (data <= 13)), offsets)
    return np.column_stack([
        size, n_words, per(solid, n_words), per(count["upper"], count["ascii"]), per(count["digits"], size), per(count["marks"], size), per(count["exclaims"], size), per(count["bars"], size), per(count["stops"], n_words), per(count["wide"], size),
        per(distinct, n_words), per(top, n_words), per(_per(same, at), n_words), n_lines, per(size, n_lines), 1 - np.where(n_lines > 0, per(distinct_lines, n_lines), 1), longest, per(_per(room <= 3, at), n_words),
    ]).astype(np.float64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            x = statistics(part.column("text"))
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in rest] + [pa.array(x[:, i]) for i in range(x.shape[1])], rest + list(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, and a label column if docs has one."""
    ship(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    schema = "doc_id long"
    if "label" in docs.columns:
        cols.append(F.col("label").cast("int").alias("label"))
        schema += ", label int"
    return docs.select(*cols).mapInArrow(_featurise, schema + "".join(f", {s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold)


def _tree(codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """Grow one node: the best split by gain over binned statistics; adds the path's rule."""
    if path:
        out.append(path)
    g, h = residual[rows], hessian[rows]
    value[rows] = g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-6, -1, 0)
    for f in range(codes.shape[1]):
        c = codes[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS))[:-1] for w in (g, h, None))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(ns < 10) | (len(rows) - ns < 10)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0 or k >= len(edges[f]):
        return
    low = codes[rows, f] <= k
    for own, above in ((rows[low], False), (rows[~low], True)):
        _tree(codes, edges, residual, hessian, own, depth - 1, path + ((f, above, float(edges[f][k])),), out, value)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The rules of boosted trees on x and labels y."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(TREES):
        p, value = _sigmoid(z), np.zeros(len(y))
        _tree(codes, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH, (), rules, value)
        z += SHRINK * value
    return list(dict.fromkeys(rules))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in r]) for r in rules]).astype(np.float64) if rules else np.zeros((len(x), 0))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = LAMBDA, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights of standardised rule columns, by accelerated proximal gradient."""
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 0.02)
    s = (r - mean) / scale
    b0 = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    w, v, b, c, t = np.zeros(s.shape[1]), np.zeros(s.shape[1]), b0, b0, 1.0
    lip = 0.25 * (np.linalg.norm(s, 2) ** 2 / len(y) + 1) if s.shape[1] else 1.0
    for _ in range(steps):
        e = _sigmoid(s @ v + c) - y
        w1 = v - s.T @ e / len(y) / lip
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - penalty / lip, 0)
        b1 = c - e.mean() / lip
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    w = w / scale
    return float(b - w @ mean), w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules; without both labels, an intercept only."""
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return float(np.log(share / (1 - share))), []
    rules = extract_rules(x, y)
    b, w = lasso_logistic(holds(rules, x), y)
    return b, [(r, float(k)) for r, k in zip(rules, w) if abs(k) > 1e-4]


def score_column(intercept: float, rules: list[tuple[Rule, float]], statistic=F.col) -> Column:
    """The model as a Spark expression over the statistics; statistic: from a name to its column."""
    z = F.lit(intercept)
    for rule, weight in rules:
        cond = None
        for f, above, t in rule:
            c = statistic(STATISTICS[f]) > t if above else statistic(STATISTICS[f]) <= t
            cond = c if cond is None else cond & c
        z = z + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Learn from the labelled documents given; labels: doc_id, label."""
    own = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)  # at most SAMPLE rows: fit to broadcast
    rows = with_statistics(docs.join(F.broadcast(own), "doc_id")).orderBy("doc_id", *STATISTICS).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(), rows["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]]) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    s = with_statistics(docs.select("doc_id", "text")).select("doc_id", score_column(*model).alias("score"))
    return s.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def _statistics(texts: pa.Array) -> pa.Array:
    parts = [statistics(p.column("text")) for p in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 2 << 20)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(x.shape[1])], list(STATISTICS))


def accepted(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    ship(docs.sparkSession)
    name = "statistics"
    while name in docs.columns:
        name += "_"
    read = F.arrow_udf(_statistics, "struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    scored = docs.withColumn(name, read(F.col("text").cast("string")))
    return scored.where(score_column(*model, lambda s: F.col(name)[s]) >= threshold).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs.select("doc_id", "text"), labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
