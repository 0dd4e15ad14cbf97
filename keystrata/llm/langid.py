"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time.  It reads a text's
UTF-8 bytes (A-Z in lower case) in windows of ``WINDOW`` bytes, once in each direction, and
labels every position with a probability for each language; a document's probabilities are
the mean over all its positions.  A window is read alone: what shares a batch with it doesn't
matter.  Gates use a hard sigmoid and the candidate state softsign, in training as in
prediction, so prediction is matrix products and cheap array operations.

Training sees at most ``SAMPLE`` documents of each language, the first by a hash of their
id and text (equal rows once), and one window of ``TRAIN_WINDOW`` bytes of each, at a place that
the hash gives; these bounds are the only sampling.  Prediction covers every
byte of every text, in batches of ``BATCH`` windows, so memory doesn't depend on a text's length.

A text that is null or has no letter is ``und`` with score 0.  Ties go to the first language
in order.  If there is nothing to learn from, every text is ``und``.  Repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .textops import LOWER, buffers, slices

HIDDEN = 8
WINDOW = 128
TRAIN_WINDOW = 64
BATCH = 2048
SAMPLE = 1500
STEPS = 260
UND = "und"


class Gru:
    """Weights by direction: w (3H x 256, bias included), u (3H x H); v (K x 2H), c (K)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        self.h = hidden
        self.p = {"w0": f(3 * hidden, 256), "u0": f(3 * hidden, hidden), "w1": f(3 * hidden, 256), "u1": f(3 * hidden, hidden), "v": f(classes, 2 * hidden), "c": np.zeros((classes, 1), np.float32)}

    def _forward(self, x: np.ndarray, d: int, mask: np.ndarray) -> dict:
        """x: T x B bytes in reading order, mask: 1 where there is a byte (state 0 elsewhere); keeps what backpropagation needs."""
        n, w, u = self.h, self.p[f"w{d}"], self.p[f"u{d}"]
        h, kept = np.zeros((n, x.shape[1]), np.float32), {k: [] for k in ("h", "zr", "g", "n")}
        out = []
        for t in range(len(x)):
            a, g = w[:, x[t]], u @ h
            zr = np.clip(0.2 * (a[: 2 * n] + g[: 2 * n]) + 0.5, 0, 1)
            pre = a[2 * n :] + zr[n:] * g[2 * n :]
            new = pre / (1 + np.abs(pre))
            for k, value in zip(("h", "zr", "g", "n"), (h, zr, g[2 * n :], new)):
                kept[k].append(value)
            h = (new + zr[:n] * (h - new)) * mask[t]
            out.append(h)
        return kept | {"out": out}

    def _backward(self, x: np.ndarray, d: int, mask: np.ndarray, kept: dict, grads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, u = self.h, self.p[f"u{d}"]
        dw, du, carry = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u), 0
        eye = np.eye(256, dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, zr, g, new = (kept[k][t] for k in ("h", "zr", "g", "n"))
            dh = (grads[t] + carry) * mask[t]
            dpre = dh * (1 - zr[:n]) * (1 - np.abs(new)) ** 2
            dzr = np.concatenate([dh * (h - new), dpre * g]) * (0.2 * ((zr > 0) & (zr < 1)))
            dg = np.concatenate([dzr, dpre * zr[n:]])
            du += dg @ h.T
            dw += np.concatenate([dzr, dpre]) @ eye[x[t]]
            carry = dh * zr[:n] + u.T @ dg
        return dw, du

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """x, mask: T x B; y: B class numbers.  Mean cross-entropy over the positions, and its gradients."""
        n, v = self.h, self.p["v"]
        f, b = self._forward(x, 0, mask), self._forward(x[::-1], 1, mask[::-1])
        total, loss, dv, dc = max(1.0, float(mask.sum())), 0.0, np.zeros_like(v), np.zeros_like(self.p["c"])
        df, db = [], []
        for t in range(len(x)):
            both = np.concatenate([f["out"][t], b["out"][len(x) - 1 - t]])
            e = np.exp(v @ both + self.p["c"])
            e /= e.sum(axis=0)
            at = (y, np.arange(len(y)))
            loss -= float((np.log(e[at] + 1e-9) * mask[t]).sum())
            e[at] -= 1
            e *= mask[t] / total
            dv += e @ both.T
            dc += e.sum(axis=1, keepdims=True)
            back = v.T @ e
            df.append(back[:n])
            db.append(back[n:])
        g = {"v": dv, "c": dc}
        g["w0"], g["u0"] = self._backward(x, 0, mask, f, df)
        g["w1"], g["u1"] = self._backward(x[::-1], 1, mask[::-1], b, db[::-1])
        return loss / total, g

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 1) -> float:
        """x: N x T bytes; that many steps of Adam with a falling rate.  Returns the mean loss of the last ten."""
        r, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(p) for k, p in self.p.items()}
        s = {k: np.zeros_like(p) for k, p in self.p.items()}
        while step < steps:
            order = r.permutation(len(x))
            for k in range(0, min(len(x), (steps - step) * batch), batch):
                own = order[k : k + batch]
                mask = (np.arange(x.shape[1])[:, None] < sizes[own]).astype(np.float32)
                loss, g = self.gradients(np.ascontiguousarray(x[own].T), mask, y[own])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                for k2, q in g.items():
                    q = q * min(1.0, 1.0 / (norm + 1e-9))
                    m[k2] = 0.9 * m[k2] + 0.1 * q
                    s[k2] = 0.99 * s[k2] + 0.01 * q * q
                    down = rate * (1 - step / (steps + 1))
                    self.p[k2] = (self.p[k2] - down * (m[k2] / (1 - 0.9**step)) / (np.sqrt(s[k2] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-10:]))

    def position_sums(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """x: T x B bytes, sizes: B.  Sums over each window's positions of the class probabilities, K x B."""
        n, width, (steps, batch) = self.h, 3 * self.h, x.shape
        scale = np.concatenate([np.full(2 * n, 0.2), np.ones(n)]).astype(np.float32)[:, None]
        shift = np.concatenate([np.full(2 * n, 0.5), np.zeros(n)]).astype(np.float32)[:, None]
        states = np.empty((2, steps, n, batch), np.float32)
        a, g, tmp = np.empty((width, batch), np.float32), np.empty((width, batch), np.float32), np.empty((n, batch), np.float32)
        index, shortest = x.astype(np.intp), int(sizes.min()) if batch else 0
        for d in (0, 1):
            w, u = np.ascontiguousarray(self.p[f"w{d}"] * scale + shift), np.ascontiguousarray(self.p[f"u{d}"] * scale)
            h = np.zeros((n, batch), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(w, index[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                zr = a[: 2 * n]
                zr += g[: 2 * n]
                np.maximum(zr, 0, out=zr)
                np.minimum(zr, 1, out=zr)
                new = a[2 * n :]
                np.multiply(zr[n:], g[2 * n :], out=tmp)
                new += tmp
                np.abs(new, out=tmp)
                tmp += 1
                new /= tmp
                np.subtract(h, new, out=tmp)
                tmp *= zr[:n]
                h = states[d, t]
                np.add(new, tmp, out=h)
                if d and t >= shortest:  # reading back starts at a window's own last byte
                    h *= sizes > t
        v, out = self.p["v"], np.zeros((len(self.p["c"]), batch), np.float32)
        for t in range(steps):
            e = v[:, :n] @ states[0, t]
            e += v[:, n:] @ states[1, t]
            e += self.p["c"]
            np.exp(e, out=e)
            e *= (sizes > t) / e.sum(axis=0)
            out += e
        return out


def _label(model: Gru | None, classes: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    names = np.array(classes + [UND], dtype=object)
    data, offsets = buffers(texts)
    data, sizes = LOWER[data], np.diff(offsets)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    length = np.minimum(WINDOW, offsets[owner + 1] - start)
    sums = np.zeros((len(sizes), max(1, len(classes))))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    order = np.argsort(length, kind="stable")
    for k in range(0, len(owner), BATCH) if model is not None else ():
        own = order[k : k + BATCH]
        longest = int(length[own].max())
        x = padded[start[own] + np.arange(longest)[:, None]]
        x[np.arange(longest)[:, None] >= length[own]] = 0
        np.add.at(sums, owner[own], model.position_sums(x, length[own]).T)
    means = sums / np.maximum(sizes, 1)[:, None]
    best = means.argmax(axis=1)
    letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    has = np.diff(letters[offsets]) > 0
    for i in np.flatnonzero(~has & (sizes > 0)):
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    has &= model is not None
    score = np.where(has, np.minimum(means[np.arange(len(sizes)), best], 1.0), 0.0)
    return names[np.where(has, best, len(classes))], score


def label(text: Column, model: Gru | None, classes: list[str]) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [_label(model, classes, part.column("text")) for part in slices(batch, "text")]
        lang, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return run(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Gru | None, list[str]]:
    """Learn from text and lang of the documents given."""
    ship(docs.sparkSession)
    h = F.xxhash64("doc_id", "text", F.lit(5))
    # A window of bytes somewhere in the text.
    body = F.col("text").cast("string").cast("binary")
    at = (F.lit(1) + F.pmod(h, F.greatest(F.octet_length(body) - TRAIN_WINDOW, F.lit(1)).cast("long"))).cast("int")
    rows = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", F.substring(body, at, F.lit(TRAIN_WINDOW)).alias("part"), h.alias("h"))
    # One row for each class, as the model has one weight vector for each.  Rows under a bound on their hash
    # that twice the sample is expected to stay under are gathered, so no task sorts a language.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("h", "part")).alias("first"))
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")).alias("share"))
    u = (F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    few = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "h", "part")
    few = few.unionByName(sizes.select("lang", "first.h", "first.part")).distinct()
    # The bounded sample is learnt from in one task, where numpy has a single thread.
    got = few.select(F.lit(1).alias("g"), "lang", "h", "part").groupBy("g").applyInPandas(lambda f: _learn(f, sample), "model binary").first()
    return pickle.loads(bytes(got["model"])) if got else (None, [])


def _learn(rows: pd.DataFrame, sample: int) -> pd.DataFrame:
    rows["u"] = rows["h"] % (1 << 40)
    rows = rows.sort_values(["lang", "u", "h", "part"], kind="stable").groupby("lang").head(sample)
    rows = rows.sort_values(["lang", "part"], kind="stable")
    classes = sorted(rows["lang"].unique())
    raw = [LOWER[np.frombuffer(bytes(t), np.uint8)] for t in rows["part"]]
    x = np.zeros((len(raw), TRAIN_WINDOW), np.uint8)
    for i, r in enumerate(raw):
        x[i, : len(r)] = r
    model = Gru(len(classes))
    model.fit(x, np.array([len(r) for r in raw]), rows["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy())
    return pd.DataFrame({"model": [pickle.dumps((model, classes))]})


def predict(docs: DataFrame, model: Gru | None, classes: list[str]) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    ship(docs.sparkSession)
    return docs.select("doc_id", label(F.col("text"), model, classes).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def identified(docs: DataFrame, model: Gru | None, classes: list[str], least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least that score."""
    ship(docs.sparkSession)
    found = label(F.col("text"), model, classes)
    return docs.where((found["lang_pred"] != UND) & (found["score"] >= least))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, classes = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, classes).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
