import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keystrata.llm import ann, chat, decontaminate, packing

DIR = "/root/testdata/sf0.01"


def brute_chats(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    whole = {c: tuple((r[1][1], r[2][1]) for r in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, t in whole.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            continue
        same = [k for k, o in whole.items() if o == t]
        keep = min((k for k in same if k is not None), default=None)
        out[keep] = (len(t), len(same))
    return out


def test_snapshots_collapse(spark):
    r, rows = random.Random(2), []
    base = [[(i, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, f"t{r.randrange(3)}"])) for i in range(6)] for _ in range(6)]
    for c in range(60):
        t = r.choice(base)[: r.randrange(1, 7)]
        rows += [(c if c else None, *x) for x in t]
    rows += [(100, 0, "user", "x"), (100, 0, "user", "x"), (101, None, "user", "y"), (102, 0, "user", "<|im_end|>")]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, i int, h1 string")
    got = {x["conv_id"]: (x["n_turns"], x["copies"]) for x in chat.collapse_and_render(df).collect()}
    assert got == brute_chats(rows)
    text = {x["conv_id"]: x["rendered"] for x in chat.collapse_and_render(df).collect()}
    assert text[100] == "<|im_start|>user\nx<|im_end|>\n" * 2 and text[102] == "<|im_start|>user\n<| im_end|><|im_end|>\n"
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_long_and_no_conversations(spark):
    """One conversation of 5,000 turns, its prefix, and an empty table."""
    schema = "conv_id long, turn int, role string, text string, n_turns int"
    long = [(1, i, "user", f"t{i}", 0) for i in range(5000)]
    got = chat.collapse_and_render(spark.createDataFrame(long + [(2, *r[1:]) for r in long[:4000]], schema)).collect()
    assert [(r["conv_id"], r["n_turns"], r["copies"]) for r in got] == [(1, 5000, 1)]
    assert got[0]["rendered"] == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(5000))
    assert chat.collapse_and_render(spark.createDataFrame([], schema)).collect() == []


def test_chat_and_licence_plans_are_native(spark):
    from keystrata.llm import licenses

    for q in (chat.op10_chat_snapshots, licenses.op4_license_scan):
        plan = q(spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [i for i, b in enumerate(bins) if b[0] >= size and (s < 0 or b[1].count(s) < per_source) and (c < 0 or c not in b[2])]
        if fits:
            least = min(bins[i][0] for i in fits)
            out.append(("old", least - size))
            i = [i for i in fits if bins[i][0] == least][0]
        else:
            bins.append([capacity, [], []])
            out.append(("new", capacity - size))
            i = len(bins) - 1
        bins[i][0] -= size
        bins[i][1].append(s)
        bins[i][2].append(c)
    return bins, out


def test_packing_takes_the_tightest_compatible_bin():
    r = random.Random(4)
    for _ in range(20):
        n, cap, per = 200, 64, r.choice([1, 2, 3])
        sizes = sorted((r.randrange(1, 64) for _ in range(n)), reverse=True)
        sources, clusters = [r.choice([0, 0, 0, 1, 2, 3, -1]) for _ in range(n)], [r.choice([0, 0, *range(50)]) for _ in range(n)]
        got = packing.pack_shard(sizes, sources, clusters, cap, per)
        bins = defaultdict(list)
        for k, b in enumerate(got):  # replay: each choice is a tightest one
            ok = {x: cap - sum(sizes[i] for i in m) for x, m in bins.items() if sum(sources[i] == sources[k] for i in m) < per or sources[k] < 0}
            ok = {x: v for x, v in ok.items() if v >= sizes[k] and not any(clusters[i] == clusters[k] for i in bins[x])}
            assert (b not in bins and not ok) or ok[b] == min(ok.values())
            bins[b].append(k)


def test_pack_keeps_everything(spark):
    rows = [(i, "src0" if i % 3 else None, "w" * (i * 37 % 900)) for i in range(200)] + [(900, "s", None), (None, "s", ""), (901, None, "x" * 25_000), (5, "src0", "w" * 185)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, source string, text string, size int, shard int")
    got = packing.pack(df, capacity=1000, per_source=2).toPandas()
    assert got["n_tokens"].sum() == sum(len(r[2] or "") + 1 for r in rows)
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert (b["bin_offset"].to_numpy() == np.concatenate([[0], np.cumsum(b["n_tokens"])[:-1]])).all() and b["n_tokens"].sum() <= 1000
    assert sorted(got[got["doc_id"] == 901]["piece"]) == list(range(26))
    assert packing.pack(df.limit(0)).count() == 0


def test_pack_keeps_the_constraints_over_shards(spark):
    """Against the documents: every piece once, and in no bin two of a cluster or three of a source; null ids spread."""
    r = random.Random(6)
    rows = [(None if i % 3 == 0 else i, r.choice(["hot", "hot", "b", "c", None, f"s{i}"]), "w" * r.randrange(0, 700), r.choice([None, 1, 1, i]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, component_id long, bin_id long")
    got = packing.pack(df.where("doc_id is not null"), 1000, 2, "component_id", 200).toPandas()
    own = {x[0]: x for x in rows if x[0] is not None}
    assert sorted(got["doc_id"]) == sorted(own) and len(set(got["bin_id"] // 2**32)) >= 4
    for _, b in got.groupby("bin_id"):
        sources, clusters = ([own[d][k] for d in b["doc_id"] if own[d][k] is not None] for k in (1, 3))
        assert b["n_tokens"].sum() <= 1000 and max(map(sources.count, sources), default=0) <= 2 and len(set(clusters)) == len(clusters)
    shards = packing.pack(df.select("source", "text", F.lit(None).alias("doc_id")), 1000, 2, None, 100).toPandas()
    assert shards["n_tokens"].sum() == sum(len(x[2]) + 1 for x in rows) and shards.groupby(shards["bin_id"] // 2**32).size().max() < 200


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def brute_search(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            near = sorted(((-float((v * q).sum()), j) for j, v in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_search_small_is_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist(), 0.0) for i in range(90)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0], 0.0) for i in range(100, 150)]
    bad = [(200, None, 0.0), (220, [0.0] * 6, 0.0), (240, [1.0, float("nan")] + [1.0] * 4, 0.0), (260, [1.0, None] + [1.0] * 4, 0.0), (280, [float("inf")] * 6, 0.0), (300, [1.0], 0.0), (None, [1.0] * 6, 0.0), (320, [], 0.0)]
    got = defaultdict(list)
    for x in ann.search(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    want = brute_search(rows, 20)
    assert {q: [(v, round(s, 9)) for _, v, s in g] for q, g in got.items()} == {q: [(v, round(s, 9)) for v, s in w] for q, w in want.items()}
    assert all([n for n, _, _ in g] == list(range(1, 21)) for g in got.values())
    assert ann.search(vectors(spark, bad), F.lit(True)).count() == 0  # one vector is left
    assert ann.search(vectors(spark, rows).limit(0), F.lit(True)).count() == 0


def test_search_counts_repeated_rows_once(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6).tolist(), 0.0) for i in range(60)]
    once, twice = (sorted(tuple(x) for x in ann.search(vectors(spark, t), F.col("vec_id") % 20 == 0).collect()) for t in (rows, rows + rows[:20] + rows[20:30] * 2))
    assert once == twice


def recall(got, ids, x, k=20):
    """The share of the true k best of every query that a result holds."""
    found, hits = defaultdict(set), 0
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    own = ids % 20 == 0
    for row, i in zip(x[own].astype(float) @ x.astype(float).T, ids[own]):
        row[ids == i] = -np.inf
        hits += len(set(ids[np.argsort(-row, kind="stable")[:k]].tolist()) & found[i])
    return hits / (k * own.sum())


def test_search_recall(spark):
    """Of the registered query, at sizes where no more than a twentieth of what a query looks into is scored exactly."""
    for d in ("/root/testdata/sf0.1", "/root/testdata/check_s"):
        e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id is not null and size(embedding) = 64").toPandas()
        x, ids = np.stack(e["embedding"]).astype(np.float32), e["vec_id"].to_numpy()
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        assert len(ids) >= 20 * ann.RERANK
        assert recall(ann.op8_inner_product_search(spark, d).collect(), ids[ok], x[ok]) >= 0.9


def test_search_looks_into_few_cells(spark):
    """Clustered vectors of different lengths: few cells are enough, and their number is measured."""
    r = np.random.default_rng(8)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 6000)] + 0.15 * r.normal(size=(6000, 16))).astype(np.float32)
    c = ann.coarse_centres(x, 24)
    assert len(c) == 24 and ann.probes(x, c, 20) <= 6 and ann.probes(x, c[:1], 20) == 1
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, cell=250).collect()
    assert recall(got, np.arange(6000), x) >= 0.9


def test_search_among_copies(spark):
    """A third of all rows is one vector: of it only the smallest ids are near, and every copy that asks gets its own."""
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=8).tolist(), 0.0) for i in range(400)] + [(i, [3.0] * 8, 0.0) for i in range(400, 600)]
    got = defaultdict(list)
    for x in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, cell=100).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert all(len(v) == 20 and q not in v for q, v in got.items()) and len(got) == 30
    assert got[400] == list(range(401, 421)) and got[500] == list(range(400, 420)) and got[420] == list(range(400, 420))


def test_leaks(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    texts = {r["doc_id"]: norm(r["text"]) for r in docs.collect()}
    clean = "nothing of this text was ever in any benchmark item " * 5
    w = items[3].split()
    loose = " ".join(x if i % 8 else "zzz" for i, x in enumerate(w))  # every eighth word replaced
    part = " ".join(w[: len(w) // 4])
    extra = [(10_000, clean + loose + " " + clean), (10_001, clean + items[5].upper() + clean), (10_002, clean + part + " " + clean), (10_003, None), (10_004, ""), (None, items[7]), (10_005, clean * 2000 + items[9] + " " + clean * 2000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("item_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {norm(x)} " in f" {t} "}
    assert want <= got and {(10_000, 3), (10_001, 5), (None, 7), (10_005, 9)} <= got
    assert not any(d in (10_002, 10_003, 10_004) for d, _ in got)
    assert len(got) <= len(want) + 8
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    """Edited items (replacements, insertions, drops) in documents' own prose: every start position of every document and
    item through the acceptance test finds what the index of rare words finds."""
    r = np.random.default_rng(12)
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(150).toPandas()[["doc_id", "text"]]
    pool = " ".join(t for t in docs["text"][:40] if t).split()
    rows = [(int(d), t) for d, t in docs.itertuples(index=False)]
    for k, item in enumerate(bench.orderBy("item_id").toPandas()["text"]):
        for j, (keep, insert) in enumerate([(0.75, 0.0), (0.85, 0.3), (0.8, 0.4), (0.65, 0.0)]):
            words = []
            for w in item.split():
                words.append(w if r.random() < keep else r.choice(pool))
                if r.random() < insert:
                    words.append(r.choice(pool))
            rows.append((10_000 + 10 * k + j, " ".join([*r.choice(pool, 30), *words, *r.choice(pool, 30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["coverage"] for x in decontaminate.leaks(df, bench).collect()}
    space, counts = decontaminate.latent_space(df)
    items = decontaminate.Items(bench.orderBy("item_id", "text").toPandas(), space, counts)
    want = {}
    for d, t in rows:
        words, _ = decontaminate.plain_words(pa.array([t]))
        for k, item in enumerate(items.ids):
            best = items.check(k, words, space)
            if best:
                want[d, int(item)] = best
    planted = [(10_000 + 10 * k + j, int(i)) for k, i in enumerate(items.ids) for j in range(4)]
    assert got == want and sum(p in got for p in planted[0::4]) >= 0.9 * len(items.ids)


def test_leaks_among_repeated_words(spark):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [r["text"] for r in bench.where("item_id < 20").orderBy("item_id").collect()]
    rows = [(i, "thenes " * 70 + t + " thenes" * 70) for i, t in enumerate(items)]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").where("doc_id >= 100").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).where("doc_id < 20").collect()}
    assert got == {(i, i) for i in range(len(items))}


def test_edited_leaks_at_every_offset(spark):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)))], "item_id long, text string")
    items = decontaminate.Items(bench.toPandas(), np.ones((decontaminate.FEATURES, 4), np.float32), np.ones(1 << decontaminate.FINE_BITS, np.int64))
    kept, length = [i for i in range(40) if i % 5 not in (1, 3)], int(items.passage[0])
    assert len(kept) == 24  # 60% of the words, and over one whole passage: no shorter or other one holds them
    text = ["filler"] * length
    for i, at in zip(kept, np.linspace(0, length - 1, len(kept)).astype(int)):
        text[at] = f"word{i}"
    rows = [(k, " ".join(["filler"] * k + text + ["filler"] * 50)) for k in range(30)]
    rows += [(100 + k, " ".join(["filler"] * k + text[:5] + ["filler"] + text[5:] + ["filler"] * 50)) for k in range(30)]
    got = {(r["doc_id"], r["coverage"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(k, 0.6) for k in range(30)}


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 30))], [r.randrange(6) for _ in range(r.randrange(0, 40))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert len(a) - decontaminate.lcs(masks, len(a), b).bit_count() == t[-1, -1]


def test_answers_decide(spark):
    bench = spark.createDataFrame([(1, "what is the colour of the clear sky at noon today", "deep azure"), (2, "", "x"), (None, "a b c", "d")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "what is the colour of the clear sky at noon today deep azure"), (2, "what is the colour of the clear sky at noon today who knows")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1)}


def test_answers_longer_than_the_question(spark):
    rows, texts = [], []
    for k, (q, a) in enumerate([(10, 20), (20, 60), (40, 120)]):
        question, answer = (" ".join(f"{kind}{k}x{i}" for i in range(n)) for kind, n in (("q", q), ("a", a)))
        rows.append((k, question, answer))
        texts += [(2 * k, f"{'other ' * 30}{question} {answer}{' other' * 30}"), (2 * k + 1, f"{'other ' * 30}{question}{' other' * 200} {answer}")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string, answer string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(2 * k, k) for k in range(3)}


def test_plain_words():
    a, at = decontaminate.plain_words(pa.array(["ÉTÉ, one--two", "été one two", None]))
    assert at.tolist() == [0, 3, 6, 6] and (a[:3] == a[3:]).all()
