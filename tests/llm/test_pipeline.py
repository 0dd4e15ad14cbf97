import importlib
import shutil

import duckdb
from test_jaccard import brute

import corpus_pipeline
from keystrata.llm import decontaminate, packing

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumnRenamed("n_chars", "score")  # a clashing name
    columns, rows = docs.columns, {"start": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = spark.createDataFrame(rows[list(rows)[-1]], docs.schema)
        out = stage(spark, before, DIR)
        assert out.columns == columns
        rows[name] = out.toPandas()
        assert set(rows[name]["doc_id"]) <= set(before.toPandas()["doc_id"])
    labels = duckdb.sql(f"SELECT doc_id FROM read_parquet('{DIR}/labels.parquet') WHERE quality = 1").df()["doc_id"]
    clean = set(labels) & set(rows["language_id"]["doc_id"])
    assert len(set(rows["language_id"]["doc_id"])) == len(rows["start"])  # all of these have a language
    assert len(clean & set(rows["quality"]["doc_id"])) >= 0.97 * len(clean)
    near = brute(list(zip(rows["quality"]["doc_id"], rows["quality"]["text"])))
    assert sorted(near[d][1] for d in rows["near_duplicates"]["doc_id"]) == sorted({c for _, c in near.values()})  # one of each group
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [norm(t) for t in duckdb.sql(f"SELECT text FROM read_parquet('{DIR}/benchmark.parquet')").df()["text"]]
    leaky = {d for d, t in zip(rows["near_duplicates"]["doc_id"], rows["near_duplicates"]["text"]) if any(i in norm(t) for i in items)}
    assert set(rows["decontamination"]["doc_id"]) == set(rows["near_duplicates"]["doc_id"]) - leaky
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows["decontamination"], docs.schema), DIR).toPandas()
    assert last["n_tokens"].sum() == sum(len(t.encode()) + 1 for t in rows["decontamination"]["text"])
    assert last.groupby("bin_id")["n_tokens"].sum().max() <= packing.CAPACITY


def test_odd_documents_pass_through(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("benchmark", "labels"):  # contents, not modes: the tables may be read-only
        shutil.copyfile(f"{DIR}/{name}.parquet", tmp_path / f"t/{name}.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (None, "the thing that was in the house and on the hill", "en", None, 1), (1, "x" * 300_000, "en", "src0", 5)], docs.schema)
    docs.unionByName(odd).unionByName(odd).write.parquet(f"{tmp_path}/t/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/t").toPandas()
    assert len(got) and not {10_000, 10_001} & set(got["doc_id"].dropna())
    docs.limit(0).write.parquet(f"{tmp_path}/t/none.parquet")
    empty = spark.read.parquet(f"{tmp_path}/t/none.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"{tmp_path}/t").count() == 0


def test_removal_goes_by_row(spark):
    """Null and shared ids: a leak without an id goes, a clean text that shares a copy's id stays, of equal rows one stays."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, f"{prose[0]} {item} {prose[1]}"), (None, prose[0]), (7, prose[1]), (7, prose[2]), (8, prose[2]), (9, prose[3]), (9, prose[3]), (10, ""), (10, "")]
    own = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], docs.schema)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, own, DIR).collect()]
    assert sorted(t for _, t in left) == sorted([*{t for _, t in rows}]) and (7, prose[1]) in left
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, own, DIR).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, rows[1:]))


def test_modules_of_the_pipeline():
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run and decontaminate.LCS > 0.5
