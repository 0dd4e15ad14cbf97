import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import langid, licenses, quality

DIR = "/root/testdata/sf0.01"


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    m = langid.Gru(3, hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = r.integers(97, 110, (6, 5)), r.integers(0, 3, 5)
    mask = (np.arange(6)[:, None] < np.array([6, 6, 3, 1, 5])).astype(np.float64)
    _, g = m.gradients(x, mask, y)
    for k, at in (("v", (0, 1)), ("c", (1, 0)), ("u0", (9, 2)), ("u1", (1, 1)), ("w0", (8, int(x[0, 0]))), ("w1", (2, int(x[1, 1])))):
        old = m.p[k][at]
        losses = []
        for d in (1e-3, -1e-3):
            m.p[k][at] = old + d
            losses.append(m.gradients(x, mask, y)[0])
        m.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 2e-3


def test_fast_prediction_equals_the_training_network():
    r = np.random.default_rng(0)
    m = langid.Gru(3)
    x, sizes = r.integers(97, 123, (20, 7)).astype(np.uint8), np.array([20, 20, 3, 20, 11, 1, 20])
    x[np.arange(20)[:, None] >= sizes] = 0
    mask = (np.arange(20)[:, None] < sizes).astype(np.float32)
    f, b = m._forward(x, 0, mask), m._forward(x[::-1], 1, mask[::-1])
    want = np.zeros((3, 7))
    for t in range(20):
        e = np.exp(m.p["v"] @ np.concatenate([f["out"][t], b["out"][19 - t]]) + m.p["c"])
        want += e / e.sum(axis=0) * (sizes > t)
    assert np.allclose(m.position_sums(x, sizes), want, atol=1e-4)


def test_labels_against_one_network_pass_a_text():
    """Windows, batches and pooling: each text's windows one by one through the training network."""
    r = np.random.default_rng(2)
    m = langid.Gru(3)
    texts = ["", None, "a", "é" * 100, "12 34"] + ["".join(r.choice(list("abc déf\n"), int(n))) for n in r.integers(1, 700, 30)]
    lang, score = langid._label(m, ["x", "y", "z"], pa.array(texts))
    for t, got, s in zip(texts, lang, score):
        raw = langid.LOWER[np.frombuffer((t or "").encode(), np.uint8)]
        if not any(c.isalpha() for c in t or ""):
            assert (got, s) == ("und", 0)
            continue
        total = np.zeros(3)
        for k in range(0, len(raw), langid.WINDOW):
            x = raw[k : k + langid.WINDOW][:, None]
            one = np.ones_like(x, np.float32)
            f, b = m._forward(x, 0, one)["out"], m._forward(x[::-1], 1, one)["out"][::-1]
            for p, q in zip(f, b):
                e = np.exp(m.p["v"] @ np.concatenate([p, q]) + m.p["c"])[:, 0]
                total += e / e.sum()
        assert abs(s - total.max() / len(raw)) < 1e-4 and got in ("x", "y", "z") and total["xyz".index(got)] > total.max() - 1e-3


def test_sample_of_a_hot_language(spark):
    """No window over a language; a hot row counts once, and every language is learnt."""
    rows = [(1, "ab cd ef " * 9, "one")] * 4000 + [(i, f"gh ij kl {i} " * 9, "one") for i in range(300)] + [(999, "mn op " * 20, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, classes = langid.train(df, sample=50)
    assert classes == ["one", "two"]
    assert [x["lang_pred"] for x in langid.predict(df.where("doc_id = 999"), model, classes).collect()] == ["two"]


def test_languages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model, classes = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs, model, classes).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !? 34", 1), (None, "the thing", 1), (5, "漢字", 1), (6, "the " * 200_000, 1)], "doc_id long, text string, score int")
    rows = {r["doc_id"]: r for r in langid.predict(odd, model, classes).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert rows[None]["lang_pred"] in classes and rows[5]["lang_pred"] in classes and 0 <= rows[6]["score"] <= 1
    kept = langid.identified(odd, model, classes, 0.0)
    assert kept.columns == odd.columns and kept.count() == 3
    assert langid.train(docs.limit(0)) == (None, [])
    assert {r["lang_pred"] for r in langid.predict(odd, None, []).collect()} == {"und"}


def test_predictions_over_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score double")
    for model, classes in ((None, []), (langid.Gru(2), ["a", "b"])):
        assert langid.predict(docs, model, classes).collect() == []
    assert quality.score(docs, (0.5, [])).collect() == []


def test_statistics_by_hand():
    x = quality.statistics(pa.array([None, "", "a", "Ab!! cd|\nAb!! cd|\n\nx x x 12", "wörd"]))
    s = {n: x[:, i] for i, n in enumerate(quality.STATISTICS)}
    assert s["bytes"].tolist() == [0, 0, 1, 27, 5] and s["words"].tolist() == [0, 0, 1, 8, 1]
    assert s["lines"].tolist() == [0, 0, 1, 3, 1] and np.allclose(s["repeated_lines"], [0, 0, 0, 1 / 3, 0])
    assert np.allclose(s["distinct"], [0, 0, 1, 4 / 8, 1]) and np.allclose(s["top_word"], [0, 0, 1, 3 / 8, 1])
    assert np.allclose(s["twice"], [0, 0, 0, 2 / 8, 0]) and np.allclose(s["exclaims"][3], 4 / 27) and np.allclose(s["digits"][3], 2 / 27)
    assert np.allclose(s["upper"][3], 2 / 11) and s["wide"][4] == 2 / 5


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), labels.where(~quality.held_out(F.col("doc_id"))))
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    assert got.agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    rows = quality.with_statistics(docs).limit(50).toPandas()
    by_hand = 1 / (1 + np.exp(-(model[0] + quality.holds([r for r, _ in model[1]], rows[list(quality.STATISTICS)].to_numpy()) @ np.array([w for _, w in model[1]]))))
    spark_scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.allclose([spark_scores[i] for i in rows["doc_id"]], by_hand)
    odd = spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "x " * 100_000, 1)], "doc_id long, text string, statistics int")
    assert quality.score(odd, model).count() == 3 and quality.accepted(odd, model, 0.0).columns == odd.columns
    assert quality.accepted(odd, model, 0.0).count() == 3
    b, rules = quality.train(docs.select("doc_id", "text"), labels.limit(0))
    assert rules == [] and abs(b) < 1e-9
    with_null = labels.limit(5).unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, label int"))
    assert quality.score(docs.limit(3), quality.train(docs.select("doc_id", "text"), with_null)).count() == 3


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b)))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found(spark, name):
    texts = licenses.TEMPLATES[name]
    rows = [(i, f"Some line of prose here.\n{t}\nAnother line.") for i, t in enumerate(texts)] + [(9, "\n\n".join(["intro of it\nall", texts[-1].replace(". ", ".\n"), "end"]))]
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: name for i in got} and set(range(len(texts))) <= set(got)
    assert all(got[i][1] == 1.0 for i in range(len(texts)))
    if len(texts[-1].replace(". ", ".\n").split("\n")) > 1:
        assert 9 in got


def test_near_and_far_licences(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0, today."), (2, "Licensed under nothing at all."), (3, None), (4, ""), (5, "released UNDER   the mit-license"), (5, "released UNDER   the mit-license"), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["license"]): (r["n_units"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a = licenses._bigrams(rows[0][1])
    assert got == {(1, "Apache-2.0"): (1, round(dice(a, licenses._bigrams(licenses.TEMPLATES["Apache-2.0"][0])), 6)), (5, "MIT"): (2, 1.0), (None, "MIT"): (1, 1.0)}


def test_licences_in_their_usual_layout(spark):
    conditions = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.

    2. Redistributions in binary form must reproduce the above copyright
       notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution.
"""
    third = """
    3. Neither the name of the copyright holder nor the names of its
       contributors may be used to endorse or promote products derived from
       this software without specific prior written permission.
"""
    disclaimer = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    gpl2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"
    prose = "some code and prose of other kinds\nthat goes on for a while\n" * 30
    head = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n"
    comment = "#!/bin/sh\n# Copyright 2020 Somebody\n#\n" + "".join(f"# {x}".rstrip() + "\n" for x in apache.splitlines()) + "#\nset -e\n"
    texts = [head + conditions + disclaimer, head + conditions + third + disclaimer, prose + "\n" + conditions + third + disclaimer + "\n" + prose, f"{prose}\n{apache}\n{prose}", f"{prose}\n{gpl2}\n{prose}", f"{title}\n{prose}"]
    texts += [f"{prose}\n{comment}{prose}", f"{prose}\n{head}{conditions}{disclaimer}\n{prose}"]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, "BSD-2-Clause"), (1, "BSD-3-Clause"), (2, "BSD-3-Clause"), (3, "Apache-2.0"), (4, "GPL-2.0"), (5, "GPL-3.0"), (6, "Apache-2.0"), (7, "BSD-2-Clause")}


def test_licences_in_odd_texts(spark):
    notice = "Released under the MIT License."
    rows = [(1, "word " * 400_000 + "\n" + notice + "\n" + "other words\n\n" * 5_000), (2, "\n" * 100_000), (3, "x" * 2_000_000), (4, f"{notice}\n\n{notice}\n{notice}"), (4, None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, license string, dice int")
    got = {r["doc_id"]: (r["license"], r["n_units"], r["dice"]) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", 1, 1.0), 4: ("MIT", 1, 1.0)}  # of 4 the whole text has the same bigrams and one more
    assert licenses.scan(df.limit(0)).count() == 0
    own = {"House": ["You may read this text at home but not in the garden.", "one"]}
    text = "you may read this text at home, but not in the Garden"
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame([(1, text), (2, notice)], "doc_id long, text string"), own).collect()] == [(1, "House")]


def test_no_match_is_lost_by_the_filters(spark):
    """Random edits of templates among other lines: what plain Dice over all units finds is what the scan finds."""
    r, known = np.random.default_rng(5), licenses.templates()
    rows = []
    for i in range(120):
        name, texts = list(licenses.TEMPLATES.items())[i % len(licenses.TEMPLATES)]
        words = texts[i % len(texts)].split()
        words = [w if r.random() > 0.06 else "zzz" for w in words if r.random() > 0.05]
        rows.append((i, "some prose under the public version of it\n" + " ".join(words) + "\nand more of the software"))
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        lines = t.split("\n")
        best = {}
        for k, u in enumerate([*lines, t]):
            a = licenses._bigrams(u)
            scores = [(-round(dice(a, b), 6), n) for n, b in known if a]
            if min(scores)[0] <= -0.8:
                best[k] = min(scores)[1]
        own = {n for k, n in best.items() if k == len(lines) or len(lines) not in best}
        want |= {(i, n) for n in own}
    assert got == want and len(want) > 60
