import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreal.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(3)
    rows = [sorted(np.flatnonzero(rng.random(6) < 0.5).tolist()) for _ in range(4000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    y_xor = np.array([float((0 in r) != (1 in r)) for r in rows])  # no additive weights tell these apart
    for want in (y, y_xor):
        m = toxicity.fit(list(range(6)), rows, want)
        assert np.mean((m.score(rows) > 0.5) == want) > 0.97


def pairs(spark, want):
    rng, vocab = np.random.default_rng(6), [f"f{k}x" for k in range(200)]
    rows = []
    for k in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((k, " ".join(["aa"] * a + ["bb"] * b + list(rng.choice(vocab, 6))), int(want(a, b))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.drop("toxic"), docs.select("doc_id", "toxic")


@pytest.mark.parametrize("name", ["xor", "and"])
def test_pairs_reach_the_machine(spark, name):
    """Labels that depend on a pair, words that tell nothing alone among them: learned from texts, and better than the additive model of the same inputs."""
    docs, labels = pairs(spark, (lambda a, b: a != b) if name == "xor" else (lambda a, b: a and b))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    right = {}
    for factors in (toxicity.FACTORS, 0):
        got = toxicity.predict(docs, toxicity.learn(docs, labels, factors=factors)).filter((F.crc32(F.col("doc_id").cast("string")) % 4) == 2).collect()
        right[factors] = -np.mean([np.log(np.clip(r.score if truth[r.doc_id] else 1 - r.score, 1e-9, 1)) for r in got])
        share = np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got])
        if factors:
            assert share > 0.95
    print(name, right)
    assert right[toxicity.FACTORS] < 0.7 * right[0]


def test_whole_table_equals_double_loop(spark):
    """Scores of every document of the smallest table by sums over single terms and over pairs, from the texts."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        found = set()
        for w in re.findall(r"[^\W\d_]+", r.text.lower()):
            found |= {zlib.crc32(w.encode()) % 2**18, zlib.crc32(b"^" + w[:5].encode()) % 2**18}
        x = [m.chosen[b] for b in sorted(found) if b in m.chosen]
        raw = m.w0 + sum(m.w[i] for i in x) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(x) for j in x[k + 1 :])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_scores_equal_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine({}, -1.0, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = [0, 3, 4, 8]
    want = -1 + m.w[x].sum() + sum(m.v[a] @ m.v[b] for k, a in enumerate(x) for b in x[k + 1 :])
    assert abs(m.raw([x])[0] - want) < 1e-9 and m.raw([[]])[0] == -1


def test_held_out(spark):
    got = toxicity.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    t, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    rank = np.argsort(np.argsort(s))
    auc = (rank[t == 1].sum() - (t == 1).sum() * ((t == 1).sum() - 1) / 2) / ((t == 1).sum() * (t == 0).sum())
    precision, recall = t[got["predicted"] == 1].mean(), got["predicted"][t == 1].mean()
    print("auc", auc, "precision", precision, "recall", recall)
    assert auc > 0.75 and precision > 0.8 and recall > 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "so bad", "a"), (3, "so bad", "a"), (None, "long " * 50_000, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.predict(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 5 and all(r.score < 1e-6 for r in got)
    assert toxicity.predict(docs.limit(0), toxicity.learn(docs, labels)).count() == 0
