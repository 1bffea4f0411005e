import numpy as np

from boreal.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = langid.op8_language_id(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, prob = langid.learned_from(docs)
    one = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 2500 AND 4000").groupBy("lang").agg({"text": "min"}).toDF("lang", "text").collect()}
    mixed = one["de"][:2500] + " " + one["fr"][:1500]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, mixed), (5, mixed), (6, one["en"] * 40), (None, "x")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score"), langs, prob).collect()}
    assert None in got and [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    shares = dict(x.split(":") for x in got[4].languages.split(","))
    assert set(shares) == {"de", "fr"} and 0.5 < float(shares["de"]) < 0.75 and got[4].lang_pred == "de"
    assert got[4][1:] == got[5][1:] and got[6].lang_pred == "en"
    assert langid.predict(docs.limit(0), langs, prob).count() == 0
    assert langid.learn(docs.limit(0))[0] == []


def test_em_beats_grid():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 2).T
    n = rng.multinomial(3000, 0.3 * p[:, 0] + 0.7 * p[:, 1]).astype(float)
    share, best = langid.proportions(p, n, np.array([0.5, 0.5]))
    grid = [float(n @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0.001, 0.999, 999)]
    assert best >= max(grid) - 1e-2 and abs(share[0] - 0.3) < 0.05


def slow(texts, langs, prob):
    """The mixture by plain loops over trigrams."""
    out = []
    for text in texts:
        g = langid.grams(text).tolist()
        if not g:
            out.append(("und", 0.0))
            continue
        ll = lambda share: sum(np.log(sum(s * prob[b, k] for k, s in share.items())) for b in g)
        best = max(range(len(langs)), key=lambda k: ll({k: 1.0}))
        share, like = {best: 1.0}, ll({best: 1.0})
        while len(share) < len(langs):
            rise = {k: sum(prob[b, k] / sum(s * prob[b, j] for j, s in share.items()) for b in g) - len(g) for k in range(len(langs)) if k not in share}
            k = max(sorted(rise), key=rise.get)
            new = {j: 0.8 * s for j, s in share.items()} | {k: 0.2}
            for _ in range(langid.STEPS):
                old, new = new, {j: 0.0 for j in new}
                for b in g:
                    total = sum(s * prob[b, j] for j, s in old.items())
                    for j, s in old.items():
                        new[j] += s * prob[b, j] / total / len(g)
                if max(abs(new[j] - old[j]) for j in new) < langid.ENOUGH:
                    break
            if rise[k] <= langid.PENALTY * np.log(len(g) + 1) or ll(new) - like <= langid.PENALTY * np.log(len(g) + 1):
                break
            share, like = new, ll(new)
        top = max(sorted(share), key=share.get)
        out.append((langs[top], min(1.0, share[top])))
    return out


def test_whole_table_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, prob = langid.learned_from(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op8_language_id(spark, sf).collect()}
    assert set(got) == set(rows)
    for (k, text), (lang, score) in zip(rows.items(), slow(rows.values(), langs, prob), strict=True):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-6, text


def test_any_number_of_languages(spark, monkeypatch):
    """A slice of two languages at a time gives what all at once give, and a dirty column of hundreds of values does not fail."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    whole = {r.doc_id: r for r in langid.predict(docs.drop("lang"), *langid.learn(docs)).collect()}
    monkeypatch.setattr(langid, "SLICE", 2)
    langs, files = langid.learn(docs)
    assert len(files) == -(-len(langs) // 2)
    cut = {r.doc_id: r for r in langid.predict(docs.drop("lang"), langs, files).collect()}
    assert cut == whole
    monkeypatch.setattr(langid, "SLICE", 64)
    dirty = docs.selectExpr("doc_id", "text", "concat(lang, doc_id) AS lang").limit(150)
    assert langid.predict(dirty, *langid.learn(dirty)).count() == 150
