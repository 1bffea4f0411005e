"""URL filters, mixing and quality rules against DuckDB SQL on whole tables, and their edge cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from boreal.llm import mixing, quality, url_filter
from boreal.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_whole_table_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_mix_levels_equal_sql(spark):
    """The smallest table has sources of under a hundred blocks: several levels."""
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    df, rel = mixing.op5_mix(spark, "/root/testdata/sf0.001"), con.sql(mixing.OP5_SQL)
    got = rows(df.columns, map(tuple, df.collect()))
    assert got == rows(rel.columns, rel.fetchall())
    shares = spark.createDataFrame([(float(t),) for t in (9_000, 6_399, 6_000, 300, 70, 5)], "target double")
    assert [(least, upto, block) for least, upto, _, block in mixing.levels(shares)] == [(6_400.0, float("inf"), 64), (3_200.0, 6_400.0, 32), (200.0, 3_200.0, 2), (0.0, 200.0, 1)]
    assert mixing.levels(shares.limit(0)) == []


def test_mix_of_many_small_sources(spark, monkeypatch):
    """Every level holds a source, however many small ones there are and however long blocks of the whole corpus would be."""
    monkeypatch.setattr(mixing, "block_words", lambda total: max(64, min(65_536, total >> 8)))
    shares = spark.range(80_000).select((F.lit(4_000.0) * F.element_at(F.array(F.lit(1.9), F.lit(0.75), F.lit(0.37)), (F.col("id") % 3 + 1).cast("int"))).alias("target"))
    found = mixing.levels(shares)
    assert sum(h for _, _, h, _ in found) == round(shares.agg(F.sum("target")).first()[0]) and all(b >= a > 0 for (_, _, _, b), (_, _, _, a) in zip(found, found[1:]))
    docs = [(k, "large", "w " * 1_000) for k in range(200)] + [(1_000 + 10 * k + j, f"s{k:03}", "w " * (2 + k % 40)) for k in range(300) for j in range(2)]
    placed, parts = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    per = placed.groupBy("source").agg(F.first("target").alias("target"), F.first("ordinal").alias("o"))
    got = per.join(parts.groupBy("ordinal").agg(F.sum(F.col("end") - F.col("first")).alias("n")), F.col("o") == F.col("ordinal"), "left").na.fill(0).collect()
    assert len(got) == 301 and all(r.n > 0 and abs(r.n - r.target) <= max(0.03 * r.target, 5) for r in got), [r for r in got if abs(r.n - r.target) > max(0.03 * r.target, 5)]


def test_url_edges(spark):
    urls = [None, "", "no scheme/x", "http://ORG/a", "http://org", "http://a.org?x=/y", "https://x.Example.org/es/1#f", "http://example.org/en/12", "http://notexample.org/en/12", "ftp://u@Example.ORG:80/en/1", "x://com/fr/", "x://b.com/de/z", "x://b.com/de/z", "://a.com/fr/y", "http://é.com/fr/", "h://" + "a." * 3000 + "com/de/" + "b" * 5000, "h://example.org./es/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.rule_table(spark)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end : min([rest.index(c, end) for c in "?#" if c in rest[end:]] or [len(rest)])]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, *best[1:]), u
    assert url_filter.judge(df, url_filter.rule_table(spark, ())).filter("verdict <> 'allow'").count() == 0
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_many_rule_shapes(spark):
    """Any number of label counts and path lengths; candidates of a short prefix are confirmed by their digests."""
    rules = [("block", f"h{k}.net", "/" + "p" * k) for k in range(600)] + [("allow", "x." * k + "org", "/") for k in range(1, 60)]
    urls = [f"http://a.h{k}.net/{'p' * (k + d)}" for k in range(0, 600, 37) for d in (-1, 0, 1)] + ["http://" + "x." * k + "org/y" for k in (0, 1, 30, 59, 80)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://h0.net/")], "page_id long, url string")
    listed = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "verdict string, host string, path string, rule string")
    for size in (1, 4):
        got = {r.url: (r.rule, r.verdict) for r in url_filter.judge(df, listed, prefix_bytes=size).collect()}
        for u in urls:
            host, path = u[7:].split("/", 1)
            fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
            assert got[u] == max(fits, default=(0, None, "allow"))[1:], u
    assert got["http://h0.net/"] == ("h0.net/", "block")


def test_small_sources_have_finer_blocks(spark, monkeypatch):
    """With blocks of a large corpus, sources of a few blocks come as near their target as in a small one."""
    monkeypatch.setattr(mixing, "block_words", lambda total: max(64, min(65_536, total >> 8)))
    docs = [(k, "big", "w " * 997) for k in range(400)] + [(1000 + k, "mid", "w " * 301) for k in range(40)] + [(2000 + k, f"tail{k % 3}", "w " * 50) for k in range(90)]
    placed, parts = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    shares = placed.groupBy("source").agg(F.first("target").alias("target"), F.first("ordinal").alias("o"))
    got = shares.join(parts.groupBy("ordinal").agg(F.sum(F.col("end") - F.col("first")).alias("n")), F.col("o") == F.col("ordinal"), "left").na.fill(0).collect()
    assert len(mixing.levels(shares)) > 1
    assert all(abs(r.n - r.target) <= max(0.02 * r.target, 256) for r in got), got


def test_mix_edges(spark):
    long = "w " * 20_000
    docs = [(k, f"s{k % 3}", "a b c " * (10 + k % 7)) for k in range(300)] + [(400, None, "x y"), (401, None, None), (402, "s1", ""), (403, "s2", long), (404, "big", long), (1, "s1", "again again"), (1, "s1", "again again"), (None, "s0", "null id")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("start", F.lit("clash"))
    placed, parts = mixing.mix(df)
    taken = parts.groupBy(F.col("ordinal").alias("o"), F.col("start").alias("p")).agg(F.sum(F.col("end") - F.col("first")).alias("n"))
    out = placed.join(taken, (F.col("ordinal") == F.col("o")) & (F.col("start") == F.col("p")) & (F.col("size") > 0), "left").na.fill(0, ["n"]).collect()
    assert len(out) == len(docs) and all(0 <= r.n <= 3 * r["size"] for r in out)
    total, per = sum(r["size"] for r in out), {}
    for r in out:
        t = per.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.n
    assert abs(sum(t for _, t, _ in per.values()) - total) < 1e-6 * total and per[None][1] == 6
    assert all(t <= 3 * s for _, t, s in per.values()) and all(abs(n - t) <= max(0.03 * t, 300) for n, t, _ in per.values())
    mixed = mixing.mixed(df.withColumn("lang", F.lit("en")))
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.n for r in out)
    assert mixing.mixed(df.withColumn("lang", F.lit("en")).limit(0)).count() == 0


def test_cascade(spark):
    texts = [None, "", "a " * 60, " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}##%" for k in range(80)), "\n".join(["same line of text here"] * 5 + [f"u{k} v{k} w{k}" for k in range(40)])]
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)] * 2, "doc_id long, text string, kept boolean").withColumn("n", F.lit(1)).withColumn("n_words", F.lit("clash"))
    for order in (list(quality.RULES), list(quality.RULES)[::-1], quality.order_rules(texts)):
        got = {r.doc_id: r.kept for r in quality.cascade(df, order).collect()}
        assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: True}
    odd = spark.createDataFrame([(None, "w " * 200_000), (None, None)], "doc_id long, text string")
    assert [(r.n_words, r.kept) for r in quality.cascade(odd, list(quality.RULES), measure_all=True).collect()] == [(200_000, False), (0, False)]
    m = quality.Measures("a b c a b c d")
    assert (m.n_words, m.n_repeat_words, m.word_chars, m.n_dup_lines) == (7, 6, 7, 0)
    assert quality.Measures("x\n\nx\n \ny").n_dup_lines == 1
    rare = {"cheap": lambda m: len(m.text) > 3, "dear": lambda m: len([w for w in m.words for _ in range(2000)]) < 0}
    assert quality.order_rules(["abcd e f g" * 30] * 20, rare) == ["cheap", "dear"]
    assert quality.cascade(df.limit(0), list(quality.RULES)).count() == 0


def test_dear_rules_and_what_the_order_saves(spark):
    """Rules over longer windows reject what the base rules let pass; with many rejections the learned order takes less time than its reverse, and verdicts are the same."""
    import random
    import time

    rng = random.Random(1)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(30)
    assert quality.first_rejection(quality.Measures(" ".join(fresh(60) + passage + fresh(10) + passage)), list(quality.RULES)) in ("repeats_6_words", "repeats_10_words")
    assert quality.first_rejection(quality.Measures(" ".join(x for k in range(40) for x in ["the", "same", *fresh(2 + k % 3)])), list(quality.RULES)) == "top_2_words"
    assert quality.first_rejection(quality.Measures(" ".join(fresh(400))), list(quality.RULES)) is None
    for n in (2, 3, 6, 10):
        ws = [f"v{rng.randrange(4)}" for _ in range(60)]
        grams = [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
        m = quality.Measures(" ".join(ws))
        assert m.top(n) == max(map(grams.count, grams))
        assert m.repeated(n) == len({k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(n)})
    texts = [" ".join(fresh(3_000)) + " #" * (2_000 if k % 4 else 0) for k in range(60)]
    order = quality.order_rules(texts)
    took = []
    for o in (order, order[::-1]):
        began = time.perf_counter()
        verdicts = [quality.first_rejection(quality.Measures(t), o) is None for t in texts]
        took.append(time.perf_counter() - began)
        assert verdicts == [k % 4 == 0 for k in range(60)]
    assert order[0] == "symbols" and took[0] < 0.7 * took[1]
