import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from boreal.llm import langid
from tests.llm.test_ngram_join import brute as links
from tests.llm.test_substring_dedup import brute as passages

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34", None, None, 5), (9003, "", None, None, 0)], docs.schema)).withColumn("key", docs["lang"])
    made = []
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF).cache()
        made.append(out.collect())
        docs = out
    one, two, three, four, five = made
    assert all(list(x[0].asDict()) == list(corpus_pipeline.COLUMNS) for x in made[:4])
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in one} == {k for k, t in raw.items() if len(langid.grams(t))}  # clean documents stay
    best = links([(r.doc_id, r.text) for r in one])
    assert {r.doc_id for r in two} == {k for k, (c, _) in best.items() if c == k} and len(two) < len(one)
    left = {k: (n, gone, sha) for k, n, gone, sha in passages([(r.doc_id, r.text) for r in two])}
    assert {r.doc_id: hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for r in three} == {k: v[2] for k, v in left.items() if not v[1] or v[1] < v[0]}
    sizes, total, taken = Counter(), Counter(), Counter()
    for r in three:
        sizes[r.doc_id] = len(r.text.split())
        total[r.source] += sizes[r.doc_id]
    for r in four:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - sum(total.values())) < 0.05 * sum(total.values())
    assert all(n <= 3 * sizes[k] for k, n in Counter({k: sum(len(r.text.split()) for r in four if r.doc_id == k) for k in sizes}).items())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in five) == Counter((r.doc_id, tuple(t.encode(r.text, add_special_tokens=False).ids)) for r in four)
    assert Counter(r.decoded_sha256 for r in five) == Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in four)


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_a_row_of_each_group(spark):
    """Whether ids collide or are null."""
    import random

    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(3, b + " end"), (7, "zz " + a), (7, b), (None, c), (None, c + " more"), (None, d), (9, d + " last"), (11, "short"), (11, "brief")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert Counter(k for k, _ in got) == {3: 1, 7: 1, None: 1, 9: 1, 11: 2}
    assert (7, "zz " + a) in got and (3, b + " end") in got and (9, d + " last") in got
    assert {t for k, t in got if k is None} <= {c, c + " more"}
