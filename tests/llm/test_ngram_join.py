import numpy as np
import pytest

from boreal.llm import ngram_join
from boreal.llm.common import words
from boreal.llm.shingles import shingle_set

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.8):
    """doc_id -> (class_id, n_links), by comparing all pairs."""
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} if (w := words(t)) else set() for k, t in rows}
    ids, near, root = sorted(sets), {k: 0 for k in sets}, {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = {}
    for k in ids:
        for s in sets[k]:
            at.setdefault(s, []).append(k)
    pairs = {(a, b) for v in at.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            near[a] += 1
            near[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (find(k), near[k]) for k in ids}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(ngram_join.op2_ngram_join(spark, SF)) == brute(rows)


@pytest.mark.parametrize("limit", [200, 8])
def test_large_and_small_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(400)]
    base = list(rng.choice(vocab, 120))
    rows = []
    for k in range(60):  # near copies of one text, some further apart
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 120)] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    passage = " ".join(rng.choice(vocab, 30))
    rows += [(100 + k, passage + " " + " ".join(rng.choice(vocab, 60))) for k in range(40)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a  b"), (204, "a"), (205, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS class_id")
    assert result(ngram_join.similarity_join(df)) == brute(rows)


@pytest.mark.parametrize("words_of_own", [70, 25])
def test_one_passage_in_many_texts(spark, monkeypatch, words_of_own):
    """A bucket of thousands of sets at the shipped LIMIT. What shares a passage alone is split until it is small; no block compares all of it."""
    seen, compare = [], ngram_join.compare_blocks
    monkeypatch.setattr(ngram_join, "compare_blocks", lambda rows, sets, t: seen.append(rows.count()) or compare(rows, sets, t))
    rng = np.random.default_rng(9)
    vocab = [f"v{k}" for k in range(5000)]
    passage = list(rng.choice(vocab, 30))
    rows = [(k, " ".join([*passage, *rng.choice(vocab, words_of_own)])) for k in range(4000)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(0, 400, 7)] + [(9000, "a very long text " + " ".join(rng.choice(vocab, 60_000)))]
    got = result(ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    pair = {5000 + k: k for k in range(0, 400, 7)}
    want = {k: (k, 0) for k, _ in rows} | {a: (b, 1) for a, b in pair.items()} | {b: (b, 1) for b in pair.values()}
    assert got == want
    assert words_of_own < 50 or seen == [0]


def test_alike_buckets_are_compared_once():
    p = [np.array([1, 5, 9]), np.array([1, 9]), np.array([5, 9])]
    x, y = ngram_join.elsewhere(p, p[:2], 9)
    assert x.tolist() == [True, True, False] and y.tolist() == [True, True]
    assert not ngram_join.elsewhere(p, p, 1)[0].any()


def test_empty_and_runs(spark):
    assert ngram_join.similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert 0.79 < ngram_join.survival() < 0.8 and 1 - (1 - ngram_join.survival()) ** ngram_join.n_runs() >= ngram_join.RECALL


def test_sketch_estimates_similarity():
    w = [f"x{k}".encode() for k in range(3000)]
    a, b = shingle_set(w, 5), shingle_set(w[:2700], 5)
    x, y = (np.frombuffer(ngram_join.sketch(s), np.uint8) for s in (a, b))
    assert abs(((x == y) & (x > 0)).sum() / ((x | y) > 0).sum() - len(b) / len(a)) < 0.12


@pytest.mark.parametrize("piece", [10_000, 7])
def test_likeness_counts_pairs_without_rows_of_bins(spark, monkeypatch, piece):
    """The share of pairs whose sketches agree, over the bins that both fill, in every bucket; no row is made per set and bin."""
    monkeypatch.setattr(ngram_join, "PIECE", piece, raising=False)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, ngram_join.BINS, dtype=np.uint8)
    sketches = [np.where(rng.random(ngram_join.BINS) < 0.6, base, rng.integers(0, 4, ngram_join.BINS, dtype=np.uint8)).astype(np.uint8) for _ in range(50)]
    buckets = {-5: range(50), 6: range(20, 30), 7: [3, 4], 8: [50, 51]}  # the sketches of the last are empty
    sketches += [np.zeros(ngram_join.BINS, np.uint8)] * 2
    classes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sketches)], "key long, sketch binary")
    large = spark.createDataFrame([(p, k, len(v)) for p, v in buckets.items() for k in v], "path long, key long, size long")
    df = ngram_join.likeness(large, classes)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p, v in buckets.items():
        pairs = [(sketches[a][::4], sketches[b][::4]) for a in v for b in v if a < b]
        both = sum(int(((x > 0) & (y > 0)).sum()) for x, y in pairs)
        want[p] = sum(int(((x == y) & (x > 0)).sum()) for x, y in pairs) / both if both else 0.0
    assert {r.path: r.alike for r in df.collect()} == pytest.approx(want)


def test_verified_pairs_of_buckets(spark):
    """Pairs of two buckets by their shingles; a class without a set, as one without an id, is in no pair."""
    x, y = np.arange(1, 41, dtype=np.uint64) << np.uint64(16), np.arange(3, 43, dtype=np.uint64) << np.uint64(16)
    z = np.arange(30, 70, dtype=np.uint64) << np.uint64(16)
    sets = spark.createDataFrame([(k, bytearray(ngram_join.pack(s))) for k, s in ((1, x), (2, y), (3, z))], "key long, set binary")
    pairs = spark.createDataFrame([(7, 1, 2), (7, 1, 3), (7, 2, 3), (8, 1, 2), (8, 1, 9), (9, 4, 9)], "path long, a long, b long")
    assert [tuple(r) for r in ngram_join.verified(pairs, sets, 0.8).collect()] == [(1, 2), (1, 2)]
    assert ngram_join.verified(pairs.limit(0), sets, 0.8).count() == 0


def test_overlaps_hold_a_slice_at_a_time(monkeypatch):
    """Numbering two blocks' shingles takes memory for a slice of them, whatever their number; the counts stay."""
    import tracemalloc

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**48, 24_000, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(24_000) < 0.1, rng.integers(0, 2**48, 24_000, dtype=np.uint64), base)) for _ in range(60)] + [np.array([base[0]]), np.array([0, 2**48 - 1], np.uint64)]
    monkeypatch.setattr(ngram_join, "SLICE", 50_000, raising=False)
    tracemalloc.start()
    got = ngram_join.overlaps(sets[:31], sets[31:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[31:]] for a in sets[:31]]
    assert peak < 2 * sum(s.nbytes for s in sets)
    assert ngram_join.overlaps([sets[0]], [np.empty(0, np.uint64)]).tolist() == [[0]]


def test_steps_send_small_batches(spark, monkeypatch):
    """Every step of the join gets Arrow batches of a few MB, and the session's own size comes back, after a failure too."""
    name, seen, keep = "spark.sql.execution.arrow.maxBytesPerBatch", [], ngram_join.Stages.keep
    before = spark.conf.get(name)
    monkeypatch.setattr(ngram_join.Stages, "keep", lambda self, df, step: seen.append(int(spark.conf.get(name).rstrip("b"))) or keep(self, df, step))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert result(ngram_join.similarity_join(df)) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert len(seen) > 5 and max(seen) <= 8_000_000 and spark.conf.get(name) == before
    with pytest.raises(ValueError):
        ngram_join.similarity_join(df, recall=1.0)
    assert spark.conf.get(name) == before
