import hashlib

import numpy as np
import pytest

from boreal.llm import substring_dedup as sd
from boreal.llm.automaton import SuffixAutomaton
from boreal.llm.common import words

SF = "/root/testdata/sf0.01"


def brute(rows, n=13):
    first = {}
    split = [(k, words(t)) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, k), k)
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(sd.op7_substring_dedup(spark, SF)) == brute(rows)


@pytest.mark.parametrize("hot", [5000, 2])
def test_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    line, passage = say(14), say(60)
    rows = [(k, f"{say(20)} {line} {say(20)}") for k in range(12)] + [(20 + k, f"{say(9)}\n{passage}\t{say(5)}") for k in range(4)]
    rows += [(30, None), (31, ""), (32, say(12)), (33, "the " * 500), (34, "the " * 40), (35, rows[0][1]), (36, rows[0][1]), (36, rows[0][1]), (37, passage + " " + passage), (1, passage), (38, " ".join(passage.split()[:13]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS tk", "2 AS n_words")
    assert rows_of(sd.deduplicate(df)) == brute(rows)
    assert sd.deduplicate(df.limit(0)).count() == 0


def test_null_ids_and_long_texts(spark):
    """A row without an id is no reference, loses what the first document of its text loses, and stays whole where no row with an id has its text."""
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(5000)]
    passage, long = " ".join(rng.choice(vocab, 40)), " ".join(rng.choice(vocab, 120_000))
    rows = [(1, passage), (2, f"x {passage} y"), (3, f"{long} {passage}"), (None, f"z {passage}"), (None, passage)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in sd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 40, 0), (0, 41, 0), (1, 40, 0), (2, 42, 40), (3, 120_040, 40)]


def test_automaton():
    rng = np.random.default_rng(4)
    for _ in range(60):
        seqs = [rng.integers(0, 3, rng.integers(0, 14)).tolist() for _ in range(4)]
        a = SuffixAutomaton()
        for d, s in enumerate(seqs):
            a.add(s, d)
        query = rng.integers(0, 3, 20).tolist()
        want = [next((d for d, s in enumerate(seqs) if any(s[j : j + 4] == query[i : i + 4] for j in range(len(s) - 3))), None) for i in range(17)]
        assert a.windows(query, 4) == want


def test_segments_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    texts = [[b"w%d" % k for k in rng.integers(0, 9, n)] for n in (0, 3, 12, 13, 14, 200, 1, 13, 0, 77)]
    together = list(zip(*(x.tolist() for x in sd.segments(texts)), strict=True))
    alone = [(k, *row[1:]) for k, t in enumerate(texts) for row in zip(*(x.tolist() for x in sd.segments([t])), strict=True)]
    assert together == alone
    for k, t in enumerate(texts):
        assert sum(n for j, _, _, n in together if j == k) == max(0, len(t) - sd.WINDOW + 1)
    assert all(len(x) == 0 for x in sd.segments([]))
