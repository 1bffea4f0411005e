"""The manifest against a plain recursive tree; the query itself is held against SQL in test_sql_ops."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from boreal.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc, text):
    return H(*map(field, doc[:4]), field(text))


def tree(level):
    """Root, and for each node of the level its (place, siblings) upward."""
    paths, of = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for k, at in enumerate(of):
            run = runs[at // 3]
            paths[k].append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
        of, level = [at // 3 for at in of], [H(*r) for r in runs]
    return level[0], paths


def brute(docs, now):
    """docs: (doc_id, source, lang, n_chars, text); now: text of each when it is verified."""
    rows = sorted(range(len(docs)), key=lambda k: (docs[k][1] is not None, (docs[k][1] or "").encode(), docs[k][0] is not None, docs[k][0] or 0, leaf(docs[k], docs[k][4])))
    per = {}
    for k in rows:
        per.setdefault(docs[k][1], []).append(k)
    low = {s: tree([leaf(docs[k], docs[k][4]) for k in ks]) for s, ks in per.items()}
    root, over = tree([low[s][0] for s in per])
    out = []
    for j, (s, ks) in enumerate(per.items()):
        for k, path in zip(ks, low[s][1], strict=True):
            path, cur = path + over[j], leaf(docs[k], now[k])
            for at, sib in path:
                cur = H(*sib[:at], cur, *sib[at:])
            out.append((docs[k][0], leaf(docs[k], docs[k][4]), low[s][0], root, H(*(x for _, sib in path for x in sib)), cur, cur == root))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, source string, lang string, n_chars long, text string, leaf string")


SETS = {
    "one row": [(1, "a", "en", 3, "x\ny")],
    "one source": [(k, "a", None, k, "t" * k) for k in range(7)],
    "nulls and ties": [(None, None, None, None, None), (None, None, None, None, None), (5, None, "", 0, ""), (4, "", "é", 1, "é\n"), (4, "", "é", 1, "other"), (4, "", "é", 1, "other"), (-3, "Z", None, None, "\n"), (10**15, "z", "en", None, "long " * 100_000 + "\n"), (3, "é", "en", 1, "-"), (2, "ä", "1:x", 1, "5:hello")],
    "a hot source": [(k, "hot" if k % 3 else f"s{k % 40}", "en", k, f"row {k}\n" * (k % 3)) for k in range(400)],
    "single rows": [(k, f"s{k:02}", "en", k, "a\n") for k in range(11)],
}


@pytest.mark.parametrize("name", SETS)
def test_equals_plain_tree(spark, name):
    docs = SETS[name]
    now = [t.replace("\n", "") if t and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t for i, _, _, _, t in docs]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = rows(merkle.manifest(frame(spark, docs).repartition(3), changed))
    assert got == brute(docs, now)
    assert any(not r[-1] for r in got) == (now != [d[4] for d in docs])


def test_paths_verify_single_rows(spark):
    """A row is checked with its path alone; any other text fails, and so does null."""
    docs = SETS["a hot source"]
    found = {r.doc_id: r for r in merkle.manifest(frame(spark, docs)).collect()}
    assert all(r.verified for r in found.values())
    for d in docs[::37]:
        path = [(p.place, tuple(p.siblings)) for p in found[d[0]].path]
        assert merkle.fold(leaf(d, d[4]), path) == found[d[0]].root
        assert merkle.fold(leaf(d, d[4] + " "), path) != found[d[0]].root and merkle.fold(leaf(d, None), path) != found[d[0]].root


def test_missing_children_are_an_error(spark):
    steps = merkle.Supersteps(spark)
    vertices = spark.sparkContext.parallelize([(0, k, 5, str(k), None, None) for k in (0, 1, 3, 4)], 2)
    with pytest.raises(Exception, match="lacks a child"):
        steps.climb(vertices, 2, 5, 1, "test")


def test_no_rows(spark):
    assert merkle.manifest(frame(spark, SETS["one row"]).limit(0)).count() == 0
