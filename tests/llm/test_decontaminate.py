"""Decontamination against a window-by-window comparison of whole texts; the query itself is held against SQL in test_sql_ops."""

import hashlib
import re

import pytest

from boreal.llm import decontaminate as D

ITEMS = [(7, "One two three four five six seven eight nine ten eleven"), (8, "short item"), (10, "Ünï — wörd x"), (9, None), (11, "..."), (None, "hidden answer key"), (7, "second text under seven"), (12, "short ITEM"), (13, " ".join(f"t{k % 7}" for k in range(40)))]
TEXTS = [
    None, "", "!!! \n", "one two three four five six seven eight nine ten", "zero ONE two-three_four,five six seven\neight nine ten eleven twelve", "a short item, short item! short", "Ünï — wörd X tail", "this hidden  answer key here",
    "one two three four five six seven eight nine", "\x7fsecond\x00text under seven", " ".join(f"t{k % 7}" for k in range(200)), "clean words only " * 3000 + "short item", "x" * 300_000 + " short item", "short item", "short item",
]


def normal(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(texts, items, n=10):
    windows = {}
    for name, text in items:
        ws = [w for _, _, w in normal(text)]
        m = min(n, len(ws))
        for k in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[k : k + m]), set()).update([] if name is None else [str(name)])
    out = []
    for text in texts:
        ws = [w for _, _, w in normal(text)]
        hit, found = set(), set()
        for m in {len(w) for w in windows}:
            for k in range(len(ws) - m + 1):
                if (names := windows.get(tuple(ws[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= names
        out.append((len(ws), hit, sorted(found)))
    return out


def frames(spark):
    docs = spark.createDataFrame([(None if k == 3 else k % 13, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, items string").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize(("n", "size"), [(10, 8_000_000), (10, 30), (3, 60)])
def test_equals_brute_force(spark, monkeypatch, n, size):
    """One slice or many, with pieces of a few words, and a written table between the scans."""
    if size < 100:
        monkeypatch.setattr(D, "PIECE", 25)
    monkeypatch.setattr(D, "BATCH", 5_000)
    docs, items = frames(spark)
    want = sorted((t or "", w, tuple(sorted(hit)), tuple(found)) for t, (w, hit, found) in zip(TEXTS, brute(TEXTS, ITEMS, n), strict=True))
    rows = D.contaminated(docs, items, n, size).collect()
    assert sorted((r.text or "", r.n_words, tuple(k for s in r.spans for k in range(s["first"], s["end"])), tuple(r["items"])) for r in rows) == want


def test_collisions_hit_nothing(spark, monkeypatch):
    """All hashes equal: every hit is verified by its words."""
    import numpy as np

    monkeypatch.setattr(D, "window_keys", lambda h, n: np.full(max(len(h) - n + 1, 0), 5, np.uint64))
    tests = D.TestSet([("1", b"a b c"), ("2", b"b c d"), (None, b"c d e")], 3)
    text = b"x a b c d"
    start, end = D.word_bounds(np.frombuffer(text, np.uint8), np.array([0]))
    got = list(tests.hits(text, D.word_keys(np.frombuffer(text, np.uint8), start, end), start, end, np.zeros(5, int)))
    assert got == [(1, 3, ("1",)), (2, 3, ("2",))]


def test_removal(spark):
    docs, items = frames(spark)
    found = D.contaminated(docs, items)
    cut = {r.text for r in D.without_spans(found).collect()}
    assert {None, "", "a ! short", " tail", "this  here", "one two three four five six seven eight nine", "zero  twelve"} <= cut
    assert not [t for t in cut if t and any(hit for _, hit, _ in brute([t], ITEMS[:1]))]
    kept = [r.text for r in D.without_documents(found).collect()]
    assert sorted(t or "" for t in kept) == sorted(t or "" for t, (_, hit, _) in zip(TEXTS, brute(TEXTS, ITEMS), strict=True) if not hit)
    assert D.without_documents(found, 0.5).filter("text like 'clean%'").count() == 1


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.contaminated(docs.limit(0), items).count() == 0
    rows = D.contaminated(docs, items.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.spans or r["items"] for r in rows)
    assert {r.n_words for r in rows} == {len(normal(t)) for t in TEXTS}


def test_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    docs, items = (pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = brute([d["text"] for d in docs], [(b["item_id"], b["text"]) for b in items])
    got = {r.doc_id: r for r in D.op13_decontaminate(spark, sf).collect()}
    for d, (n, hit, found) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))
    assert any(r.contaminated for r in got.values())
