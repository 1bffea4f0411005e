"""The trie against one of nested dictionaries; the query itself is held against SQL in test_sql_ops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boreal.llm import conversation_trie as T


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text). The contract's figures of every node."""
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append(((n is not None, n or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [sums[p] for p in children[path]]
        sums[path] = (sum(x for x, _ in below) or 1, sum(y for _, y in below) + (len(members[path]) - 1) * words)
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, rebuild=True, **kwargs):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    extra = (F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4) if rebuild else ()
    return sorted((tuple(r) for r in T.trie(df, *extra, **kwargs)[0].collect()), key=repr)


def some(seed, n=60, texts=("a b", "c", "", "d e f")):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", "bot")), rng.choice(texts)) for c in range(n) if c % 7 for t in range(rng.randrange(6))]
    return rows + [(c, None, None, None) for c in (3, 3, 20, 40)] + [(c, t, "user", "x" * 70 + str(t % 3)) for c in (-5, -20, 61) for t in (2, 2, 1)] + [(None, 1, "user", "lost"), (80, 0, "user", "long text " * 20_000), (85, 0, "user", "long text " * 20_000)]


def test_equals_nested_dictionaries(spark):
    rows = some(1)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, rebuild=False) == brute(rows, rebuild=False)


@pytest.mark.parametrize("primes", [(17, 19), (2, 3)])
def test_collisions_are_split(spark, primes):
    """With primes this small many different prefixes share a fingerprint, also over several depths."""
    rows = some(2, 40)
    assert run(spark, rows, primes=primes) == brute(rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    """One conversation lies in several ranges, another in as many copies; lists of members are packed in pieces."""
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    rows = [(100, t, "user", f"turn {t % 5}") for t in range(700)] + [(100, 3, "user", "again")] * 3 + [(101, t, "user", f"turn {t % 5}") for t in range(300)]
    rows += [(200 + c, t, "bot", "same") for c in range(90) for t in range(3)]
    assert run(spark, rows) == brute(rows)
    assert max(r[1] for r in run(spark, rows)) > 690


def test_members_name_their_nodes(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, T.trie(df)[1].collect())) == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 1), (2, 2, 2)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.trie(df)[0].count() == 0
