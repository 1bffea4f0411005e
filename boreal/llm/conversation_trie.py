"""The prefix trie of conversations, from rolling fingerprints of their turns.

Turns lie in ranges of (conversation, turn); numpy scans each range for places and polynomial prefix sums, sum of x_i B^i modulo two primes, and the sums of ranges that share a conversation are put together, so that a
conversation of any length is scanned in parallel. The sums are linear: those of a conversation that is rebuilt from another one's head and its own tail follow from the two without a second scan. Rows of one
depth and fingerprint are candidates for one node. The one with the least conversation represents them, and every other one is compared with it turn by turn: role, text, and the fingerprint before. What differs anywhere is split, again and again, until
every row equals its representative and their parents are one node. A node is (least member, depth). Figures of subtrees are rolled up to parents in rounds that double the distance: a node adds what the nodes of exactly 2**k below it have summed, so that a trie of depth d takes log2(d) rounds.

Turns are ordered by number (null first); turns of one number by role and text (their first 64 characters each, then their hashes). Null role or text is empty. Repeated rows are turns of their own. Rows without a conversation id are left out. A rebuilt conversation may have no turn, and
is a member of the root alone. Very long texts are compared whole. A table without conversations gives no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import WORD, Stages, crc_mod, table
from boreal.llm.ranks import ordered, tasks

#: Primes of 31 bits, so that products fit in 63, and the bases of the two sums.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
HEAD = 64
#: Turns that a rebuilt conversation may have from another one, at most, and conversations that share them.
LONGEST_HEAD, SHARING = 3, 20
#: Ids in one piece of a node's list of members.
PIECE_IDS = 8_192


def power(base: int, e: np.ndarray, p: int) -> np.ndarray:
    """base to the powers e, modulo p."""
    out, square, e = np.ones(len(e), np.uint64), np.uint64(base % p), e.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % np.uint64(p), out)
        square, e = square * square % np.uint64(p), e >> np.uint64(1)
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and the keys that order them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    return rows.withColumns({"hash": F.xxhash64("role", "text"), "role_head": F.left("role", F.lit(HEAD)), "text_head": F.left("text", F.lit(HEAD)), "row": F.monotonically_increasing_id()})


SCANNED = "conv_id long, part long, pos long, role string, text string, a1 long, a2 long, b1 long, b2 long"


def scanned(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """rows in ranges: pos, the turn's place in its conversation within the range, from 1, and the prefix sums with (a) and before (b) it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, carry = None, 0, [0, 0]
        for batch in it:
            if not batch.num_rows:
                continue
            c = batch.column("conv_id").to_numpy()
            x = batch.column("hash").to_numpy().view(np.uint64)
            new = np.r_[c[0] != last, c[1:] != c[:-1]]
            at = np.arange(len(c))
            begin = np.maximum.accumulate(np.where(new, at, 0))
            pos = at - begin + 1
            goes_on = np.cumsum(new) == 0
            pos[goes_on] += done
            sums = []
            for j, p in enumerate(primes):
                # the second sum takes the hash's upper half
                term = (x >> np.uint64(32 * j)) % np.uint64(p) * power(BASES[j], pos, p) % np.uint64(p)
                total = np.cumsum(term)
                before = total - term
                before = (before - before[begin] + np.where(goes_on, np.uint64(carry[j]), np.uint64(0))) % np.uint64(p)
                sums.append(((before + term) % np.uint64(p), before))
            last, done, carry = c[-1], int(pos[-1]), [int(a[-1]) for a, _ in sums]
            longs = [pos, sums[0][0], sums[1][0], sums[0][1], sums[1][1]]
            n, a1, a2, b1, b2 = (pa.array(v.astype(np.int64)) for v in longs)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), n, batch.column("role"), batch.column("text"), a1, a2, b1, b2], names=["conv_id", "part", "pos", "role", "text", "a1", "a2", "b1", "b2"])

    placed = ordered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role_head", "text_head", "hash", "row"])
    return placed.select("conv_id", "part", "hash", "role", "text").mapInArrow(run, SCANNED)


def joined(found: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """scanned() rows with pos and sums over whole conversations. Only conversations in several ranges change; those are two a range at most, so that their sums can go to every task."""
    parts = found.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by(F.struct("a1", "a2"), "pos").alias("a"))
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select("conv_id")
    parts = parts.join(several, "conv_id", "left_semi").select("conv_id", "part", "n", "a.a1", "a.a2")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        before = pdf["n"].cumsum().to_numpy() - pdf["n"].to_numpy()
        out = {"c": pdf["conv_id"], "p": pdf["part"], "before": before}
        for j, p in enumerate(primes):
            out[f"m{j + 1}"] = shift = power(BASES[j], before, p).astype(np.int64)
            sums, total = [], 0
            for m, a in zip(shift.tolist(), pdf[f"a{j + 1}"].tolist(), strict=True):
                sums.append(total)
                total = (total + m * a) % p
            out[f"s{j + 1}"] = np.array(sums, np.int64)
        return pd.DataFrame(out)

    known = parts.groupBy("conv_id").applyInPandas(stitch, "c long, p long, before long, m1 long, s1 long, m2 long, s2 long")
    rows = found.join(F.broadcast(known), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    whole = lambda v, j: F.when(F.col("c").isNull(), F.col(f"{v}{j}")).otherwise((F.col(f"s{j}") + F.col(f"m{j}") * F.col(f"{v}{j}")) % primes[j - 1])
    return rows.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text", *[whole(v, j).alias(f"{v}{j}") for v in "ab" for j in (1, 2)])


def plans(found: DataFrame, base: Column, head: Column, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """How each conversation is rebuilt: the first `head` turns (LONGEST_HEAD at most) are those of the conversation `base`, if it has as many. conv_id, base, head, k (turns taken), length, and what turns its own sums into those of the rebuilt one."""
    ks = range(1, LONGEST_HEAD + 1)
    own = found.groupBy("conv_id").agg(F.max("pos").alias("len"), *[F.max(F.when(F.col("pos") == k, F.col(f"a{j}"))).alias(f"a{j}_{k}") for k in ks for j in (1, 2)])
    other = own.select([F.col(c).alias(f"o_{c}") for c in own.columns])
    rows = own.withColumns({"base": base, "head": head}).join(other, F.col("base") == F.col("o_conv_id"), "left")
    rows = rows.withColumn("k", F.least("head", F.coalesce("o_len", F.lit(0))))
    upto = lambda prefix, j, n: F.element_at(F.array(F.lit(0).cast("long"), *[F.col(f"{prefix}a{j}_{k}") for k in ks]), n.cast("int") + 1)
    inverse = lambda j: F.element_at(F.array(*[F.lit(pow(BASES[j - 1], -k, primes[j - 1])).cast("long") for k in (0, *ks)]), (F.col("head") - F.col("k")).cast("int") + 1)
    sums = [x for j in (1, 2) for x in (upto("o_", j, F.col("k")).alias(f"f{j}"), upto("", j, F.least("head", "len")).alias(f"g{j}"), inverse(j).alias(f"z{j}"))]
    return rows.select("conv_id", "base", "head", "k", (F.col("k") + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("length"), *sums)


def rebuilt(found: DataFrame, how: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, depth, fp and parent_fp (prefix fingerprints), role and text of each turn of the rebuilt conversations."""
    both = lambda v: F.shiftleft(v[0], 31).bitwiseOR(v[1])
    moved = lambda v, j: (F.col(f"f{j}") + (F.col(f"{v}{j}") - F.col(f"g{j}") + primes[j - 1]) % primes[j - 1] * F.col(f"z{j}")) % primes[j - 1]
    tail = found.join(how, "conv_id").filter("pos > head")
    tail = tail.select("conv_id", (F.col("k") + F.col("pos") - F.col("head")).alias("depth"), both([moved("a", j) for j in (1, 2)]).alias("fp"), both([moved("b", j) for j in (1, 2)]).alias("parent_fp"), "role", "text")
    heads = found.filter(F.col("pos") <= LONGEST_HEAD).withColumnRenamed("conv_id", "base").join(how.select("conv_id", "base", "k"), "base").filter("pos <= k")
    heads = heads.select("conv_id", F.col("pos").alias("depth"), both([F.col("a1"), F.col("a2")]).alias("fp"), both([F.col("b1"), F.col("b2")]).alias("parent_fp"), "role", "text")
    return tail.union(heads)


def labelled(rows: DataFrame, stages: Stages) -> DataFrame:
    """conv_id, depth, owner (the least member of the turn's node) and, in the owner's row, words (of the turn's text). rows: rebuilt(), written."""
    words = F.when(F.col("conv_id") == F.col("owner"), F.regexp_count("text", F.lit(WORD)).cast("long")).alias("words")
    first = stages.keep(rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("owner"), F.min_by(F.struct("role", "text", "parent_fp"), "conv_id").alias("first")), "representatives")
    same = (F.col("role") == F.col("first.role")) & (F.col("text") == F.col("first.text")) & (F.col("parent_fp") == F.col("first.parent_fp"))
    labels = stages.keep(rows.join(first, ["depth", "fp"]).select("conv_id", "depth", "owner", words, same.alias("same")), "labels")
    stages.drop("representatives")
    if not labels.filter("NOT same").limit(1).count():
        return labels.drop("same")
    labels = stages.keep(split(rows, labels.select("conv_id", "depth", "owner"), stages), "split")
    return stages.keep(rows.join(labels, ["conv_id", "depth"]).select("conv_id", "depth", "owner", words), "labels")


def split(rows: DataFrame, labels: DataFrame, stages: Stages) -> DataFrame:
    """labels (conv_id, depth, owner) with every group of unlike turns, or of turns with unlike parents, split. Rows of equal prefixes always move together; a round parts each group's representative and its likes from the rest."""
    texts = rows.select("conv_id", "depth", "role", "text")
    for k in range(1 << 62):
        above = labels.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
        held = texts.join(labels, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left")
        first = held.filter("conv_id = owner").select("owner", "depth", F.struct("role", "text", "above").alias("first"))
        same = (F.col("role") == F.col("first.role")) & (F.col("text") == F.col("first.text")) & F.col("above").eqNullSafe(F.col("first.above"))
        judged = stages.keep(held.join(first, ["owner", "depth"]).select("conv_id", "depth", "owner", same.alias("same")), f"judged{k % 2}")
        fresh = judged.filter("NOT same").groupBy("owner", "depth").agg(F.min("conv_id").alias("fresh"))
        if not fresh.limit(1).count():
            return labels
        labels = stages.keep(judged.join(fresh, ["owner", "depth"], "left").select("conv_id", "depth", F.when(F.col("same"), F.col("owner")).otherwise(F.col("fresh")).alias("owner")), f"labels{k % 2}")
    raise AssertionError


def listed(ends: DataFrame) -> DataFrame:
    """owner, depth and ends_sha256, the digest of the ascending ids conv_id joined by commas. Ids are packed in parallel; one pass over a node's packed pieces is what SHA-256 asks for."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["owner", "depth", "first", "ids"]
        for batch in it:
            o, d, c = (batch.column(x).to_numpy() for x in ("owner", "depth", "conv_id"))
            cuts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (d[1:] != d[:-1])])
            cuts = sorted({x for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c)], strict=True) for x in range(a, b, PIECE_IDS)})
            ids = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(c)], strict=True)] if len(c) else []
            yield pa.RecordBatch.from_arrays([pa.array(o[cuts]), pa.array(d[cuts]), pa.array(c[cuts]), pa.array(ids, pa.string())], names=names)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in it:
            for o, d, ids in zip(*(batch.column(x).to_pylist() for x in ("owner", "depth", "ids")), strict=True):
                if (o, d) == now:
                    state.update(b",")
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (o, d), sha256()
                state.update(ids.encode())
            yield rows(out)
            out = []
        if now:
            yield rows([(*now, state.hexdigest())])

    def rows(out):
        o, d, h = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], names=["owner", "depth", "ends_sha256"])

    packed = ordered(ends, ["owner", "depth", "conv_id"]).select("owner", "depth", "conv_id").mapInArrow(pack, "owner long, depth long, first long, ids string")
    return packed.repartition(tasks(ends), "owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(stream, "owner long, depth long, ends_sha256 string")


def rolled(nodes: DataFrame, labels: DataFrame, deepest: int, columns: tuple[str, ...], stages: Stages) -> DataFrame:
    """nodes (owner, depth, columns) with the columns summed over each node's subtree. labels: conv_id, depth, owner, from depth 0 on."""
    step, k = 1, 0
    while step <= deepest:
        at = labels.select(F.col("conv_id").alias("owner"), (F.col("depth") + step).alias("depth"), F.col("owner").alias("above"))
        up = nodes.filter(F.col("depth") >= step).join(at, ["owner", "depth"]).groupBy("above", (F.col("depth") - step).alias("d")).agg(*[F.sum(c).alias(f"add_{c}") for c in columns])
        sums = nodes.join(up, (F.col("owner") == F.col("above")) & (F.col("depth") == F.col("d")), "left")
        nodes = stages.keep(sums.select("owner", "depth", *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in columns]), f"rolled{k % 2}")
        step, k = step * 2, k + 1
    return nodes


def trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), and the members (conv_id, depth, owner): the node (owner, depth) of each prefix of each conversation.

    base, head: each conversation begins with the first `head` turns, LONGEST_HEAD at most, of the conversation `base`, and goes on with its own from there; functions of conv_id. Without them conversations are as they stand."""
    spark = conversations.sparkSession
    stages = Stages(spark, "op11")
    found = joined(stages.keep(scanned(turns(conversations), primes), "scanned"), primes)
    how = stages.keep(plans(found, F.col("conv_id") if base is None else base, (F.lit(0) if head is None else head).cast("long"), primes), "plans")
    rows = stages.keep(rebuilt(found, how, primes), "rebuilt")
    stages.drop("scanned")
    labels = labelled(rows, stages)
    stages.drop("rebuilt")
    n_all, root = how.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    whole = labels.select("conv_id", "depth", "owner").union(how.select("conv_id", F.lit(0).cast("long"), F.lit(root).cast("long")))
    top = spark.createDataFrame([(root, 0, n_all, 0)] if n_all else [], "owner long, depth long, n_convs long, words long")
    nodes = labels.groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")).union(top)
    above = whole.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    nodes = stages.keep(nodes.join(above, ["owner", "depth"], "left"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stages.keep(nodes.join(children, ["owner", "depth"], "left").na.fill(0, ["n_children"]), "counted")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("owner", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = rolled(own, whole, deepest, ("n_leaves", "saved_tokens"), stages)
    ends = listed(how.select("conv_id", F.col("length").alias("depth")).join(whole, ["conv_id", "depth"]).select("owner", "depth", "conv_id"))
    out = nodes.join(sums, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
    out = out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    return out, whole


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv_id") - F.col("conv_id") % SHARING
    return trie(table(spark, sf_dir, "conversations"), base, crc_mod("conv_id", 4))[0]


OP11_SQL = r"""
WITH RECURSIVE bytes(conv_id, crc, left_over, bit) AS (
  SELECT DISTINCT conv_id, CAST(4294967295 AS BIGINT), CAST(conv_id AS VARCHAR), 0 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, CASE WHEN bit = 0 THEN xor(crc, CAST(ascii(left_over) AS BIGINT)) ELSE xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN 3988292384 ELSE 0 END) END,
         CASE WHEN bit = 8 THEN left_over[2:] ELSE left_over END, (bit + 1) % 9 FROM bytes WHERE left_over <> ''
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS head FROM bytes WHERE left_over = ''
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT ids.conv_id, pos AS d, role, text FROM ids JOIN t ON t.conv_id = ids.base AND pos <= head
), k AS (
  SELECT ids.*, (SELECT count(*) FROM heads WHERE heads.conv_id = ids.conv_id) AS k FROM ids
), r AS (
  SELECT * FROM heads UNION ALL SELECT k.conv_id, k + pos - head, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND pos > head
), m AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS path, 0 AS words FROM ids
  UNION ALL
  SELECT conv_id, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM r
), n AS (
  SELECT d, path, min(conv_id) AS owner, count(*) AS n_convs, max(words) AS words FROM m GROUP BY d, path
), l AS (
  SELECT m.conv_id, m.d, n.owner FROM m JOIN n ON n.d = m.d AND n.path = m.path
), p AS (
  SELECT n.owner, n.d, n.n_convs, n.words, l.owner AS parent FROM n LEFT JOIN l ON l.conv_id = n.owner AND l.d = n.d - 1
), c AS (
  SELECT parent AS owner, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL
), q AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN c ON c.owner = p.owner AND c.d = p.d
), s AS (
  SELECT l.owner, l.d, count(*) FILTER (q.n_children = 0) AS n_leaves, CAST(sum((q.n_convs - 1) * q.words) AS BIGINT) AS saved_tokens
  FROM q JOIN l ON l.conv_id = q.owner AND l.d <= q.d GROUP BY l.owner, l.d
), e AS (
  SELECT l.owner, l.d, string_agg(CAST(l.conv_id AS VARCHAR), ',' ORDER BY l.conv_id) AS ids
  FROM l JOIN (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) x ON x.conv_id = l.conv_id AND x.d = l.d GROUP BY l.owner, l.d
)
SELECT q.owner AS conv_id, q.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM q JOIN s ON s.owner = q.owner AND s.d = q.d LEFT JOIN e ON e.owner = q.owner AND e.d = q.d
"""
