"""Merkle manifest of a data set: a tree of three-way runs per source, and one over the sources' roots.

H is the lowercase hex SHA-256 of its inputs, concatenated. A row's leaf is H of its columns, each as its UTF-8 byte count, `:` and its value, or `-` where it is null. In a source, leaves ascend by id;
while a source has several nodes, every three consecutive ones (the last run: fewer) become their H. The last one is the source's subroot, and the subroots, in the order of their sources, become the root in the same way.

Vertices are RDD records keyed by (tree, place in its level), worked on in supersteps. Upward, every child sends its digest to its parent; a parent that has as many children as its level says hashes them and is a child of the next superstep. One that does not is an error.
A subroot is passed on until the highest tree is done. Downward, every vertex that knows its path sends each child the path with that child's siblings on top; a leaf with its path folds itself, or what has become of it since, up to a root. Each superstep is written to the shared folder, so that a lost
executor costs a part of one superstep. A message goes to one of as many parents as there are nodes in a level, three to a parent at most, so no key is hot however large a source is; places come from ranges, not from a window over a source.

Rows are ordered by source (null first, by bytes), id (null first) and leaf; repeated rows have a leaf each, and any of them takes any of their places. Null columns, empty and very long texts are hashed as they are. A table without rows has no root and gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import crc_mod, new_folder, table
from boreal.llm.ranks import ranked, tasks

FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Sources up to which their ordinals go to every executor; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
#: Messages a task gets, about.
TASK_ROWS = 50_000


def field(c: Column | str) -> Column:
    value = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row whose text is `text`."""
    return F.sha2(F.concat(*(field(c) for c in COLUMNS[:-1]), field(text)).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def numbered(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, leaf, now) with tree (the source's ordinal), at (place in it), n (rows of it) and trees (sources in all)."""
    placed = ranked(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"], "merkle-leaves")
    per = placed.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    per = ranked(per, ["first"], "merkle-sources").withColumnRenamed("rank", "tree")
    trees = per.count()
    per = per.select(F.col("source").alias("s"), "first", "n", "tree")
    per = F.broadcast(per) if trees <= MAX_BROADCAST_SOURCES else per
    return placed.join(per, F.col("source").eqNullSafe(F.col("s"))).select("tree", (F.col("rank") - F.col("first")).alias("at"), "n", F.lit(trees).cast("long").alias("trees"), "doc_id", "leaf", "now")


class Supersteps:
    """Written supersteps. A vertex is (tree, at, n, digest, load, children): its place among the n of its level, what a lowest vertex carries, and a (digest, load) for each of its children, None for a vertex that was only passed on."""

    def __init__(self, spark: SparkSession):
        self.sc, self.spark, self.most = spark.sparkContext, spark, tasks(spark.range(0))

    def keep(self, rdd: RDD, tag: str, rows: int) -> RDD:
        """Written, and read in as many tasks as its rows ask for."""
        folder = new_folder(self.spark, f"merkle-{tag}")
        rdd.saveAsPickleFile(folder)
        return self.sc.pickleFile(folder).coalesce(self.width(rows))

    def width(self, rows: int) -> int:
        return max(1, min(self.most, -(-rows // TASK_ROWS)))

    def climb(self, vertices: RDD, levels: int, rows: int, trees: int, tag: str) -> tuple[list[RDD], RDD]:
        """Vertices of each level from 1 on, and the last of them, one for each tree. A vertex that is alone in its level is passed on as it is. rows: of the lowest level, for the number of tasks."""

        def hashed(inbox):
            (tree, at), messages = inbox
            children = sorted(messages, key=lambda c: c[0])
            n = children[0][1]
            if [c[0] for c in children] != list(range(min(FAN, n - FAN * at))):
                raise ValueError(f"vertex {at} of tree {tree} lacks a child or has one twice")
            if n == 1:
                return tree, at, n, *children[0][2:], None
            return tree, at, -(-n // FAN), digest(c[2] for c in children), None, [c[2:] for c in children]

        out = []
        for level in range(1, levels + 1):
            sent = vertices.map(lambda v: ((v[0], v[1] // FAN), (v[1] % FAN, *v[2:5])))
            met = sent.groupByKey(self.width(rows)).map(hashed)
            rows = -(-rows // FAN) + trees
            out.append(vertices := self.keep(met, f"{tag}-up{level}", rows))
        return out, vertices

    def descend(self, levels: list[RDD], tops: RDD, rows: int, trees: int, tag: str, leaf: Callable) -> RDD:
        """What leaf(known, path, digest, load) makes of every lowest vertex of the trees of tops: ((tree, 0), (known, path)). path: (place, siblings) from a vertex up to the root. A message waits where its tree has no vertex as high as the level."""
        out, inbox = [], tops
        for level in range(len(levels), 0, -1):
            held = levels[level - 1].filter(lambda v: v[5] is not None).map(lambda v: ((v[0], v[1]), v[5]))

            def sent(x):
                (tree, at), (children, messages) = x
                for known, path in messages:
                    if not children:
                        yield (tree, at), None, None, known, path
                    for family in children:
                        names = [c[0] for c in family]
                        for k, (name, load) in enumerate(family):
                            yield (tree, FAN * at + k), name, load, known, ((k, tuple(names[:k] + names[k + 1 :])), *path)

            below = -(-rows // FAN ** (level - 1)) + trees
            met = held.cogroup(inbox, self.width(below)).mapValues(lambda v: tuple(map(list, v))).flatMap(sent)
            if level == 1:
                out.append(met.filter(lambda m: m[1] is not None).map(lambda m: leaf(m[3], m[4], m[1], m[2])))
            else:
                inbox = self.keep(met.map(lambda m: (m[0], m[3:])), f"{tag}-down{level}", below)
        return self.sc.union(out) if out else self.sc.emptyRDD()


def fold(start: str, path: tuple) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for k, siblings in path:
        start = digest((*siblings[:k], start, *siblings[k:]))
    return start


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """A row for each of docs: doc_id, leaf, subroot, root, proof_sha256 (all of docs as they are), path (place in the run and siblings, level by level), folded_root and verified.

    changed: the text that each row has when it is verified; where it is not given, the text of docs."""
    spark = docs.sparkSession
    rows = docs.select(*COLUMNS, (F.col("text") if changed is None else changed).alias("now_text"))
    rows = rows.select("source", "doc_id", leaf_of(F.col("text")).alias("leaf"), F.when(F.col("now_text").eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf_of(F.col("now_text"))).alias("now"))
    placed = numbered(rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, path array<struct<place:int,siblings:array<string>>>, folded_root string, verified boolean"
    most, total, trees = placed.agg(F.max("n"), F.count(F.lit(1)), F.max("trees")).first()
    if not total:
        return spark.createDataFrame([], schema)
    steps = Supersteps(spark)
    vertices = placed.rdd.map(lambda r: (r.tree, r.at, r.n, r.leaf, (r.doc_id, r.now), None))
    levels, tops = steps.climb(vertices, height(most), total, trees, "source")
    # a source's subroot is a leaf of the tree over the sources; it keeps what a source of one row carries
    level0 = tops.map(lambda v: (-1, v[0], trees, v[3], (v[0], v[4]), None))
    over, top = steps.climb(level0, height(trees), trees, 1, "top")
    root = top.map(lambda v: v[3]).first()
    paths = steps.descend(over, steps.sc.parallelize([((-1, 0), (None, ()))], 1), trees, 1, "top", lambda known, path, name, load: (load, name, path)) if trees > 1 else level0.map(lambda v: (v[4], v[3], ()))
    paths = steps.keep(paths, "paths", trees)

    def row(subroot, path, leaf, load):
        doc_id, now = load
        folded = fold(now or leaf, path)
        return doc_id, leaf, subroot, root, digest(s for _, siblings in path for s in siblings), [(k, list(siblings)) for k, siblings in path], folded, folded == root

    single = paths.filter(lambda p: p[0][1] is not None).map(lambda p: row(p[1], p[2], p[1], p[0][1]))
    larger = paths.filter(lambda p: p[0][1] is None).map(lambda p: ((p[0][0], 0), (p[1], p[2])))
    return spark.createDataFrame(steps.descend(levels, larger, total, trees, "source", row).union(single), schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, tampered).drop("path")


OP12_SQL = r"""
WITH RECURSIVE bytes(doc_id, crc, left_over, bit) AS (
  SELECT DISTINCT doc_id, CAST(4294967295 AS BIGINT), CAST(doc_id AS VARCHAR), 0 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, CASE WHEN bit = 0 THEN xor(crc, CAST(ascii(left_over) AS BIGINT)) ELSE xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN 3988292384 ELSE 0 END) END,
         CASE WHEN bit = 8 THEN left_over[2:] ELSE left_over END, (bit + 1) % 9 FROM bytes WHERE left_over <> ''
), odd AS (
  SELECT doc_id FROM bytes WHERE left_over = '' AND xor(crc, 4294967295) % 2 = 1
), d AS (
  SELECT doc_id, source, text, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         CASE WHEN doc_id IS NULL OR doc_id IN (SELECT doc_id FROM odd) THEN text ELSE replace(text, chr(10), '') END AS now FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS now FROM d
), s AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), low(level, tree, pos, h, n) AS (
  SELECT 0, tree, pos, leaf, count(*) OVER (PARTITION BY tree) FROM s
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM low WHERE n > 1 GROUP BY level, tree, pos // 3
), sub AS (
  SELECT tree, level AS top, h FROM low WHERE n = 1
), high(level, pos, h, n) AS (
  SELECT 0, tree, h, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, pos // 3
), root AS (
  SELECT h FROM high WHERE n = 1
), run(tree, level, parent, hs) AS (
  SELECT tree, level, pos // 3, list(h ORDER BY pos) FROM low WHERE n > 1 GROUP BY tree, level, pos // 3
  UNION ALL
  SELECT CAST(-1 AS BIGINT), level, pos // 3, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY level, pos // 3
), walk(doc_id, leaf, own, source_tree, tree, level, pos, folded, proof) AS (
  SELECT doc_id, leaf, row_number() OVER (), tree, tree, 0, pos, now, '' FROM s
  UNION ALL
  SELECT w.doc_id, w.leaf, own, source_tree, CASE WHEN r.hs IS NULL THEN -1 ELSE w.tree END, CASE WHEN r.hs IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN r.hs IS NULL THEN w.tree ELSE w.pos // 3 END,
         CASE WHEN r.hs IS NULL THEN folded ELSE sha256(array_to_string(r.hs[1:w.pos % 3], '') || folded || array_to_string(r.hs[w.pos % 3 + 2:], '')) END,
         CASE WHEN r.hs IS NULL THEN proof ELSE proof || array_to_string(r.hs[1:w.pos % 3], '') || array_to_string(r.hs[w.pos % 3 + 2:], '') END
  FROM walk w LEFT JOIN run r ON r.tree = w.tree AND r.level = w.level AND r.parent = w.pos // 3 WHERE r.hs IS NOT NULL OR w.tree >= 0
)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM walk JOIN sub ON sub.tree = walk.source_tree, root WHERE walk.tree = -1 AND walk.level = (SELECT max(level) FROM high)
"""
