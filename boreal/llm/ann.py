"""Nearest neighbours by inner product: 2-stable projections, kd-trees, and a chi-square stopping test.

Inner products are turned into distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries). Vectors
are projected to `DIMENSIONS` Gaussian, so 2-stable, directions: the squared projected distance over the squared distance follows a chi-square
law of that many degrees. The top of a kd-tree over projections, fitted on about `SAMPLE` rows or four a cell (at most twice 4 * `MAX_CELLS`, 128 bytes each),
deals every row to a cell; each cell's block holds a kd-tree of its own. A query takes a block's points in the order of projected distance,
verifies their inner products, and stops once the next point is so far that a point nearer than the k-th neighbour so far would lie there
with probability 1 - `CONFIDENCE` at most. It meets its own cell first, and then only the other cells that this test leaves open.
A block is sent only where queries meet it, once for every `QUERIES` of them.

Scores are sums over a vector's own components, so equal vectors have equal scores wherever they lie, and ties go to the smaller id. Vectors that are null, zero,
hold null or non-finite components, have a null id, or another length than most (of equally frequent lengths the
shortest counts) take no part. Of rows with one id the least vector counts; repeated vectors under other ids are
neighbours like others. Vectors of any length are read whole; a block holds `PART` of them at most, and cells with more are cut into parts by id. A table without rows gives none; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreal.llm.common import stage, table

K, DIMENSIONS, CONFIDENCE, SEED = 20, 16, 0.92, 5
#: Rows in a cell, about; at most in one block of a cell; in a leaf of a block's tree.
BLOCK, PART, LEAF = 4096, 16_384, 64
SAMPLE, MAX_CELLS = 20_000, 65_536
#: Queries that meet a block in one task.
QUERIES = 20_000
#: Points verified between two tests.
STEP = 512


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number m of degrees, by bisection on the closed form of the distribution."""
    upper = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 20.0 * m
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - upper(mid) < p else (lo, mid)
    return hi


def directions(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(d + 1, DIMENSIONS))


def top_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Median splits (dimension, value, low, high) of the widest dimension until there are `cells` cells; low and high: a later split, or ~cell."""
    tree: list[tuple[int, float, int, int]] = []
    n_cells = 0

    def build(p: np.ndarray, want: int) -> int:
        nonlocal n_cells
        dim = int(np.argmax(np.ptp(p, 0))) if want > 1 and len(p) > 1 else -1
        value = float(np.median(p[:, dim])) if dim >= 0 else 0.0
        low = p[:, dim] <= value if dim >= 0 else np.zeros(0, bool)
        if dim < 0 or low.all():
            n_cells += 1
            return ~(n_cells - 1)
        at = len(tree)
        tree.append((dim, value, 0, 0))
        a = build(p[low], want // 2)
        b = build(p[~low], want - want // 2)
        tree[at] = (dim, value, a, b)
        return at

    build(points, cells)
    return tree


def cell_of(p: np.ndarray, tree: list) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    todo = [(0 if tree else ~0, np.arange(len(p)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            out[rows] = ~node
            continue
        dim, value, a, b = tree[node]
        low = p[rows, dim] <= value
        todo += [(a, rows[low]), (b, rows[~low])]
    return out


def cell_boxes(tree: list) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest projected coordinate of each cell."""
    lo, hi = {}, {}

    def walk(node: int, a: np.ndarray, b: np.ndarray) -> None:
        if node < 0:
            lo[~node], hi[~node] = a, b
            return
        dim, value, x, y = tree[node]
        b2, a2 = b.copy(), a.copy()
        b2[dim] = a2[dim] = value
        walk(x, a, b2)
        walk(y, a2, b)

    walk(0 if tree else ~0, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf))
    return np.stack([lo[k] for k in sorted(lo)]), np.stack([hi[k] for k in sorted(hi)])


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    return (np.maximum(0, np.maximum(lo - q, q - hi)) ** 2).sum(1)


class Block:
    """A kd-tree over a block's projections: rows in leaf order, and the leaves' boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray):
        order, self.ends = [], []

        def build(rows: np.ndarray) -> None:
            if len(rows) <= LEAF:
                order.append(rows)
                self.ends.append(len(rows))
                return
            dim = int(np.argmax(np.ptp(p[rows], 0)))
            rows = rows[np.argsort(p[rows, dim], kind="stable")]
            build(rows[: len(rows) // 2])
            build(rows[len(rows) // 2 :])

        build(np.arange(len(ids)))
        order = np.concatenate(order)
        self.ids, self.x, self.p = ids[order], x[order], p[order]
        self.pp = (self.p**2).sum(1)
        self.ends = np.cumsum(self.ends)
        self.starts = np.r_[0, self.ends[:-1]]
        self.lo = np.stack([self.p[a:b].min(0) for a, b in zip(self.starts, self.ends, strict=True)])
        self.hi = np.stack([self.p[a:b].max(0) for a, b in zip(self.starts, self.ends, strict=True)])

    def search(self, own: int, q: np.ndarray, pq: np.ndarray, k: int, base: float, stop: float, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best found, not below bound (the k-th score so far), and how many points were verified. base: M^2 + |q|^2; stop: the chi-square quantile."""
        slack = 1e-15 * len(q) * base  # more than a score is off by, whatever the order of its sum
        ids, scores, verified = np.empty(0, np.int64), np.empty(0), 0
        radius = lambda: stop * (base - 2 * bound)

        def verify(rows: np.ndarray) -> None:
            nonlocal ids, scores, verified, bound
            verified += len(rows)
            rows = rows[self.x[rows] @ q >= bound - slack]
            found = (self.x[rows] * q).sum(1)
            good = found >= bound
            ids, scores = np.r_[ids, self.ids[rows[good]]], np.r_[scores, found[good]]
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) >= k:
                bound = max(bound, scores.min())

        leaves = box_distance(pq, self.lo, self.hi) <= radius()
        rows = np.flatnonzero(np.repeat(leaves, self.ends - self.starts) & (self.ids != own))
        near = (self.pp - 2 * (self.p @ pq))[rows] + pq @ pq
        if bound == -np.inf and len(rows) > STEP:  # the test needs k neighbours: the nearest points give them
            first = np.zeros(len(rows), bool)
            first[np.argpartition(near, STEP)[:STEP]] = True
            verify(rows[first])
            rows, near = rows[~first], near[~first]
        rows, near = rows[left := near <= radius()], near[left]
        order = np.argsort(near, kind="stable")
        rows, near = rows[order], near[order]
        for s in range(0, len(rows), STEP):
            if near[s] > radius():
                break
            verify(rows[s : s + STEP])
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], verified


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of those that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v"))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of df (vec_id, embedding) where is_query holds, against all rows but their own."""
    spark = df.sparkSession
    rows = stage(vectors(df), "ann-vectors")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    d, n = size
    rows = rows.filter(F.size("v") == d)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    m2 = rows.agg(F.max(square)).first()[0] * (1 + 1e-9)
    project, stop = directions(d), chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, m2 - (x**2).sum(1)))] @ project

    def components(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, d) if len(column) else np.empty((0, d))

    def projections(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a in lifted(components(batch.column("v")))], pa.binary())], ["p"])

    cells, tree = min(MAX_CELLS, -(-n // BLOCK)), []
    if cells > 1:
        size = max(SAMPLE, 4 * cells)
        hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= int(min(1.0, size / n) * (1 << 20))
        fitted = rows.filter(hashed).select("v").mapInArrow(projections, "p binary").limit(2 * size).toArrow()
        tree = top_tree(np.stack([np.frombuffer(p) for p in fitted.column("p").to_pylist()]), cells)
    lo, hi = cell_boxes(tree)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = components(batch.column("v"))
            p, q = lifted(x), x @ project[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("is_query"), pa.array(cell_of(p, tree)), pa.array([a.tobytes() for a in x], pa.binary()), pa.array([a.tobytes() for a in p], pa.binary()), pa.array([a.tobytes() for a in q], pa.binary()), pa.array(cell_of(q, tree))],
                ["vec_id", "is_query", "cell", "x", "p", "q", "home"],
            )

    schema = "vec_id long, is_query boolean, cell long, x binary, p binary, q binary, home long"
    indexed = stage(rows.select("vec_id", is_query.alias("is_query"), "v").mapInArrow(index, schema), "ann-index")
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # at most MAX_CELLS rows
    queries = indexed.filter("is_query").select("vec_id", "x", "q", "home")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(np.int64), *(np.stack([np.frombuffer(b) for b in left[c]]) for c in ("x", "p")))
            for own, x, q, bound in zip(right["own"], right["qx"], right["qp"], right["bound"], strict=True):
                x = np.frombuffer(x)
                ids, scores, _ = block.search(own, x, np.frombuffer(q), k, m2 + float(x @ x), stop, bound)
                out += [(own, int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def searched(routed: DataFrame) -> DataFrame:
        """routed: queries with cell and bound. Only cells that queries reach are sent, once for every QUERIES of theirs."""
        reached = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")).join(sizes, "cell")  # at most MAX_CELLS rows
        blocks = indexed.select("vec_id", "x", "p", "cell").join(F.broadcast(reached), "cell")
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        to = routed.join(F.broadcast(reached), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "part", "chunk"]
        to = to.select(F.col("vec_id").alias("own"), F.col("x").alias("qx"), F.col("q").alias("qp"), "bound", *keys)
        return blocks.select("vec_id", "x", "p", *keys).groupBy(*keys).cogroup(to.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = stage(top(searched(queries.withColumn("cell", F.col("home")).withColumn("bound", F.lit(float("-inf"))))), "ann-first")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cell = []
            for x, q, home, bound in zip(*(batch.column(c).to_pylist() for c in ("x", "q", "home", "bound")), strict=True):
                x = np.frombuffer(x)
                open_ = box_distance(np.frombuffer(q), lo, hi) <= stop * (m2 + float(x @ x) - 2 * bound)
                open_[home] = False
                cell.append(np.flatnonzero(open_).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), batch.column("q"), batch.column("bound"), pa.array(cell, pa.list_(pa.int64()))], ["vec_id", "x", "q", "bound", "cells"])

    others = stage(queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).mapInArrow(route, "vec_id long, x binary, q binary, bound double, cells array<long>"), "ann-routes")
    second = searched(others.withColumn("cell", F.explode("cells")).drop("cells"))
    return top(first.drop("rank").union(second)).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
