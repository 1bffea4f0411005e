"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and their first five letters, hashed to 2**`BITS` buckets. Inputs are those whose
share among toxic documents differs from that among others by `MIN_Z` standard errors, and, as a term may tell something only beside another one, those
of the `PAIR_TERMS` most frequent terms that interact with one of them: the labels' covariance with both together is `PAIR_Z` standard errors from none. The machine
is w0 + sum w_i + sum of <v_i, v_j> over pairs: the pairs let a word count for more beside another one, such as an insult beside a
group's name, than both do alone. It is fitted on at most `TRAIN_ROWS` labelled rows and `TRAIN_TERMS` terms of theirs, taken in the order of
a hash of their ids; everything else covers all rows.

A null or empty text has the score of a text without any term; rows without an id are scored like others and are no labelled rows. Repeated rows get the same score, texts of any length are read whole, other columns,
whatever their names, are ignored. Without labelled rows of both kinds every score is the share of toxic rows (0 without any). A table without rows gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from boreal.llm.common import batches, crc_mod, stage, table

TRAIN_ROWS = 40_000
TRAIN_TERMS = 20_000_000
BITS, PREFIX, MIN_Z, MIN_ROWS = 18, 5, 3.5, 5
#: Terms whose pairs are looked at, a pair's least expected number of rows, and its least z.
PAIR_TERMS, PAIR_ROWS, PAIR_Z = 1024, 25.0, 7.0
FACTORS, EPOCHS, BATCH, RATE, L2, SPREAD = 8, 20, 512, 0.05, 1e-4, 0.02
THRESHOLD = 0.3
CACHE = 300_000
LETTERS = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Word -> buckets of its terms; given chosen (bucket -> input), the inputs instead."""

    def __init__(self, chosen: dict[int, int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = {zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1), zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)}
        self[word] = out = tuple(found if self.chosen is None else (self.chosen[b] for b in found if b in self.chosen))
        return out

    def of(self, text: str | None) -> list[int]:
        return sorted({b for w in set(LETTERS.findall((text or "").lower())) for b in self[w]})


@dataclass
class Machine:
    """chosen: bucket -> input; w0, w (inputs), v (inputs x FACTORS)."""

    chosen: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.w0)
        for k, x in enumerate(rows):
            if len(x):
                v = self.v[x]
                out[k] += self.w[x].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()
        return out

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(chosen: list[int], rows: list, y: np.ndarray, factors: int = FACTORS) -> Machine:
    """Logistic loss by Adam on shuffled batches, which moves the inputs of a batch alone; rows hold inputs. Without factors the machine is additive."""
    base = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-13
    m = Machine({b: k for k, b in enumerate(chosen)}, float(np.log(base / (1 - base))), np.zeros(len(chosen)), np.random.default_rng(7).normal(0, SPREAD, (len(chosen), factors)))
    if not chosen or not 0 < y.sum() < len(y):
        return m
    rng, at = np.random.default_rng(11), np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.asarray(x, np.int32) for x in rows])
    p = np.c_[m.w, m.v]  # an input's weight and factors
    mean, square, steps = np.zeros_like(p), np.zeros_like(p), np.zeros(len(p))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            take = order[s : s + BATCH]
            sizes = at[take + 1] - at[take]
            of = np.repeat(np.arange(len(take)), sizes)
            used, i = np.unique(flat[np.repeat(at[take] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())], return_inverse=True)
            here = p[used][i]
            sums = np.stack([np.bincount(of, here[:, f], len(take)) for f in range(1 + factors)], 1)
            raw = m.w0 + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.bincount(of, (here[:, 1:] ** 2).sum(1), len(take)))
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]
            m.w0 -= RATE * error.mean()
            pull = error[of, None] * np.c_[np.ones(len(of)), sums[of, 1:] - here[:, 1:]]
            grad = np.stack([np.bincount(i, pull[:, f], len(used)) for f in range(1 + factors)], 1) / len(take) + L2 * p[used]
            steps[used] += 1
            t = steps[used][:, None]
            mean[used] += 0.1 * (grad - mean[used])
            square[used] += 0.001 * (grad * grad - square[used])
            p[used] -= RATE * (mean[used] / (1 - 0.9**t)) / (np.sqrt(square[used] / (1 - 0.999**t)) + 1e-8)
    m.w, m.v = p[:, 0].copy(), p[:, 1:].copy()
    return m


def training(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Chosen buckets, each labelled row's inputs, and its label: of labels (doc_id, toxic) of documents outside the held-out fourth, at most `rows` and TRAIN_TERMS terms of theirs."""
    sample = labels.filter((crc_mod("doc_id", 4) != 2) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    schema = docs.select("doc_id").schema.add("toxic", "integer").add("terms", ArrayType(IntegerType()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([terms.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], schema.names)

    found = stage(known.mapInArrow(run, schema), "toxicity-terms")
    order = ["h", "doc_id", "toxic", "k"]
    found = found.select("doc_id", "toxic", "terms", F.xxhash64("doc_id").alias("h"), F.xxhash64("terms").alias("k")).dropDuplicates(order)  # ids may repeat in docs
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = found.select(*order, F.size("terms").alias("size")).orderBy(*order).limit(rows).withColumn("upto", upto)  # four numbers for each of `rows` rows
    last = sizes.filter(F.col("upto") <= TRAIN_TERMS).agg(F.max(F.struct(*order)).alias("m")).first().m
    found = stage(found.filter(F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(found.schema[c].dataType) for c in order])) if last else found.limit(0), "toxicity-rows")
    n1, n = found.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n1 < n:
        return [], [np.empty(0, np.int32)] * n, np.r_[np.ones(n1), np.zeros(n - n1)]
    per = found.select(F.explode("terms").alias("b"), "toxic").groupBy("b").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ROWS).cache()
    share, expected = F.col("n") / F.lit(float(n)), F.col("n") * F.lit(n1 / n)
    z = (F.col("a") - expected) / F.sqrt(expected * F.lit(1 - n1 / n) * F.greatest(1 - share, F.lit(1e-3)))
    telling = {r.b for r in per.filter(F.abs(z) >= MIN_Z).select("b").collect()}  # at most 2**BITS
    frequent = [r.b for r in per.orderBy(F.desc("n"), "b").limit(PAIR_TERMS).select("b").collect()]
    per.unpersist()
    kept = np.array(sorted(telling.union(frequent)), np.int32)

    def narrow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [np.intersect1d(x, kept, assume_unique=True) for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "k", "doc_id", "toxic")), pa.array(rows, pa.list_(pa.int32()))], ["h", "k", "doc_id", "toxic", "terms"])

    got = found.select("h", "k", "doc_id", "toxic", "terms").mapInArrow(narrow, found.select("h", "k", "doc_id", "toxic", "terms").schema).toArrow()
    got = got.sort_by([(c, "ascending") for c in ("h", "doc_id", "toxic", "k")])
    terms = got.column("terms").combine_chunks()
    rows_ = np.split(terms.flatten().to_numpy(), np.cumsum(terms.value_lengths().to_numpy())[:-1])
    y = got.column("toxic").to_numpy().astype(float)
    chosen = sorted(telling | set(interacting(np.array(frequent), rows_, y)))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return chosen, [x[x >= 0] for x in (place[r] for r in rows_)], y


def interacting(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """Those of terms that with another of them tell about y more than each alone: z of sum (y - mean) (a - share of a) (b - share of b)."""
    place, k, n = np.full(1 << BITS, -1), len(terms), len(rows)
    place[terms] = np.arange(k)
    r = y - y.mean()
    single, both, count = np.zeros(k), np.zeros((k, k)), np.zeros(k)
    for s in range(0, n, 4096):
        x = np.zeros((len(part := rows[s : s + 4096]), k), np.float32)
        for i, t in enumerate(part):
            x[i, (at := place[t])[at >= 0]] = 1
        e = r[s : s + 4096, None].astype(np.float32)
        single, both, count = single + (x * e).sum(0), both + x.T @ (x * e), count + x.sum(0)
    share = count / n
    spread = r.std() * np.sqrt(n * np.outer(share * (1 - share), share * (1 - share)))
    z = np.abs(both - np.outer(share, single) - np.outer(single, share)) / np.maximum(spread, 1e-9)
    z[n * np.outer(share, share) < PAIR_ROWS] = 0
    np.fill_diagonal(z, 0)
    return terms[z.max(0, initial=0) >= PAIR_Z].tolist()


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, factors: int = FACTORS) -> Machine:
    return fit(*training(docs, labels, rows), factors)


def predict(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.chosen)
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.score([terms.of(t) for t in batch.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", DoubleType()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = predict(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
