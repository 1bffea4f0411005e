"""N-gram Jaccard self-join by chosen paths.

Documents of equal shingle sets form a class, and classes are joined. In each run a set goes into the buckets of shingles
that it samples: shingle s by set x if hash(path, s) < 1 / (`SPREAD` * threshold * |x|), the same hash for all
sets, so that two similar sets share a bucket with a known probability. A bucket of up to `LIMIT` sets is compared by brute force: sizes, one-permutation
sketches, then the shingles themselves; one of up to `BLOCK` by the shingles in one task. A larger one is split again by shingles sampled anew, as often as it takes: sets of which a share o of shingles is
common meet o / (`SPREAD` * threshold) times again on average, so what merely shares a passage dies out. Where a bucket's mean similarity, estimated from its sketches, is
so high that this is 1 or more, no split shrinks it; such a bucket is compared whole in blocks of shingle sets, which return each set's number of links and a spanning
forest, not the pairs. Runs are repeated until a pair at the threshold is met with probability `RECALL` at any depth (the sketches' bound loses under one pair in 100,000 more).
A pair that shares several buckets counts in the least of them.

Links are pairs of documents of Jaccard similarity >= threshold. A null text, an empty one or one without words has no shingles and no links; a text of 1 to 4 words
is one shingle; a very long text is one set, read whole; repeated rows are copies. A class's id is its least doc_id; rows without an id
belong to the class of their text, if a row with an id has it, and are compared with no other text. A table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import Stages, arrow_bytes, batches, table, words
from boreal.llm.components import components
from boreal.llm.shingles import mix, shingle_set

N, THRESHOLD, RECALL = 5, 0.8, 0.9998
#: Sets sample 1 / (SPREAD * THRESHOLD) shingles at each step, on average. DEPTH only ends what chance keeps large for ever.
SPREAD, LIMIT, DEPTH = 0.5, 200, 24
#: Sets, and shingles, in one block of a large bucket, about.
BLOCK, BLOCK_SHINGLES = 1200, 4_000_000
#: Shingles of two blocks that are numbered at a time, about, and bytes of an Arrow batch of any step.
SLICE, BATCH = 500_000, 4_000_000
#: Sets of a large bucket whose sketches are counted in one group, about.
PIECE = 10_000
#: Bins of the sketch, and how many standard errors below the threshold it may estimate.
BINS, ERRORS = 128, 4.5


def survival() -> float:
    """Least probability that two sets at the threshold share a bucket of one run, however often it is split: a branching process of 1 / SPREAD common children on average."""
    s = 1.0
    for _ in range(200):
        s = 1 - math.exp(-s / SPREAD)
    return s


def n_runs(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival()))


def alike_from(threshold: float) -> float:
    """The similarity from which sets of one size have one common child or more on average: o = 2 J / (1 + J) reaches SPREAD * threshold."""
    o = SPREAD * threshold
    return o / (2 - o)


def pack(s: np.ndarray) -> bytes:
    """A set in six bytes a shingle: the upper 48 bits of its hash. Two different shingles of two texts of n words agree in these with a probability of n^2 / 2^48."""
    return (s >> np.uint64(32)).astype(np.uint32).tobytes() + (s >> np.uint64(16)).astype(np.uint16).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """Ascending 48-bit numbers."""
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, np.uint16, n, 4 * n)


def split(s: np.ndarray, paths: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each path the paths of the buckets that the set s goes on to."""
    bound = min(float(2**64 - 1025), 2.0**64 / (SPREAD * threshold * len(s)))
    out = []
    for p in paths:
        g = mix(s ^ p)
        out.append(mix(s[g <= np.uint64(bound)] * np.uint64(0x9E3779B97F4A7C15) + p))
    return out


def roots(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(s: np.ndarray) -> bytes:
    """A byte for each bin of the shingles: of its least hash, 1 to 255; 0 if it is empty."""
    h = np.sort(mix(s + np.uint64(77)))
    bins, value = (h >> np.uint64(57)).astype(np.int64), (mix(h) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out = np.zeros(BINS, np.uint8)
    first = np.r_[True, bins[1:] != bins[:-1]]
    out[bins[first]] = value[first]
    return out.tobytes()


def prepared(docs: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """doc_id with the set's key (null: no shingles), size, sketch and first paths."""
    start = roots(runs)
    schema = docs.select("doc_id").schema.add("key", "long").add("n", "long").add("sketch", "binary").add("paths", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = []
            for t in batch.column("text").to_pylist():
                s = shingle_set(words(t), n)
                rows.append((xxhash.xxh64_intdigest(s.tobytes()) - 2**63, len(s), sketch(s), np.concatenate(split(s, start, threshold)).tobytes()) if len(s) else (None, 0, None, None))
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingled(docs: DataFrame, n: int) -> DataFrame:
    """key and packed set of rows (doc_id, text, key)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sets = [shingle_set(words(t), n) for t in batch.column("text").to_pylist()]
            keep = [k for k, (s, key) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if len(s) and xxhash.xxh64_intdigest(s.tobytes()) - 2**63 == key]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep, pa.int64())), pa.array([pack(sets[k]) for k in keep], pa.binary())], ["key", "set"])

    return docs.select("text", "key").mapInArrow(run, "key long, set binary")


def exploded(df: DataFrame) -> DataFrame:
    """A row for each path in the binary column paths."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            paths = [np.frombuffer(p, np.int64) for p in batch.column("paths").to_pylist()]
            at = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths) if paths else np.empty(0, np.int64)), batch.column("key").take(pa.array(at))], ["path", "key"])

    return df.select("key", "paths").mapInArrow(run, "path long, key long")


def deeper(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The next step's rows (path, key) of rows (path, key)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            out = [np.empty(0, np.uint64)]
            for path, s in zip(batch.column("path").to_pylist(), batch.column("set").to_pylist(), strict=True):
                out += split(unpack(s), np.array([path], np.int64).view(np.uint64), threshold)
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in out[1:]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), batch.column("key").take(at)], ["path", "key"])

    return rows.join(sets, "key").select("path", "key", "set").mapInArrow(run, "path long, key long")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of buckets with two sets at least, with the bucket's size."""
    rows = rows.dropDuplicates(["path", "key"])
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes.hint("merge"), "path")  # a plan for every size


def likeness(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, alike): the mean similarity of pairs in a bucket, from how often sketches agree in a quarter of their bins. A piece of a bucket is one row, the counts of each bin's values, so that nothing is made per set and bin or per pair."""

    def count(pdf):
        import pandas as pd

        values = np.stack([np.frombuffer(s, np.uint8)[::4] for s in pdf["sketch"]])
        counts = np.bincount((values + 256 * np.arange(values.shape[1])).ravel(), minlength=256 * values.shape[1])
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "counts": [counts.astype(np.uint32).tobytes()]})

    def mean(pdf):
        import pandas as pd

        c = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"]).reshape(-1, 256)[:, 1:]  # 0: an empty bin
        n = c.sum(1)
        pairs = float((n * (n - 1)).sum())
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "alike": [float((c * (c - 1)).sum()) / pairs if pairs else 0.0]})

    piece = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / PIECE)).alias("piece")
    sketches = large.select("path", "key", piece).join(classes.select("key", "sketch"), "key").select("path", "piece", "sketch")
    pieces = sketches.groupBy("path", "piece").applyInPandas(count, "path long, counts binary")
    return pieces.groupBy("path").applyInPandas(mean, "path long, alike double")


def first_shared(a: np.ndarray, b: np.ndarray) -> int:
    """The least of the paths of both."""
    return int(np.intersect1d(a, b, assume_unique=True)[0])


def bucket_pairs(path: int, keys: list[int], n: np.ndarray, sketches: np.ndarray, paths: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of a bucket that may be similar and whose least shared bucket this is."""
    out = []
    for k in range(len(keys) - 1):
        rest = slice(k + 1, len(keys))
        a, b = sketches[k], sketches[rest]
        union = ((a | b) > 0).sum(1)
        alike = ((a == b) & (a > 0)).sum(1) / union
        near = alike >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / union)
        near &= np.minimum(n[k], n[rest]) >= threshold * np.maximum(n[k], n[rest])
        for j in np.flatnonzero(near) + k + 1:
            if first_shared(paths[k], paths[j]) == path:
                out.append((min(keys[k], keys[j]), max(keys[k], keys[j])))
    return out


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (path, a, b) from rows (path, key, n, sketch, all_paths) of small buckets, read bucket by bucket in the order of path; path is the bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, current = [], None

        def flush() -> list[tuple[int, int, int]]:
            if len(group) < 2:
                return []
            keys, n, sketches, paths = zip(*group, strict=True)
            found = bucket_pairs(current, list(keys), np.array(n), np.stack([np.frombuffer(s, np.uint8) for s in sketches]), [np.frombuffer(p, np.int64) for p in paths], threshold)
            return [(current, a, b) for a, b in found]

        for batch in batches(it, 4096):
            found = []
            for path, *row in zip(*(batch.column(c).to_pylist() for c in ("path", "key", "n", "sketch", "all_paths")), strict=True):
                if path != current:
                    found += flush()
                    group, current = [], path
                group.append(row)
            yield pairs(found)
        yield pairs(flush())

    def pairs(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["path", "a", "b"])

    rows = rows.select("path", "key", "n", "sketch", "all_paths").repartition("path").sortWithinPartitions("path")
    return rows.mapInArrow(run, "path long, a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of pairs (path, a, b) whose sets are similar, by the shingles themselves. A bucket's sets are sent to it once, however many pairs they are in, and come before its pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in batches(it):
            good = []
            for path, key, other, packed_set in zip(*(batch.column(c).to_pylist() for c in ("path", "key", "other", "set")), strict=True):
                if path != current:
                    current, known = path, {}
                if other is None:
                    known[key] = packed_set
                    continue
                if key not in known or other not in known:  # a class without an id has no set
                    continue
                x, y = unpack(known[key]), unpack(known[other])
                both = len(np.intersect1d(x, y))
                if both >= threshold * (len(x) + len(y) - both):
                    good.append((key, other))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    members = pairs.select("path", F.explode(F.array("a", "b")).alias("key")).distinct()
    held = members.join(sets.hint("merge"), "key").select("path", "key", F.lit(None).cast("long").alias("other"), "set")  # a plan for every size
    rows = held.union(pairs.select("path", "a", "b", F.lit(None).cast("binary"))).repartition("path")
    return rows.sortWithinPartitions("path", F.col("other").isNotNull()).mapInArrow(run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x has in common with each of y. Ascending 48-bit numbers, as evenly spread as hashes are, come in as many equal ranges as it takes to number about `SLICE` at a time."""
    sets, width = [*x, *y], 4096
    parts = max(1, -(-sum(map(len, sets)) // SLICE))
    bounds = np.array([2**48 * k // parts for k in range(1, parts)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(s, bounds), len(s)] for s in sets]
    out = np.zeros((len(x), len(y)), np.float32)
    for k in range(parts):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        known, code = np.unique(np.concatenate(own), return_inverse=True)
        many = np.bincount(code, minlength=len(known)) > 1
        place = np.where(many, np.cumsum(many) - 1, -1)
        at = np.cumsum([0, *map(len, own)])
        columns = [c[c >= 0] for c in (place[code[a:b]] for a, b in zip(at[:-1], at[1:], strict=True))]
        for s in range(0, n := int(many.sum()), width):
            dense = np.zeros((len(columns), min(width, n - s)), np.float32)
            for j, c in enumerate(columns):
                dense[j, c[(c >= s) & (c < s + width)] - s] = 1
            out += dense[: len(x)] @ dense[len(x) :].T
    return np.rint(out)


def elsewhere(px: list[np.ndarray], py: list[np.ndarray], path: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of two blocks are in the bucket before `path` that most of them share: their pairs among each other count there."""
    before = np.concatenate([p[p < path] for p in (*px, *py)])
    if not len(before):
        return np.zeros(len(px), bool), np.zeros(len(py), bool)
    known, count = np.unique(before, return_counts=True)
    most = known[count.argmax()]
    return tuple(np.array([most in p for p in q], bool) for q in (px, py))


def compare_blocks(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links within large buckets, from rows (path, key, size, n, copies, all_paths) and sets (key, set): (key, links, other). links: the copies of sets first met here that are similar to key; other: a neighbour in a spanning forest, or null."""
    volume = rows.groupBy("path").agg(F.sum("n").alias("volume"))
    rows = rows.join(volume, "path")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(sets, "key").withColumn("blk", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other_blk", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("blk", "other_blk"), "j": F.greatest("blk", "other_blk")})

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")
        i, j, path = int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), int(pdf["path"].iat[0])
        x, y = pdf[pdf["blk"] == i], pdf[pdf["blk"] == j]
        out: list[tuple[int, int, int | None]] = []
        if len(x) and len(y):
            px, py = ([np.frombuffer(s, np.int64) for s in q["all_paths"]] for q in (x, y))
            old_x, old_y = elsewhere(px, py, path)
            nx, ny = x["n"].to_numpy(), y["n"].to_numpy()
            alike = np.zeros((len(x), len(y)), bool)
            for rows, columns in ((np.flatnonzero(~old_x), np.arange(len(y))), (np.flatnonzero(old_x), np.flatnonzero(~old_y))):
                if len(rows) and len(columns):
                    both = overlaps(*([unpack(q["set"].iat[k]) for k in at] for q, at in ((x, rows), (y, columns))))
                    alike[np.ix_(rows, columns)] = both >= threshold * (nx[rows][:, None] + ny[columns][None, :] - both)
            if i == j:
                alike = np.triu(alike, 1)
            for a, b in zip(*np.nonzero(alike), strict=True):
                if first_shared(px[a], py[b]) != path:
                    alike[a, b] = False
            kx, ky, cx, cy = x["key"].to_list(), y["key"].to_list(), x["copies"].to_numpy(), y["copies"].to_numpy()
            out += [(k, int(v), None) for k, v in zip(kx, alike @ cy, strict=True) if v] + [(k, int(v), None) for k, v in zip(ky, alike.T @ cx, strict=True) if v]
            root = {k: k for k in (*kx, *ky)}

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            for a, b in zip(*np.nonzero(alike), strict=True):
                if (p := find(kx[a])) != (q := find(ky[b])):
                    root[max(p, q)] = min(p, q)
                    out.append((kx[a], 0, ky[b]))
        return pd.DataFrame({"key": pd.array([o[0] for o in out], "Int64"), "links": pd.array([o[1] for o in out], "Int64"), "other": pd.array([o[2] for o in out], "Int64")})

    return rows.groupBy("path", "i", "j").applyInPandas(run, "key long, links long, other long")


def similarity_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per document (doc_id, class_id, n_links): the least id of its connected component, and the number of other documents similar to it."""
    with arrow_bytes(docs.sparkSession, BATCH):
        return joined(docs, n, threshold, recall)


def joined(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """similarity_join's rows. Every step in Python is written here; what is left is joins."""
    steps = Stages(docs.sparkSession, "join")
    keep = steps.keep
    base = keep(prepared(docs, n, threshold, n_runs(recall)), "docs")
    classes = keep(
        base.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "classes"
    )
    base = keep(base.select("doc_id", "key"), "keys")
    steps.drop("docs")
    pairable = classes.filter(F.col("n") >= threshold / (1 - threshold) - 1e-9)  # a smaller set is similar to equal ones alone
    rows = keep(shared(exploded(pairable)), "rows-0")
    needed = keep(rows.select("key").distinct().join(classes.select("key", "first_id"), "key"), "needed")
    texts = docs.select("doc_id", "text").join(needed.hint("merge"), F.col("doc_id") == F.col("first_id"))  # a plan for every size
    sets = shingled(texts, n)
    if base.join(needed.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("first_id"))).count() > needed.count():
        sets = sets.dropDuplicates(["key"])  # rows that share an id and a text
    sets = keep(sets, "sets")
    steps.drop("needed")
    placed, whole, written = rows.filter(F.col("size") <= LIMIT), rows.limit(0), ["rows-0"]
    for depth in range(1, DEPTH + 1):
        whole = whole.union(rows.filter((F.col("size") > LIMIT) & (F.col("size") <= BLOCK)))
        large = rows.filter(F.col("size") > F.greatest(F.lit(LIMIT), F.lit(BLOCK)))
        if large.isEmpty():
            break
        judged = keep(large.join(likeness(large, classes), "path", "left").withColumn("alike", F.coalesce("alike", F.lit(0.0))), f"large-{depth}")
        alike = (F.col("alike") >= alike_from(threshold)) | F.lit(depth == DEPTH)
        whole = whole.union(judged.filter(alike).select(*whole.columns))
        rows = keep(shared(deeper(judged.filter(~alike), sets, threshold)), f"rows-{depth}")
        placed = placed.union(rows.filter(F.col("size") <= LIMIT))
        written += [f"large-{depth}", f"rows-{depth}"]
    placed = keep(placed.withColumn("whole", F.lit(False)).union(whole.withColumn("whole", F.lit(True))).select("path", "key", "size", "whole"), "placed")
    steps.drop(*written)
    lists = placed.groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("list"))
    known = keep(packed(lists).join(classes.select("key", "n", "copies", "sketch").hint("merge"), "key"), "known")
    full = placed.join(known.hint("merge"), "key")
    pairs = keep(candidates(full.filter(~F.col("whole")), threshold), "pairs")
    links = keep(verified(pairs, sets, threshold), "links")
    steps.drop("pairs")
    blocks = keep(compare_blocks(full.filter("whole").drop("sketch"), sets, threshold), "blocks")
    steps.drop("sets", "placed", "known")
    copies = classes.select("key", "copies")
    ends = links.select(F.col("a").alias("to"), F.col("b").alias("key")).union(links.select("b", "a"))
    counts = ends.join(copies, "key").select(F.col("to").alias("key"), F.col("copies").alias("links")).union(blocks.select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    connected = components(links.union(blocks.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))))
    ids = connected.join(classes.select(F.col("key").alias("node"), "first_id"), "node")
    least = ids.groupBy("component").agg(F.min("first_id").alias("class_id"))
    result = classes.join(counts, "key", "left").join(ids.join(least, "component").select(F.col("node").alias("key"), "class_id"), "key", "left")
    result = result.select("key", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return base.select("doc_id", "key").join(result, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def packed(lists: DataFrame) -> DataFrame:
    """key with its ascending paths as 8 bytes each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([np.array(x, np.int64).tobytes() for x in batch.column("list").to_pylist()], pa.binary())], ["key", "all_paths"])

    return lists.mapInArrow(run, "key long, all_paths binary")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
