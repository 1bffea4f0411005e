"""Benchmark decontamination by a broadcast set of test n-grams.

Words are runs of digits, letters a-z (A-Z lower-cased first) and characters beyond ASCII. A window is `N` consecutive words of a test item; an item of fewer words, but not
none, is one window as a whole. The windows' hashes go to every executor with the items' normalised bytes: a filter of bits, a sorted set behind it, and the places of the windows in the bytes.
Tasks hash the windows of whole batches of documents, look them up, and verify each hit byte by byte, so that equal hashes of different words hit nothing.

The test set may be of any size: items are cut into pieces of at most `PIECE` bytes that share N - 1 words, pieces are packed into slices of at most `SLICE` bytes, and one slice is broadcast after the other, in a scan each,
whose spans and items are united with those of the scans before.

A null or empty text has no words and no hits; a very long one is read whole, alone in its batch. Rows without an id and rows that share one are documents of their own, so ties and repeated rows each get their result. A null item is none; items that share an id are
one, and an item without an id hits words but is neither counted nor listed. An empty test set hits nothing, an empty table gives none. Other columns are kept, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreal.llm.common import by_size, stage, table
from boreal.llm.shingles import MULTIPLIERS, mix

N = 10
#: Bytes of normalised test text that one broadcast holds at most, but for one longer piece, and bytes of a piece.
SLICE, PIECE = 8_000_000, 100_000
#: Scans in one job; a longer test set has a written table between every so many.
SCANS = 4
#: Bytes of documents that a task hashes at a time.
BATCH = 2_000_000
#: A-Z to a-z, ASCII that is neither letter nor digit to a space; bytes keep their places.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
RESULT = ("n_words", "spans", "items")


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def word_bounds(normal: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of a buffer of texts that begin at `cuts`."""
    inside = np.zeros(len(normal) + 2, bool)
    inside[1:-1] = normal != 32
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = cuts[(cuts > 0) & (cuts < len(normal))]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_keys(normal: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums over the buffer, `BATCH` bytes of it (or one longer word) at a time."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BATCH, "right")))
        a, b = start[lo], end[hi - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(normal[a:b] * powers(BASE, b - a), out=sums[1:])
        out[lo:hi] = mix((sums[end[lo:hi] - a] - sums[start[lo:hi] - a]) * powers(INVERSE, b - a)[start[lo:hi] - a])
        lo = hi
    return out


def window_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    m = max(len(h) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for k in range(n if m else 0):
        out = mix(out * np.uint64(0x100000001B3) + h[k : k + m] * MULTIPLIERS[k % 5])
    return out


class TestSet:
    """The windows of some pieces of items: for each window length a filter of bits, sorted hashes, and for each hash the different windows with it, as places in the pieces' bytes, and their items."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str | None, bytes]], n: int):
        self.text = b" ".join(p for _, p in pieces)
        normal = np.frombuffer(self.text, np.uint8)
        cuts = np.cumsum([0] + [len(p) + 1 for _, p in pieces])[:-1]
        start, end = word_bounds(normal, cuts)
        h = word_keys(normal, start, end)
        owner = np.searchsorted(cuts, start, "right") - 1
        words = np.bincount(owner, minlength=len(pieces)).astype(np.int64)
        first = np.cumsum(words) - words
        self.items = [i for i, _ in pieces]
        lengths = np.minimum(words, n)
        self.tables = []
        for size in np.unique(lengths[lengths > 0]).tolist():
            of = np.flatnonzero(lengths == size)
            count = words[of] - size + 1
            at = np.repeat(first[of] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            keys, item = window_keys(h, size)[at], np.repeat(of, count)
            order = np.lexsort((at, keys))
            self.tables.append(self.table(size, keys[order], start[at[order]], end[at[order] + size - 1], item[order]))

    def table(self, size: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, item: np.ndarray):
        unique, run = np.unique(keys, return_index=True)
        classes: list[list[tuple[int, int, tuple[str, ...]]]] = []
        for lo, hi in zip(run.tolist(), [*run[1:].tolist(), len(keys)], strict=True):
            found: dict[bytes, tuple[int, int, set[str]]] = {}
            for k in range(lo, hi):
                one = found.setdefault(self.text[a[k] : b[k]], (int(a[k]), int(b[k]), set()))
                if (name := self.items[item[k]]) is not None:
                    one[2].add(name)
            classes.append([(x, y, tuple(names)) for x, y, names in found.values()])
        bits = max(16, min(26, (16 * len(unique)).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[(unique >> np.uint64(64 - bits)).astype(np.int64)] = True
        return size, bits, seen, unique, classes

    def hits(self, text: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, items) of each window that occurs. text: normalised documents, doc: the document of each word."""
        for size, bits, seen, unique, classes in self.tables:
            keys = window_keys(h, size)
            at = np.flatnonzero(seen[(keys >> np.uint64(64 - bits)).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]]
            place = np.minimum(np.searchsorted(unique, keys[at]), len(unique) - 1)
            match = unique[place] == keys[at]
            for k, p in zip(at[match].tolist(), place[match].tolist(), strict=True):
                words = b" ".join(text[start[j] : end[j]] for j in range(k, k + size))
                for a, b, names in classes[p]:
                    if self.text[a:b] == words:
                        yield k, size, names


def pieces(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id as string, piece: normalised words with single spaces between) of the items that have words; pieces of one item share n - 1 words, so that each of its windows lies in one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(it, "text"):
            names, found = [], []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split(b" ")
                ws = [w for w in ws if w]
                lo = 0
                while lo < len(ws):
                    hi, size = min(lo + n, len(ws)), sum(map(len, ws[lo : lo + n])) + n
                    while hi < len(ws) and size < PIECE:
                        size += len(ws[hi]) + 1
                        hi += 1
                    names.append(name)
                    found.append(b" ".join(ws[lo:hi]))
                    lo = hi - n + 1 if hi < len(ws) else hi
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["item_id", "piece"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, piece binary")


def slices(items: DataFrame, n: int = N, size: int = SLICE) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces of the test set, at most `size` bytes of them at a time (or one piece), so that what the driver holds and sends is bounded. The slice of a piece comes from sums within a thousand groups of pieces by hash and over these groups."""
    cut = stage(pieces(items, n).distinct().withColumns({"group": F.pmod(F.xxhash64("piece"), F.lit(1024)), "bytes": F.length("piece").cast("long") + 1}), "op13-pieces")
    within = F.sum("bytes").over(Window.partitionBy("group").orderBy("piece", "item_id")) - F.col("bytes")
    groups = cut.groupBy("group").agg(F.sum("bytes").alias("n"))  # 1,024 rows at most
    groups = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    placed = stage(cut.join(F.broadcast(groups), "group").select("item_id", "piece", F.floor((F.col("before") + within) / size).alias("slice")), "op13-slices")
    last = placed.agg(F.max("slice")).first()[0]
    for k in range(0 if last is None else last + 1):
        if part := placed.filter(F.col("slice") == k).orderBy("piece", "item_id").collect():
            yield [(r.item_id, bytes(r.piece)) for r in part]


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first word, end word, first byte, end byte), sorted, those that overlap or touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], d)
        else:
            out.append((a, b, c, d))
    return out


SPANS = "array<struct<first:int,end:int,first_byte:long,end_byte:long>>"


def scan(docs: DataFrame, tests: TestSet) -> DataFrame:
    """docs (text, n_words, spans, items and other columns) with what the windows of `tests` hit added to the last three."""
    held, schema = docs.sparkSession.sparkContext.broadcast(tests), docs.schema
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])), pa.list_(pa.string())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = held.value
        for batch in by_size(it, "text", 4096, BATCH):
            column = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            sizes = np.array(pc.binary_length(column).to_numpy(zero_copy_only=False), np.int64)
            text = b"".join(column.to_pylist()).translate(NORMAL)
            cuts = np.cumsum(sizes) - sizes
            normal = np.frombuffer(text, np.uint8)
            start, end = word_bounds(normal, cuts)
            own = np.flatnonzero(sizes)  # texts without a byte hold no word
            doc = own[np.searchsorted(cuts[own], start, "right") - 1] if len(own) else start
            count = np.bincount(doc, minlength=len(sizes)).astype(np.int64)
            first = np.cumsum(count) - count
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for k, size, names in tests.hits(text, word_keys(normal, start, end), start, end, doc):
                d = int(doc[k])
                a = k - int(first[d])
                spans.setdefault(d, []).append((a, a + size, int(start[k] - cuts[d]), int(end[k + size - 1] - cuts[d])))
                items.setdefault(d, set()).update(names)
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for d, found in spans.items():
                old_spans[d] = [dict(zip(("first", "end", "first_byte", "end_byte"), s, strict=True)) for s in merged([tuple(s.values()) for s in old_spans[d]] + found)]
                old_items[d] = sorted({*old_items[d], *items[d]})
            new = dict(zip(RESULT, (pa.array(x, t) for x, t in zip((count, old_spans, old_items), kinds, strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(j)) for j, c in enumerate(batch.schema.names)], schema.names)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, size: int = SLICE) -> DataFrame:
    """docs (text and other columns) with n_words, spans (word and byte ranges that test windows hit, merged) and items (ids of the items whose windows occur, sorted as strings)."""
    found = docs.drop(*RESULT).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    done = 0
    for part in slices(items, n, size):
        if done and done % SCANS == 0:
            found = stage(found, "op13-scan")
        found, done = scan(found, TestSet(part, n)), done + 1
    return found if done else scan(found, TestSet([], n))


def n_hit() -> Column:
    """Words in the spans of a row."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def without_spans(found: DataFrame) -> DataFrame:
    """The rows of contaminated() with the bytes of their spans cut out of text; all others as they are."""
    schema = found.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(it, "text"):
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, at, kept = texts[k].encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        kept.append(raw[at : s["first_byte"]])
                        at = s["end_byte"]
                    texts[k] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(j) for j, c in enumerate(schema.names)], schema.names)

    return found.mapInArrow(run, schema)


def without_documents(found: DataFrame, share: float = 0.0) -> DataFrame:
    """The rows of contaminated() of whose words at most the given share was hit."""
    return found.filter(n_hit() <= F.lit(share) * F.col("n_words"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS words FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw))
), hit AS (
  SELECT dw.r, dw.p, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.words = bw.words
), n AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
