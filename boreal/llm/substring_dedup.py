"""Substring deduplication: matching statistics of documents in suffix automata of reference shards.

A word is removed if some window of `WINDOW` words that covers it also starts in a document with a smaller
id. Reference text grows with the corpus, so its automata are not sent to every executor; a window goes to the shard of its
minimizer, the least hash among its `K`-grams, and equal windows have equal minimizers. Runs of windows with one minimizer, with
their words, are segments. Only segments whose minimizer occurs in two different texts are kept;
equal segments collapse to one with its least document before they meet. Per minimizer an automaton takes the segments in ascending order
of document: each is first streamed against it for matching statistics, then added unless it holds nothing new.
Minimizers with over `HOT` different segments are dealt out again window by window, by the whole window: equal windows then collapse to one row before any shuffle, however many there are.

A document of the same text as one with a smaller id loses all its words if it has `WINDOW` at least. A null text is empty. A row without an id is no reference
and loses what the first document of its text loses, nothing where no row with an id has its text. Rows that share an id never remove each other's words; repeated rows get the same result. Texts of under `WINDOW` words stay
whole, very long ones are read whole, a table without rows gives none, other columns are kept, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.automaton import SuffixAutomaton
from boreal.llm.common import batches, by_size, new_folder, release, remove, table, words
from boreal.llm.shingles import ngrams, word_hashes

WINDOW, K = 13, 6
#: Different segments that one minimizer may have in an automaton.
HOT = 1_000


def segments(texts: list[list[bytes]], window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, minimizer, first window and number of windows of each segment of texts given as words; all texts are hashed in one array, and windows across two of them left out."""
    length = np.array([len(t) for t in texts], np.int64)
    g = ngrams(word_hashes([w for t in texts for w in t]), k).view(np.int64)
    width, span = 1, window - k + 1
    while width < span:  # least of each `width` k-grams, up to `span` of them
        step = min(width, span - width)
        g, width = np.minimum(g[:-step], g[step:]), width + step
    offset = np.cumsum(length) - length
    many = np.maximum(length - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    least = g[np.repeat(offset, many) + start] if len(text) else np.empty(0, np.int64)
    at = np.flatnonzero((start == 0) | (least != np.roll(least, 1)))
    return text[at], least[at], start[at], np.diff(np.r_[at, len(text)])


def minimizers(docs: DataFrame) -> DataFrame:
    """(h, th): each text's minimizers; docs: th (hash of the text), text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(it, "text"):
            text, h, _, _ = segments([words(t) for t in batch.column("text").to_pylist()])
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.flatnonzero((text != np.roll(text, 1)) | (h != np.roll(h, 1)) | (np.arange(len(h)) == 0))  # each once a text
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), batch.column("th").take(pa.array(text[new]))], ["h", "th"])

    return docs.mapInArrow(run, "h long, th long")


def content_hash(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) - 2**63


def extract(docs: DataFrame) -> DataFrame:
    """The shared segments of docs (doc_id, tk, text, shared: minimizers)."""
    schema = docs.select("doc_id", "tk").schema.add("h", "long").add("ch", "long").add("start", "integer").add("n", "integer").add("content", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(it, "text"):
            at, rows = [], []
            texts = [words(t) for t in batch.column("text").to_pylist()]
            shared = [set(s) for s in batch.column("shared").to_pylist()]
            for k, h, a, c in zip(*(x.tolist() for x in segments(texts)), strict=True):
                if h in shared[k]:
                    content = b" ".join(texts[k][a : a + c + WINDOW - 1])
                    at.append(k)
                    rows.append((h, content_hash(content), a, c, content))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tk").take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    return docs.mapInArrow(run, schema)


def by_window(found: DataFrame) -> DataFrame:
    """Segments cut into single windows, each under a key of its own, the hash of the whole window."""
    names = found.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            at, rows = [], []
            for k, (start, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "content")), strict=True)):
                ws = content.split(b" ")
                for i in range(len(ws) - WINDOW + 1):
                    part = b" ".join(ws[i : i + WINDOW])
                    at.append(k)
                    rows.append((content_hash(part), content_hash(part), start + i, 1, part))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tk").take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return found.mapInArrow(run, found.schema)


def contents_of(found: DataFrame) -> DataFrame:
    """Each different segment of a minimizer, with the least document that has it."""
    return found.groupBy("h", "ch").agg(F.min("doc_id").alias("least"), F.first("content").alias("content"))


def older_windows(contents: DataFrame) -> DataFrame:
    """(h, ch, least, older): a byte for each window of the segment, 1 if a document before `least` has it; null if none is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, automaton = None, None, None

        def older(h: int, least: int, content: bytes) -> bytes | None:
            nonlocal current, held, automaton
            if h != current:
                current, held, automaton = h, (content, least), None  # an automaton only once a second segment comes
                return None
            if automaton is None:
                automaton = SuffixAutomaton()
                automaton.add(held[0].split(b" "), held[1])
            ws = content.split(b" ")
            flags = bytes(f is not None and f < least for f in automaton.windows(ws, WINDOW))
            if not all(flags):
                automaton.add(ws, least)
            return flags if any(flags) else None

        for batch in batches(it, 4096):
            found = [older(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("h", "least", "content")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("ch"), batch.column("least"), pa.array(found, pa.binary())], ["h", "ch", "least", "older"])

    schema = contents.select("h", "ch", "least").schema.add("older", "binary")
    return contents.select("h", "ch", "least", "content").repartition("h").sortWithinPartitions("h", "least", "ch").mapInArrow(run, schema)


def removed_words(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words the removed windows of spans (start, n, older; older null: every window) cover."""
    hit = np.zeros(n + 1, np.int64)
    for s in spans:
        a = s["start"]
        if s["older"] is None:
            hit[a] += 1
            hit[a + s["n"] + WINDOW - 1] -= 1
        else:
            at = a + np.flatnonzero(np.frombuffer(s["older"], np.uint8))
            np.add.at(hit, at, 1)
            np.add.at(hit, at + WINDOW, -1)
    return np.cumsum(hit)[:n] > 0


def spans_of(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(tk, first_id, spans) of every text, and the folders to remove once that is read: what is removed from its first document."""
    spark, folders = docs.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        folders.append(folder := new_folder(spark, f"substring-{tag}"))
        df.write.parquet(folder, compression="zstd")
        release(spark)
        return spark.read.schema(df.schema).parquet(folder)

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tk"), F.xxhash64(text).alias("th"))
    firsts = kept(keyed.groupBy("tk", "th").agg(F.min("doc_id").alias("first_id")), "firsts")
    found = kept(minimizers(keyed.select("th", "text")), "minimizers")
    shared = kept(found.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b").select("h"), "shared")
    lists = kept(found.join(shared, "h", "left_semi").groupBy("th").agg(F.collect_set("h").alias("shared")), "lists")
    remove(spark, *folders[1:3])
    with_shared = firsts.join(lists, "th").select(F.col("tk").alias("k"), "first_id", "shared")
    parts = kept(extract(keyed.join(with_shared, (F.col("tk") == F.col("k")) & (F.col("doc_id") == F.col("first_id"))).select("doc_id", "tk", "text", "shared")), "segments")
    remove(spark, folders[3])
    contents = kept(contents_of(parts), "contents")
    hot = kept(contents.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("h"), "hot")
    if not hot.isEmpty():
        parts = kept(parts.join(hot, "h", "left_anti").select(*parts.columns).union(by_window(parts.join(hot, "h", "left_semi").select(*parts.columns))), "segments")
        contents = kept(contents_of(parts), "contents")
    older = kept(older_windows(contents), "older").withColumnRenamed("ch", "c").withColumnRenamed("h", "hh")
    gone = parts.drop("content").join(older, (F.col("h") == F.col("hh")) & (F.col("ch") == F.col("c"))).filter("doc_id > least OR older IS NOT NULL")
    spans = gone.groupBy("tk").agg(F.collect_list(F.struct("start", "n", F.when(F.col("doc_id") == F.col("least"), F.col("older")).alias("older"))).alias("spans"))
    out = kept(firsts.join(spans, "tk", "left").select("tk", "first_id", "spans"), "spans")
    remove(spark, *[f for f in folders[:-1]])
    return out, folders[-1:]


def deduplicate(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs' columns but text, with n_words, n_removed and kept_sha256, the digest of the kept words joined by spaces; if asked for with that as text, or the text as it was if nothing is removed."""
    added = ["n_words", "n_removed", "kept_sha256", *["text"] * keep_text]
    rest = [c for c in docs.columns if c not in (*added, "text")]
    spans, _ = spans_of(docs)
    keyed = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("__text"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__tk"))
    joined = keyed.join(spans.select(F.col("tk").alias("__k"), F.col("first_id").alias("__first"), F.col("spans").alias("__spans")), F.col("__tk") == F.col("__k"))
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = schema.add("text", "string") if keep_text else schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            out: list[tuple[int, int, str, str]] = []
            for doc, first, t, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__first", "__text", "__spans")), strict=True):
                ws, n = words(t), 0
                if first is not None and doc is not None and doc > first and len(ws) >= WINDOW:
                    n, left = len(ws), []
                else:
                    left = ws
                    if s:
                        gone = removed_words(len(ws), s)
                        n, left = int(gone.sum()), [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                kept = b" ".join(left)
                out.append((len(ws), n, sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if n else t))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays[: len(added)]], schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in rest], "__text", "__first", "__spans").mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
