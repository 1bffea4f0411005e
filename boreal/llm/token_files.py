"""Token files: ids in patched frame-of-reference blocks, written in document order and read back.

A shard file holds, in this order: the magic `PFR1`; blocks of `BLOCK` ids (the last may be shorter);
the footer: for each block its start in the file, for each document its end among the shard's ids; then the
lengths of both and the magic again. A block holds its count, its minimum, a bit width and the number of exceptions; the
ids less the minimum, packed at that width, the least that holds `PERCENTILE` per cent of them; then the places
and whole values of those that need more bits. Any block can be read by itself through its start.

Documents are range-partitioned and sorted by id, so shards and their contents ascend; equal ids are
ordered by text, null ids come first, repeated rows are written one after the other. A null text is empty and holds the end id alone; a very long one
spans as many blocks as it takes. A table without rows gives no documents; other columns are ignored. Ids of documents lie beside a shard in a file of their own. A task that is run again
writes another file; only files named in the manifest, which finished tasks return, are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreal.llm.bpe import vocabulary_path
from boreal.llm.common import by_size, new_folder, stage, table

#: Vocabulary of op10, a file of the public tokenizers, and the id that ends a document.
VOCABULARY, END = "word_bpe_49k.json", 1
BLOCK, PERCENTILE, MAGIC = 4096, 95, b"PFR1"
#: Chunks of text whose ids a worker keeps, and how many go through the library as one text.
CACHE, TOGETHER = 1_200_000, 200
PUNCTUATION = b".,;:!?%*$&#|()"


def pack(ids: np.ndarray) -> bytes:
    """One block; ids: at least one and at most 65,535 unsigned 32-bit integers."""
    least = int(ids.min())
    rest = ids.astype(np.int64) - least
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    over = np.flatnonzero(rest >> width)
    bits = (rest[:, None] >> np.arange(width)) & 1
    head = np.array([len(ids), least, width, len(over)], "<u4").tobytes()
    return head + np.packbits(bits.astype(np.uint8), axis=None).tobytes() + over.astype("<u2").tobytes() + ids[over].astype("<u4").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n, least, width, over = map(int, np.frombuffer(raw, "<u4", 4))
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, 16), count=n * width).reshape(n, width)
    ids = bits.astype(np.int64) @ (1 << np.arange(width)) + least
    ids[np.frombuffer(raw, "<u2", over, 16 + size)] = np.frombuffer(raw, "<u4", over, 16 + size + 2 * over)
    return ids.astype("<u4")


class Writer:
    """Blocks go out as they fill; what stays in memory is one block and the two indexes."""

    def __init__(self, sink):
        self.sink, self.at, self.starts, self.ends, self.total, self.wait = sink, len(MAGIC), [], [], 0, np.empty(0, np.int64)
        sink.write(MAGIC)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids follow each other in ids and end at ends."""
        self.ends.append(self.total + ends)
        self.total += len(ids)
        self.wait = np.concatenate([self.wait, ids])
        full = len(self.wait) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self.block(self.wait[k : k + BLOCK])
        self.wait = self.wait[full:]

    def block(self, ids: np.ndarray) -> None:
        raw = pack(ids)
        self.starts.append(self.at)
        self.at += len(raw)
        self.sink.write(raw)

    def close(self) -> None:
        if len(self.wait):
            self.block(self.wait)
        starts, ends = np.array([*self.starts, self.at], "<u8"), np.concatenate([np.empty(0, np.int64), *self.ends]).astype("<u8")
        self.sink.write(starts.tobytes() + ends.tobytes() + np.array([len(starts), len(ends)], "<u8").tobytes() + MAGIC)


class Reader:
    """A shard by its documents, a block in memory at a time."""

    def __init__(self, source, size: int):
        self.source, tail = source, 16 + len(MAGIC)
        end = source.read_at(tail, size - tail)
        assert end[16:] == MAGIC and source.read_at(len(MAGIC), 0) == MAGIC, "not a token file"
        n, m = map(int, np.frombuffer(end, "<u8", 2))
        index = np.frombuffer(source.read_at(8 * (n + m), size - tail - 8 * (n + m)), "<u8").astype(np.int64)
        self.starts, self.ends, self.kept = index[:n], index[n:], (-1, None)

    def block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            a, b = map(int, self.starts[k : k + 2])
            self.kept = (k, unpack(self.source.read_at(b - a, a)))
        return self.kept[1]

    def pieces(self, first: int, end: int) -> Iterator[np.ndarray]:
        """The ids from first to before end, block by block."""
        while first < end:
            k, at = divmod(first, BLOCK)
            piece = self.block(k)[at : at + end - first]
            yield piece
            first += len(piece)

    def documents(self) -> Iterator[tuple[int, int]]:
        yield from zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=False)


class Chunks:
    """White-space-delimited chunk of a text, as bytes -> its ids. The vocabulary drops white space, and neither its normaliser nor its pattern looks beyond it, so a text's ids are its chunks' in a row. Ids lie in one array: known gives a chunk's number, start and n its place."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Tokenizer(self.library.model)  # for words that neither the normaliser nor the pattern changes or splits
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.n, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    def put(self, chunks: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        """Chunks that are new, with their ids in a row and how many each has."""
        first, end = len(self.known), len(self.known) + len(chunks)
        while end > len(self.n):
            self.start, self.n = np.concatenate([self.start, self.start]), np.concatenate([self.n, self.n])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.n[first:end], self.start[first:end] = n, self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.known.update(zip(chunks, range(first, end), strict=True))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks by number, in a row, and how many each has."""
        n = self.n[at]
        return self.ids[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def learn(self, chunks: list[bytes]) -> None:
        """Words of small letters go through the library many at a time, as each is one pretoken and ends with one end-of-word id; those in ASCII are written in a byte-level vocabulary as they are, and need only its merges."""
        ascii_words, words, rest = [], [], []
        for c in chunks:
            if c.isalpha() and c.islower():
                ascii_words.append(c)
            elif (t := c.decode("utf-8", "surrogatepass")).isalpha() and t.islower() and max(t) < "\u0300":
                words.append(c)
            else:
                rest.append(c)
        for plain, encode in ((ascii_words, self.merges.encode_batch_fast), (words, self.library.encode_batch_fast)):
            groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
            for group, e in zip(groups, encode([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(group):
                    self.put(group, ids, np.diff(ends, prepend=0))
                else:
                    rest += group
        if rest:
            found = self.library.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in rest], add_special_tokens=False)
            self.put(rest, np.array([i for e in found for i in e.ids], np.int32), np.array([len(e.ids) for e in found], np.int64))

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids with their end ids, in one array, and where each text ends. Each different chunk of the texts is looked up once."""
        if len(self.known) > CACHE:
            self.forget()
        split = pc.ascii_split_whitespace(pa.array([self.lowered(t) for t in texts], pa.binary()).view(pa.string()))  # an empty chunk at an end has no ids
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        new = [chunks[k] for k in missing]
        two = [(c, w, c[len(w) :]) for c in new if len(w := c.rstrip(PUNCTUATION)) < len(c) and w.isalpha() and w.islower()]
        apart = {c for c, _, _ in two}
        parts = {x for _, w, p in two for x in (w, p)}.union(c for c in new if c not in apart).difference(self.known)
        if parts:
            self.learn(list(parts))
        if two:  # a run of letters, then one of marks: two pretokens
            ids, n = self.take(np.array([self.known[x] for _, w, p in two for x in (w, p)], np.int64))
            self.put([c for c, _, _ in two], ids, n.reshape(-1, 2).sum(1))
        at[missing] = [self.known[c] for c in new]
        ids, n = self.take(at[coded.indices.to_numpy()])
        text_of = np.repeat(np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())), n)
        out = np.full(len(ids) + len(texts), END, np.int64)
        out[np.arange(len(ids)) + text_of] = ids
        return out, np.cumsum(np.bincount(text_of, minlength=len(texts)) + 1)

    @staticmethod
    def lowered(text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "surrogatepass")
        # lower case first, if nothing can compose with a letter (from U+0300 on, whose first byte is 0xCC) or be an added token
        return raw.lower() if b"<|" not in raw and (text.isascii() or np.frombuffer(raw, np.uint8).max() < 0xCC) else raw


_loaded: dict[str, Chunks] = {}


def chunks_of(vocabulary: str) -> Chunks:
    """One for each Python worker. Tasks must reach it through this function: a closure that names _loaded itself carries a copy."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Chunks(vocabulary)
    return _loaded[vocabulary]


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode docs into the folder's shard files. The manifest: shard, file, bytes, n_docs, n_tokens, and first (ids in the shards before)."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        chunks = chunks_of(vocabulary)
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, n, ids = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.pfr", 0, []
        with store.open_output_stream(f"{root}/{name}") as sink:
            out = Writer(sink)
            for batch in by_size(it, "text", 512):
                out.add(*chunks.ids_of(batch.column("text").to_pylist()))
                ids.append(batch.column("doc_id"))
                n += batch.num_rows
            out.close()
        keys = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        with store.open_output_stream(f"{root}/{name}.ids") as sink, pa.ipc.new_stream(sink, pa.schema([("doc_id", keys.type)])) as w:
            w.write_table(pa.table({"doc_id": keys}), max_chunksize=65_536)
        size = store.get_file_info(f"{root}/{name}").size
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "bytes": pa.array([size], pa.int64()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([out.total], pa.int64())})

    made = stage(ordered.mapInArrow(run, "shard long, file string, bytes long, n_docs long, n_tokens long"), "pfr-manifest")
    return made.withColumn("first", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def read(manifest: DataFrame, folder: str, doc_id: str = "long") -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in it:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f, store.open_input_stream(f"{root}/{row['file']}.ids") as keys:
                    shard = Reader(f, row["bytes"])
                    documents = shard.documents()
                    for part in pa.ipc.open_stream(keys):
                        start, n, crc = [], [], []
                        for _, (a, b) in zip(range(part.num_rows), documents, strict=False):
                            value = 0
                            for piece in shard.pieces(a, b):
                                value = zlib.crc32(piece.tobytes(), value)
                            start.append(row["first"] + a)
                            n.append(b - a)
                            crc.append(value)
                        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (start, n, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.filter("n_docs > 0").repartition(4 * n, "shard").mapInArrow(run, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pfr")
    return read(write(docs, folder), folder, docs.schema["doc_id"].dataType.simpleString())
