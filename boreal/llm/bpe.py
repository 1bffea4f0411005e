"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A pretoken's bytes form a doubly linked list of symbols. The queue holds (rank, place) of each adjacent pair that
has a merge; the least is popped, skipped if the pair at that place has changed since, else merged, and the two new pairs
are pushed. Decoding concatenates the vocabulary's byte strings. Each Python worker keeps the ids
of pretokens that it has met in a bounded dictionary.

A null text is empty and has no ids; texts of any length are encoded whole; repeated rows give repeated results, rows without an id are encoded like others, and a table without rows gives none;
added tokens in a text are found first, as the vocabulary file says. Columns besides the id are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from boreal.llm.common import batches, table

#: Vocabulary of op9, a file of the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: Pretokens whose ids a worker keeps.
CACHE = 400_000


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare name is a file of the public tokenizers, found where this process runs."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe(dict):
    """Pretoken -> tuple of ids; a missing one is encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.strings = {k: bytes(letters[c] for c in s) for s, k in vocab.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {k: s.encode() for s, k in added.items()}
        self.added, self.added_split = added, regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {vocab[a] << 24 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        #: The two regular expression engines may hold different Unicode versions: a character is compared when first met.
        self.other, self.same, self.odd = ByteLevel(add_prefix_space=False, use_regex=True), set(), set()

    def pretokens(self, text: str) -> list[str]:
        chars = set(text)
        if not chars <= self.same:
            for c in chars - self.same - self.odd:
                probe = f"a{c}1 {c}{c}!"
                (self.same if [probe[a:b] for _, (a, b) in self.other.pre_tokenize_str(probe)] == self.find(probe) else self.odd).add(c)
            if chars & self.odd:
                return [text[a:b] for _, (a, b) in self.other.pre_tokenize_str(text)]
        return self.find(text)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = self.merge(word.encode("utf-8", "surrogatepass"))
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ids, merges = [self.byte_id[b] for b in raw], self.merges
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [m[0] << 32 | k for k in range(n - 1) if (m := merges.get(ids[k] << 24 | ids[k + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            k = entry & 0xFFFFFFFF
            j = after[k]
            if ids[k] < 0 or j >= n or not (m := merges.get(ids[k] << 24 | ids[j])) or m[0] != entry >> 32:
                continue  # stale: the pair that stood here is gone
            ids[k], ids[j] = m[1], -1
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if m := merges.get(ids[k] << 24 | ids[nxt]):
                    heapq.heappush(queue, m[0] << 32 | k)
            if (p := before[k]) >= 0 and (m := merges.get(ids[p] << 24 | ids[k])):
                heapq.heappush(queue, m[0] << 32 | p)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.added_split and any(a in text for a in self.added):
            return list(chain.from_iterable([self.added[part]] if part in self.added else self.encode_plain(part) for part in self.added_split.split(text) if part))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable([self[w] for w in self.pretokens(text)]))

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[k] for k in ids]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def model(vocabulary: str) -> Bpe:
    """The vocabulary's encoder, one for each Python worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Bpe(vocabulary_path(vocabulary))
    return _loaded[vocabulary]


def digests(ids: list[int], text: str) -> tuple[int, str, str]:
    return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """doc_id with n_tokens, ids (if asked for), ids_sha256 and decoded_sha256, the digest of the text decoded from the ids."""
    schema = docs.select("doc_id").schema.add("n_tokens", "long")
    schema = (schema.add("ids", ArrayType(IntegerType())) if ids else schema).add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches(it, 64):
            coded = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            n, a, b = zip(*(digests(x, bpe.decode(x)) for x in coded), strict=True)
            columns = [pa.array(n, pa.int64()), *([pa.array(coded, pa.list_(pa.int32()))] if ids else []), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), VOCABULARY, ids=False)
