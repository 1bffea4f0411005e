import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from boreal.llm import bpe, token_files
from boreal.llm.common import new_folder

TEXTS = [None, "", " ", "Hello, the theory's  end.\n\n\tTabs", "a" * 3000, "né à l'École 12345 ½ ́x H̱ Å", "<|endoftext|> x<|endoftext|>", "<|StartOfText|> <|startoftext|>", "日本語 テスト 🙂🙂 ՘՘ \x1c \x85 ᠎", "the the", "the the", "x %%% y$$$, z!?\r\n", "don't DON'T we'll 's s"]


def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_bpe_equals_library(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encode(docs(spark)).collect()}
    for k, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids, text
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs(spark).limit(0)).count() == 0


def test_bpe_on_whole_table(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op9_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(1), np.full(4096, 7), rng.integers(0, 50_000, 4096), np.r_[rng.integers(5, 9, 100), 2**32 - 1], np.array([2**32 - 1])):
        ids = ids.astype(np.int64)
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def expected(rows):
    t, at, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for k, text in sorted(rows, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_library(spark):
    folder = new_folder(spark, "pfr")
    got = sorted(map(tuple, token_files.read(token_files.write(docs(spark), folder), folder).collect()))
    assert got == expected(list(enumerate(TEXTS)))
    assert token_files.read(token_files.write(docs(spark).limit(0), folder), folder).count() == 0


def test_token_files_null_and_repeated_ids(spark):
    """Null ids come first, repeated ids by text, and a document may span blocks."""
    long = " ".join(f"word{k % 977}" for k in range(9000))
    rows = [(None, "null id"), (5, "b"), (5, "a"), (5, "a"), (1, long), (None, None)]
    folder = new_folder(spark, "pfr")
    got = token_files.read(token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder), folder).orderBy("start").collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in order]
    assert [r.doc_id for r in got] == [k for k, _ in order] and max(map(len, ids)) > 2 * token_files.BLOCK
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def test_each_chunk_of_a_batch_is_looked_up_once():
    """Repeated chunks cost one lookup a batch; ids equal the library's for white space at the ends and between, marks and letters beyond ASCII."""

    class Counted(dict):
        lookups = 0

        def get(self, *a):
            Counted.lookups += 1
            return super().get(*a)

    t, chunks = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_files.Chunks("word_bpe_49k.json")
    texts = ["  the cat\x0b sat,\x0c sat ", None, "", " \t\r\n", "été\x1cété naïve straße Été", "THE don't zqxjvk zqxjvk... ﬁ a\u0300b", "n" * 300] * 200
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    for _ in range(2):
        chunks.known = Counted(chunks.known)
        Counted.lookups = 0
        got, ends = chunks.ids_of(texts)
        assert got.tolist() == [i for x in ids for i in x] and ends.tolist() == np.cumsum([len(x) for x in ids]).tolist()
        assert Counted.lookups <= len({w for x in texts if x for w in x.encode().split()}) + 3


def test_token_files_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, token_files.op10_token_files(spark, sf).collect())) == expected(rows)


def test_bpe_null_ids_and_very_long_texts(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    long = "".join(f"word{k % 977} né{k} " for k in range(60_000)) + "x" * 20_000
    rows = [(None, "no id"), (None, None), (7, long), (7, long), (8, "tie"), (8, "tie")]
    got = sorted(((r.doc_id, tuple(r.ids)) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=repr)
