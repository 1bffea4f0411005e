"""Language identification as multilingual mixture inference.

Each learned language is a distribution over hashed letter trigrams. A document's trigrams are taken as draws from a mixture
of languages whose proportions expectation-maximisation estimates. The set of languages starts with the likeliest one
and takes in the one along which the likelihood rises most, as long as the gain in log-likelihood exceeds
`PENALTY` * ln(trigrams). The prediction is the language with the largest proportion, its score that proportion.

A text that is null, empty or without a letter is `und`, with score 0. Where nothing was learned every
text is `und`. Repeated rows get the same answer, rows without an id are judged like others and teach nothing, ties go to the smaller language code, other columns are kept, but for those named like a result, and a
table without rows gives none. Texts are read whole, whatever their length. Any number of languages can be learned: beyond `SLICE` of them their
distributions lie in files of that many in the shared folder, of which a worker holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import batches, crc_mod, new_folder, stage, table

BUCKETS = 1 << 13
#: Languages whose distributions the driver or a worker holds at a time.
SLICE = 256
SMOOTH, PENALTY, STEPS, ENOUGH = 0.5, 5.0, 30, 1e-4
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """The buckets of a text's letter trigrams, in lower case, each run of other characters as one space, with a space before and after; empty if there is no letter."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, c, 32).astype(np.uint64)
    keep = letter | np.r_[True, letter[:-1]]
    c = np.r_[np.uint64(32), c[keep], np.uint64(32)]
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64)  # 13 bits


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray | list[str]]:
    """Languages in order and their trigram probabilities, from every row of docs (text, lang) that has both: one matrix, or the files of its slices."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at, "n": n[at]})
            total.clear()

        for batch in batches(it):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if len(g := grams(text)):
                    if lang not in total and len(total) >= SLICE:
                        yield from flush()
                    total[lang] = total.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
        yield from flush()

    spark = docs.sparkSession
    counts = stage(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # their names alone

    def matrix(names: list[str]) -> np.ndarray:
        rows = counts.filter(F.col("lang").isin(names)).toPandas()
        n = np.zeros((BUCKETS, len(names)))
        n[rows["bucket"], [names.index(x) for x in rows["lang"]]] = rows["n"]
        return (n + SMOOTH) / (n.sum(0) + SMOOTH * BUCKETS)

    if len(langs) <= SLICE:
        return langs, matrix(langs)
    files, folder = [], new_folder(spark, "langid-model")
    for k in range(0, len(langs), SLICE):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{k}.npy") as out:
            out.write(matrix(langs[k : k + SLICE]).tobytes())
        files.append(f"{folder}/{k}.npy")
    return langs, files


def slices_of(prob: np.ndarray | list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each slice of the model with the number of its first language."""
    if isinstance(prob, np.ndarray):
        yield 0, prob
        return
    for name in prob:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_stream(path) as f:
            yield int(name.rsplit("/", 1)[1].split(".")[0]), np.frombuffer(f.read()).reshape(BUCKETS, -1)


def proportions(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """The mixture proportions of the columns of p that suit the counts n, from those in share, and the log-likelihood."""
    for _ in range(STEPS):
        new = share * (p.T @ (n / (p @ share))) / n.sum()
        done = np.abs(new - share).max() < ENOUGH
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


class Text:
    """A text's trigrams, and the languages chosen for it so far: their numbers, probabilities, proportions and the likelihood."""

    def __init__(self, g: np.ndarray):
        n = np.bincount(g, minlength=BUCKETS)
        self.at = np.flatnonzero(n)
        self.n = n[self.at].astype(float)
        self.chosen, self.p, self.share, self.likelihood = [], np.empty((len(self.at), 0)), np.empty(0), -np.inf
        self.penalty, self.best = PENALTY * np.log(self.n.sum() + 1), None

    def look(self, first: int, prob: np.ndarray) -> None:
        """Remember the language of this slice that promises most, if none before does."""
        p = prob[self.at]
        if self.chosen:
            gain = p.T @ (self.n / (self.p @ self.share)) - self.n.sum()  # an upper bound of the gain, as the likelihood is concave
            gain[[k - first for k in self.chosen if first <= k < first + len(gain)]] = -np.inf
        else:
            gain = self.n @ np.log(p)
        k = int(gain.argmax())
        if self.best is None or gain[k] > self.best[0]:
            self.best = (gain[k], first + k, p[:, k])

    def take(self) -> bool:
        """Take in the language remembered, if it pays."""
        gain, k, p = self.best
        self.best = None
        if not self.chosen:
            self.chosen, self.p, self.share, self.likelihood = [k], p[:, None], np.ones(1), float(gain)
            return True
        if gain <= self.penalty:
            return False
        new, gained = proportions(np.c_[self.p, p], self.n, np.r_[self.share * 0.8, 0.2])
        if gained - self.likelihood <= self.penalty:
            return False
        self.chosen, self.p, self.share, self.likelihood = [*self.chosen, k], np.c_[self.p, p], new, gained
        return True


def infer(texts: list[np.ndarray], prob: np.ndarray | list[str]) -> list[dict[int, float]]:
    """For the trigram buckets of each text: language -> proportion of the selected set. The slices of the model pass by once a step."""
    states = [Text(g) for g in texts]
    todo = states
    while todo:
        for first, part in slices_of(prob):
            for t in todo:
                t.look(first, part)
        todo = [t for t in todo if t.take()]
    return [dict(zip(t.chosen, t.share.tolist(), strict=True)) for t in states]


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray | list[str]) -> DataFrame:
    """docs' columns with lang_pred, score and languages (a map of the selected set)."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("lang_pred", "string").add("score", "double").add("languages", "string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            known = [grams(t) if langs else np.empty(0, np.int64) for t in batch.column("text").to_pylist()]
            answers = iter(infer([g for g in known if len(g)], prob))
            found: list[dict[int, float]] = [next(answers) if len(g) else {} for g in known]
            best = [max(sorted(x), key=x.get) if x else -1 for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in rest),
                    pa.array([langs[k] if k >= 0 else UNDETERMINED for k in best], pa.string()),
                    pa.array([min(1.0, x[k]) if k >= 0 else 0.0 for x, k in zip(found, best, strict=True)], pa.float64()),
                    pa.array([",".join(f"{langs[k]}:{x[k]:.3f}" for k in sorted(x, key=x.get, reverse=True)) for x in found], pa.string()),
                ],
                schema.names,
            )

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def learned_from(docs: DataFrame) -> tuple[list[str], np.ndarray | list[str]]:
    """Learn from the documents that are not held out: crc32 of the id modulo 5 is not 0."""
    return learn(docs.filter(crc_mod("doc_id", 5) != 0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, prob = learned_from(docs)
    out = predict(docs.select("doc_id", "text"), langs, prob)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
