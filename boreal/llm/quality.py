"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule's running time and the share it rejects are measured on a sample of documents; rules then run
in the order of rejections per second, and a document that one rule rejects meets no other. The order changes
the time only: a document is kept if and only if every rule keeps it. The base rules are cheap and reject most of what is rejected; the rules over longer windows cost several times as much, and run behind what the sample
says is worth more.

A null text counts as empty: it has no words, and the base rule of 50 words rejects it. Texts are read whole, whatever their length. Repeated
rows, and rows without an id, give results of their own and a table without rows gives none; other columns are kept, but for those named like a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import batches, table, words

SYMBOLS = "#*$%&|<>"
#: Rows measured to order the rules; the order, not the verdict, depends on them.
SAMPLE_ROWS = 400


class Measures:
    """The measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return words(self.text)

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "surrogatepass"))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\r\x0b\x0c")]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _grams(self) -> dict[int, np.ndarray]:
        return {}

    def gram_ids(self, n: int) -> np.ndarray:
        """A number for each n consecutive words, equal for equal ones; built on those of n - 1, each length once."""
        if n not in self.grams:
            if n == 1:
                code: dict[bytes, int] = {}
                self.grams[1] = np.fromiter((code.setdefault(w, len(code)) for w in self.words), np.int64, self.n_words)
            else:
                ids, g = self.gram_ids(1), self.gram_ids(n - 1)
                pairs = g[:-1] * (self.n_words + 1) + ids[n - 1 :] if len(g) > 1 else np.empty(0, np.int64)
                self.grams[n] = np.unique(pairs, return_inverse=True)[1]
        return self.grams[n]

    def repeated(self, n: int) -> int:
        """Words in n-word windows that the text has twice or more."""
        g = self.gram_ids(n)
        if len(g) < 2:
            return 0
        twice, covered = np.bincount(g)[g] > 1, np.zeros(self.n_words, bool)
        for k in range(n):
            covered[k : len(g) + k] |= twice
        return int(covered.sum())

    def top(self, n: int) -> int:
        """How often the text has its most frequent n-gram."""
        g = self.gram_ids(n)
        return int(np.bincount(g).max()) if len(g) else 0

    def _n_repeat_words(self) -> int:
        return self.repeated(3)


#: Name and what rejects a text. base_* are those that a caller may ask for alone.
RULES: dict[str, Callable[[Measures], bool]] = {
    "base_few_words": lambda m: m.n_words < 50,
    "base_repeats": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "duplicate_lines": lambda m: 10 * m.n_dup_lines > 3 * max(1, len(m.lines)),
    "short_or_long_words": lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words,
    # dearer than the base measures: they look at longer windows, each built on the one before
    **{f"top_{n}_words": (lambda m, n=n, share=share: 100 * n * m.top(n) > share * m.n_words) for n, share in ((2, 20), (4, 16))},
    **{f"repeats_{n}_words": (lambda m, n=n, share=share: 100 * m.repeated(n) > share * m.n_words) for n, share in ((6, 40), (10, 30))},
}


def order_rules(sample: list[str | None], rules: dict[str, Callable] = RULES) -> list[str]:
    """Rule names by rejections per second on the sample, most first; those that reject nothing by cost, cheapest first. A rule's time holds what it derives from a text on its own."""
    rate = {}
    for name, rejects in rules.items():
        began = time.perf_counter()
        rejected = sum(rejects(Measures(t)) for t in sample)
        rate[name] = (rejected / (cost := max(time.perf_counter() - began, 1e-9)), -cost)
    return sorted(rules, key=lambda x: rate[x], reverse=True)


def first_rejection(m: Measures, order: list[str], rules: dict[str, Callable] = RULES) -> str | None:
    return next((name for name in order if rules[name](m)), None)


def cascade(docs: DataFrame, order: list[str], text: str = "text", measure_all: bool = False) -> DataFrame:
    """docs' columns but text, with kept and rejected_by (the first rule of the order that rejects, else null); with measure_all also every measure."""
    kinds = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean"} if measure_all else {}
    rest = [c for c in docs.columns if c not in (text, "kept", "rejected_by", *kinds)]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name, kind in (kinds | {"kept": "boolean", "rejected_by": "string"}).items():
        schema = schema.add(name, kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found: dict[str, list] = {c: [] for c in [*kinds, "kept", "rejected_by"]}
            for t in batch.column(text).to_pylist():
                m = Measures(t)
                by = first_rejection(m, order)
                found["kept"].append(by is None)
                found["rejected_by"].append(by)
                for c in kinds:
                    found[c].append(any(RULES[x](m) for x in RULES if x.startswith("base_")) if c == "base_failed" else getattr(m, c))
            types = {"long": pa.int64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(v, types.get(kinds.get(c, "boolean" if c == "kept" else ""), pa.string())) for c, v in found.items()], rest + list(found))

    return docs.select(*[F.col(f"`{c}`") for c in (*rest, text)]).mapInArrow(run, schema)


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """Texts to order the rules by: about `rows` rows, by a hash of their texts, spread over the whole table docs (doc_id, text); of a text its first 20,000 characters, which bounds what reaches the driver."""
    n = docs.count()
    share = max(1, n // rows)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200)), F.lit(share)) == 0).select(F.substring("text", 1, 20_000))
    return [r[0] for r in picked.limit(2 * rows).collect()]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = order_rules(sample_texts(docs))
    out = cascade(docs, order, measure_all=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), t AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1
), r AS (
  SELECT k, count(DISTINCT i + o) AS n FROM t CROSS JOIN (VALUES (0), (1), (2)) AS x(o) GROUP BY k
), x AS (
  SELECT k, o.n, i, array_to_string(ws[i:i + o.n - 1], ' ') AS gram FROM (SELECT k, n, ws, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM w CROSS JOIN (VALUES (2), (4), (6), (10)) AS v(n)) AS o
), y AS (
  SELECT k, n, i, count(*) OVER (PARTITION BY k, n, gram) AS c FROM x
), z AS (
  SELECT k, n, max(c) AS top FROM y WHERE n < 5 GROUP BY k, n
), u AS (
  SELECT k, n, count(DISTINCT q) AS repeated FROM (SELECT k, n, unnest(range(i, i + n)) AS q FROM y WHERE n > 5 AND c > 1) GROUP BY k, n
), dear AS (
  SELECT k FROM w JOIN z USING (k) WHERE 100 * n * top > CASE n WHEN 2 THEN 20 ELSE 16 END * len(ws)
  UNION
  SELECT k FROM w JOIN u USING (k) WHERE 100 * repeated > CASE n WHEN 6 THEN 40 ELSE 30 END * len(ws)
), m AS (
  SELECT w.k, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (k)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * greatest(1, n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR k IN (SELECT k FROM dear)) AS kept FROM b
"""
