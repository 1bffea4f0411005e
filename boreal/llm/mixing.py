"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slots t = 0, 1, ... of `block` words each are given to sources by mapping the golden-ratio points
frac(t * 0.618...) through the cumulative targets. Slots are ranked within their source; documents lie shuffled
(by MD5 of seed and id) end to end in their source's stream, repeated up to `max_passes` times and cut into
blocks of `block` words; the slot of rank r takes block r.

A third of all rows may share one source, so no window spans a source: slots are ranked within chunks of
consecutive slots and documents summed within (source, hash bucket) cells of bounded size, and only the cells'
totals are summed across.

Blocks grow with the corpus. Sources whose target is under `FEW` blocks have a schedule among themselves with a finer block, down to
one word, so that how near a source comes to its target does not depend on the size of the corpus. Each level holds the largest source left and all of over half its size, so that there are
few levels, and some two hundred slots a source at most beyond the first four million.

A null text has size 0 and takes nothing; a null source is a source, last in the order. Repeated rows
and repeated or null ids are laid out one after the other (equal rows are interchangeable). A very long text lies in many blocks and may be taken in part. A table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreal.llm.common import stage, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = "mix-1"
#: floor(2**32 / golden ratio), the step of the additive recurrence in 32-bit fixed point.
GOLDEN = 2654435769
CHUNK = 65_536
#: Documents in one cell of the layout, about.
CELL_ROWS = 1_000
#: Cells that the line of cumulative targets is cut into, a source at least, to find a slot's source by an equi-join.
LINE_CELLS = 4096
MAX_BROADCAST_SOURCES = 100_000
#: Blocks that a source has at least in its schedule, unless a block is a word.
FEW = 100
WORD_SPLIT = r"[^\x20\x09-\x0D]+"


def block_words(total: int) -> int:
    """Words a block: about four million slots for any corpus, of at least 64 and at most 65,536 words each."""
    return max(64, min(65_536, total >> 22))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SPLIT)), F.lit(0)).cast("long")


def sized(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and the shuffle key of each document, and the columns in extra."""
    return docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"), *extra
    )


def targets(sizes: DataFrame) -> DataFrame:
    """A row per source: ordinal, source, source_size, docs, target. Weighted shares of all sizes, none above max_passes times its source's size, found in one pass over the sources in order of size by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", "docs", F.row_number().over(order).alias("ordinal"), w.alias("w"), (F.col("source_size") * MAX_PASSES).alias("cap"))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "ordinal")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), "ordinal", "level"))
    return per.withColumn("fill", F.min(fits).over(Window.partitionBy()).getField("level")).select("ordinal", "source", "source_size", "docs", F.when(F.col("fill") * F.col("w") < F.col("cap"), F.col("fill") * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def slots(spark: SparkSession, shares: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """(ordinal, block): the blocks that the schedule takes of each source, numbered from 0 in the order of its slots. shares: ordinal, target."""
    bounds = shares.select("ordinal", F.round("target").cast("long").alias("part"))
    upto = F.sum("part").over(Window.orderBy("ordinal"))
    bounds = bounds.select("ordinal", (upto - F.col("part")).alias("lo"), upto.alias("hi"), F.sum("part").over(Window.partitionBy()).alias("line")).filter("hi > lo")
    cells = max(LINE_CELLS, n_sources)
    cell = lambda c: F.floor(c * F.lit(float(cells)) / F.col("line"))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi") - 1), F.lit(cells - 1)))))
    phase = (F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN % F.lit(1 << 32)) / F.lit(4294967296.0)
    n = -(-total // block)
    line = bounds.select(F.max("line").alias("all"))
    points = spark.range(0, n, 1, max(1, min(2000, n // 200_000))).crossJoin(F.broadcast(line))  # one row: the length of the line
    points = points.select("id", F.floor(phase * F.col("all")).alias("at"), F.col("all")).select("id", "at", F.floor(F.col("at") * F.lit(float(cells)) / F.col("all")).alias("cell"))
    bounds = F.broadcast(bounds) if n_sources <= MAX_BROADCAST_SOURCES else bounds
    given = points.join(bounds, "cell").filter("at >= lo AND at < hi").select("id", "ordinal", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = given.groupBy("ordinal", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("ordinal").alias("o"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("ordinal").orderBy("chunk")) - F.col("n")).alias("before"))
    local = given.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "ordinal").orderBy("id")) - 1)
    return local.join(before, (F.col("ordinal") == F.col("o")) & (F.col("chunk") == F.col("c"))).select("ordinal", (F.col("before") + F.col("r")).alias("block"))


def layout(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """sizes with ordinal, source_size, target and start, the document's place in its source's stream."""
    docs = sizes.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.ceil(F.col("docs") / CELL_ROWS)))
    docs = docs.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * cells / F.lit(4294967296.0)))
    sums = docs.groupBy("ordinal", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("ordinal").alias("o"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("ordinal").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.sum("size").over(Window.partitionBy("ordinal", "bucket").orderBy("key", "doc_id", "size", *(["digest"] if "digest" in docs.columns else [])).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    docs = docs.withColumn("local", local)
    return docs.join(sums, (F.col("ordinal") == F.col("o")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("before") + F.col("local")).drop("o", "b", "before", "local", "bucket", "docs")


def pieces(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row per document, pass and block that it lies in and the schedule takes, with the piece's first and end word in the document. docs: laid out, with step (words a block) and n_slots (blocks that the source's slots take)."""
    d = docs.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    d = d.withColumn("from", F.col("pass") * F.col("source_size") + F.col("start"))
    d = d.filter(F.col("from") < F.col("n_slots") * F.col("step"))
    last = F.least(F.floor((F.col("from") + F.col("size") - 1) / F.col("step")), F.col("n_slots") - 1)
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / F.col("step")), last)))
    first = F.greatest(F.lit(0), F.col("block") * F.col("step") - F.col("from"))
    end = F.least(F.col("size"), (F.col("block") + 1) * F.col("step") - F.col("from"))
    return d.select(*keep, "block", "pass", first.alias("first"), end.alias("end"))


def levels(shares: DataFrame) -> list[tuple[float, float, int, int]]:
    """The schedules: least target, target that is too large for it, words in all, words a block. Sources of under FEW blocks go on to the next one, whose block is so fine that it holds the largest of them, down to one word."""
    out, upto = [], float("inf")
    while True:
        total, top = shares.filter(F.col("target") < upto).agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.max("target"), F.lit(0.0))).first()
        if round(total) == 0:
            return out
        block = block_words(round(total))
        if top < FEW * block:  # no source is that large: the power of two that FEW of make up the largest
            block = 1 << (max(1, int(top // FEW)).bit_length() - 1)
        least = 0.0 if block == 1 else float(FEW * block)
        held = round(shares.filter((F.col("target") >= least) & (F.col("target") < upto)).agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
        if held:
            out.append((least, upto, held, block))
        if not least:
            return out
        upto = least


def mix(docs: DataFrame, block: int | None = None, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The laid-out documents (a row each, with the columns in extra) and the pieces that the schedule takes, joined to them by (ordinal, start)."""
    spark = docs.sparkSession
    sizes = stage(sized(docs, extra), "mix-sizes")
    shares = stage(targets(sizes).coalesce(1), "mix-shares")
    total, n = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    placed = stage(layout(sizes, shares), "mix-placed")
    small = F.broadcast if n <= MAX_BROADCAST_SOURCES else lambda df: df
    parts = []
    for least, upto, words, step in [(0.0, float("inf"), total, block)] if block else levels(shares):
        held = shares.filter((F.col("target") >= least) & (F.col("target") < upto)).select("ordinal", "target")
        taken = stage(slots(spark, held, n, words, step), "mix-slots")  # some four million rows at most
        counts = taken.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_slots")).withColumn("step", F.lit(step).cast("long"))
        parts.append(pieces(placed.join(small(counts), "ordinal"), ["ordinal", "start"]).join(taken, ["ordinal", "block"]))
    empty = pieces(placed.limit(0).withColumns({"n_slots": F.lit(0).cast("long"), "step": F.lit(64).cast("long")}), ["ordinal", "start"])
    return placed, reduce(DataFrame.union, [p.select(*empty.columns) for p in parts] or [empty])


def mixed(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that the mix consists of: a row for each pass that takes words of a document, with the whole text or, where the schedule ends within it, the words taken."""
    digest = F.md5(F.to_json(F.struct("text", "lang")).cast("binary"))  # rows of one id and size keep one order
    placed, parts = mix(docs.withColumn("digest", digest), extra=("text", "lang", "digest"))
    taken = parts.groupBy(F.col("ordinal").alias("o"), F.col("start").alias("p"), "pass").agg(F.min("first").alias("a"), F.max("end").alias("b"))  # a pass takes blocks that follow each other
    rows = placed.filter("size > 0").join(taken, (F.col("ordinal") == F.col("o")) & (F.col("start") == F.col("p")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_SPLIT), F.lit(0)), F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")), " ")
    text = F.when((F.col("a") == 0) & (F.col("b") == F.col("size")), F.col("text")).otherwise(part)
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, parts = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = parts.groupBy(F.col("ordinal").alias("o"), F.col("start").alias("p")).agg(F.sum(F.col("end") - F.col("first")).alias("n"))
    out = placed.join(taken, (F.col("ordinal") == F.col("o")) & (F.col("start") == F.col("p")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal FROM s0
), s2 AS (
  SELECT *, CAST([5, 2, 1][(ordinal - 1) % 3 + 1] AS BIGINT) AS w, 3 * source_size AS cap FROM s1
), s3 AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
           / CAST(sum(w) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2
), s4 AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level <= cap / w THEN 0 ELSE 1 END, cap / w, ordinal) AS fill FROM s3
), s AS (
  SELECT *, CASE WHEN fill * w < cap THEN fill * w ELSE CAST(cap AS DOUBLE) END AS target FROM s4
), lv(upto, least, block, step) AS (
  SELECT CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), 0
  UNION ALL
  SELECT upto, CASE WHEN block = 1 THEN 0.0 ELSE 100.0 * block END, block, step + 1 FROM (
    SELECT upto, step, CASE WHEN top >= 100 * b0 THEN b0 WHEN top < 200 THEN 1 ELSE CAST(pow(2, floor(log2(floor(top / 100)))) AS BIGINT) END AS block FROM (
      SELECT lv.least AS upto, step, max(target) AS top, greatest(64, least(65536, CAST(round(sum(target)) AS BIGINT) >> 22)) AS b0
      FROM lv JOIN s ON s.target < lv.least GROUP BY lv.least, step HAVING round(sum(target)) > 0))
), b0 AS (
  SELECT s.*, CAST(round(target) AS BIGINT) AS part, lv.step, lv.block FROM s JOIN lv ON lv.step > 0 AND target >= lv.least AND target < lv.upto
), b AS (
  SELECT *, CAST(sum(part) OVER (PARTITION BY step ORDER BY ordinal) AS BIGINT) AS hi, CAST(sum(part) OVER (PARTITION BY step) AS BIGINT) AS line,
         CAST(round(sum(target) OVER (PARTITION BY step)) AS BIGINT) AS words FROM b0
), n AS (
  SELECT ordinal, count(*) AS slots FROM (
    SELECT step, CAST(floor((((t % 2147483648) * 2654435769 % 4294967296) / 4294967296e0) * line) AS BIGINT) AS pos
    FROM (SELECT step, line, unnest(range(CAST(ceil(words / block) AS BIGINT))) AS t FROM (SELECT DISTINCT step, words, block, line FROM b))) AS p
  JOIN b ON p.step = b.step AND pos >= hi - part AND pos < hi GROUP BY ordinal
), p AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(n.slots, 0) * coalesce(b.block, 0) AS take,
         CAST(sum(d.size) OVER (PARTITION BY s.ordinal ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN b ON b.ordinal = s.ordinal LEFT JOIN n ON n.ordinal = b.ordinal
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, take - start)) + greatest(0, least(size, take - start - source_size))
            + greatest(0, least(size, take - start - 2 * source_size)) AS BIGINT) AS taken FROM p
"""
