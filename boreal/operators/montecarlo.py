"""Storm Monte-Carlo with keyed uniforms: a draw depends on (tree, run, stream) alone, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 2**31 - 1


def uniform(t: Column, r: Column, c: Column) -> Column:
    """Uniform in [0, 1) from three integers, in 64-bit arithmetic alone. The squarings break the lattice that an affine form has."""
    t, r, c = (x.cast("long") for x in (t, r, c))
    s0 = (F.lit(1103515245) * t + 12345 * r + c) % M
    s1 = (s0 * s0 + 48271 * t + r) % M
    s2 = (s1 * s1 + 69621 * r + c) % M
    return ((s2 * s2 + t) % M) / F.lit(2147483648.0)


def runs(trees: DataFrame, n: int) -> DataFrame:
    """A row per tree and run (0 ..< n) with two uniforms."""
    rows = trees.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumns({"u_fall": uniform(F.col("tree_id"), F.col("run"), F.lit(1)), "u_hit": uniform(F.col("tree_id"), F.col("run"), F.lit(2))})


def storm(trees: DataFrame, n: int) -> DataFrame:
    """Per run: trees fallen, volume, and what they hit; trees: tree_id, p_fail, volume, w_power, w_bld, w_road. A fallen tree's one further draw hits the line, a building or a road, in that order of cumulative weights."""
    fell = runs(trees, n).filter(F.col("u_fall") < F.col("p_fail"))
    power, bld = F.col("w_power"), F.col("w_power") + F.col("w_bld")
    u = F.col("u_hit")
    hit = F.when(u < power, "power").when(u < bld, "bld").when(u < bld + F.col("w_road"), "road")
    counts = fell.withColumn("hit", hit).groupBy("run").agg(
        F.count(F.lit(1)).alias("fallen"), F.sum("volume").alias("volume"), F.count_if(F.col("hit") == "power").alias("n_line"), F.count_if(F.col("hit") == "bld").alias("n_bld"), F.count_if(F.col("hit") == "road").alias("n_road")
    )
    every = trees.sparkSession.range(n).select(F.col("id").cast("int").alias("run"))
    filled = every.join(counts, "run", "left").na.fill(0)
    return filled.withColumns({"line_hit": F.col("n_line") > 0, "bld_hit": F.col("n_bld") > 0, "road_hit": F.col("n_road") > 0})


def spread(per_run: DataFrame, columns: list[str]) -> DataFrame:
    """mean, p5, p50 and p95 of each column over the runs."""
    return per_run.agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), *[F.percentile(c, p / 100).alias(f"{c}_p{p}") for p in (5, 50, 95)])])


def representative_run(per_run: DataFrame, column: str = "fallen") -> DataFrame:
    """The run whose count is nearest the median; of equals the first."""
    return per_run.crossJoin(F.broadcast(per_run.agg(F.percentile(column, 0.5).alias("median")))).orderBy(F.abs(F.col(column) - F.col("median")), "run").limit(1).select("run", column)  # one row: the median


def gust_curve(trees: DataFrame, probability, gusts: range = range(10, 41, 2)) -> DataFrame:
    """Expected trees fallen at each gust; probability: gust column -> column."""
    rows = trees.withColumn("gust", F.explode(F.array(*[F.lit(float(g)) for g in gusts])))
    return rows.groupBy("gust").agg(F.sum(probability(F.col("gust"))).alias("expected"))


def noisy_or(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """1 - prod(1 - p) of each group, as a sum of logarithms; p is cut at 0.999999."""
    return df.groupBy(*keys).agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(0.999999)))))).alias("p"))


def pareto(df: DataFrame, value: str, tie: str, shares=(0.5, 0.8), bins: int = 4096) -> DataFrame:
    """How many rows, greatest first, make up each share of the whole. Sums per bin of values find the bin in which a share is reached; only that bin's rows are ranked."""
    from pyspark.sql import Window

    rows = df.filter(F.col(value) > 0).select(F.col(value).alias("v"), F.col(tie).alias("t"))
    top = rows.agg(F.max("v").alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).select("v", "t", F.floor((1 - F.col("v") / F.col("top")) * bins).alias("bin"))  # one row
    per = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))  # at most bins + 1 rows
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("bin", "n", "s", F.sum("n").over(w).alias("rank"), F.sum("s").over(w).alias("upto"), F.sum("s").over(Window.partitionBy()).alias("whole"), F.sum("n").over(Window.partitionBy()).alias("all"))
    named = F.explode(F.array(*[F.struct(F.lit(f"n_{round(100 * s)}").alias("name"), F.lit(float(s)).alias("share")) for s in shares])).alias("q")
    cut = per.select("*", named).filter((F.col("upto") >= F.col("q.share") * F.col("whole")) & (F.col("upto") - F.col("s") < F.col("q.share") * F.col("whole")))
    cut = cut.groupBy("q.name").agg(F.min_by(F.struct("bin", (F.col("rank") - F.col("n")).alias("before"), (F.col("upto") - F.col("s")).alias("sum"), (F.col("q.share") * F.col("whole")).alias("goal"), "all"), "bin").alias("c")).select("name", "c.*")
    near = rows.join(F.broadcast(cut), "bin")  # a row per share
    o = Window.partitionBy("name").orderBy(F.desc("v"), "t")
    near = near.withColumns({"k": F.row_number().over(o) + F.col("before"), "reached": F.sum("v").over(o.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sum")}).filter(F.col("reached") >= F.col("goal"))
    return near.agg(*[F.min(F.when(F.col("name") == f"n_{round(100 * s)}", F.col("k"))).alias(f"n_{round(100 * s)}") for s in shares], F.max("all").alias("n"))
