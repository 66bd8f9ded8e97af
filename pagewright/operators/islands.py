"""Ordered analytics: gaps and islands, interval unions, thresholds, running offsets, batches, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], at: str, gap: Column) -> DataFrame:
    """`island` (from 0): a new one starts where a value is more than `gap` after the one before it in its group."""
    w = Window.partitionBy(*by).orderBy(at)
    return (
        df.withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0))
        .withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_new")
    )


def covered(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of intervals per group, and their number. Intervals that are null or turned round count nothing."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(w)
    return (
        df.where(F.col(start) < F.col(end))
        .withColumn("_reach", reach)
        .withColumn("_own", F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start)))))
        .groupBy(*by)
        .agg(F.sum("_own").alias("covered"), F.count("*").alias("parts"))
    )


def otsu(hist: DataFrame, by: list[str], level: str, count: str) -> DataFrame:
    """Threshold of a histogram per group that maximises the variance between both sides; the lowest of equals. A group with one
    level has none."""
    w = Window.partitionBy(*by).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*by)
    c, m = F.col(count).cast("double"), F.col(level) * F.col(count).cast("double")
    sums = hist.select(*by, level, F.sum(c).over(w).alias("_n"), F.sum(m).over(w).alias("_s"), F.sum(c).over(full).alias("_all"), F.sum(m).over(full).alias("_total")).where("_n < _all")
    between = F.expr("_n * (_all - _n) * power(_s / _n - (_total - _s) / (_all - _n), 2)")
    return sums.groupBy(*by).agg(F.max_by(level, F.struct(F.round(between, 6), -F.col(level))).alias("threshold"))


def offsets(df: DataFrame, by: list[str], order: list[Column], size: str) -> DataFrame:
    """Running start and end (1-based, inclusive) of rows that take `size` places each; null sizes take none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.col(size), F.lit(0))
    return df.withColumn("ends", F.sum(n).over(w)).withColumn("starts", F.col("ends") - n + 1)


def protected(df: DataFrame, by: list[str], order: list[Column], need: str) -> DataFrame:
    """What earlier rows of the group need (`before`)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(need).over(w), F.lit(0)))


def batches(df: DataFrame, by: list[str], order: list[Column], alone: Column, size: int) -> DataFrame:
    """`batch` (from 1, in order): up to `size` neighbouring rows; a row that stands alone is a batch of its own."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(F.when(F.col("_alone") | F.coalesce(F.lag("_alone").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = df.withColumn("_alone", alone).withColumn("_run", run)
    inner = Window.partitionBy(*by, "_run").orderBy(*order)
    cut = cut.withColumn("_first", F.when((F.row_number().over(inner) - 1) % size == 0, 1).otherwise(0))
    return cut.withColumn("batch", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_alone", "_run", "_first")


def chunk_of(position: Column, total: Column, chunks: Column) -> Column:
    """Chunk (from 0) of a 0-based position where chunk i holds [i*n div k, (i+1)*n div k)."""
    return F.floor(((position + 1) * chunks - 1) / total).cast("bigint")


def capped(values: Column, limit: int) -> Column:
    """Positions of the values that are kept when each is taken if the sum stays within `limit`; values that don't fit are passed
    over and later ones may still fit. Null counts as 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))
    return F.aggregate(
        values,
        start,
        lambda s, v: F.when(
            s["used"] + F.coalesce(v, F.lit(0)) <= limit,
            F.struct((s["used"] + F.coalesce(v, F.lit(0))).cast("bigint").alias("used"), F.array_append(s["kept"], s["i"]).alias("kept"), (s["i"] + 1).alias("i")),
        ).otherwise(F.struct(s["used"].alias("used"), s["kept"].alias("kept"), (s["i"] + 1).alias("i"))),
        lambda s: s["kept"],
    )


def gutters(bins: DataFrame, by: str, at: str, mass: str, low: int, high: int, least: int, sides: int) -> DataFrame:
    """(by, gutter, width): the widest empty run of bins from `low` to `high` that is at least `least` wide and has more than `sides` mass on
    both sides; of equals the first. Every bin has a row."""
    w = Window.partitionBy(by).orderBy(at)
    m = bins.withColumn("_before", F.coalesce(F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum(mass).over(Window.partitionBy(by)))
    free = m.where((F.col(at) >= low) & (F.col(at) <= high) & (F.col(mass) == 0)).withColumn("_run", F.col(at) - F.row_number().over(w))
    runs = free.groupBy(by, "_run").agg(F.min(at).alias("_lo"), F.count("*").alias("width"), F.min("_before").alias("_left"), (F.max("_total") - F.min("_before")).alias("_right"))
    good = runs.where((F.col("width") >= least) & (F.col("_left") > sides) & (F.col("_right") > sides))
    return good.groupBy(by).agg(F.max_by("_lo", F.struct("width", -F.col("_lo"))).alias("gutter"), F.max("width").alias("width"))
