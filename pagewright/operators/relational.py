"""Joins, closures, set operations and sequence operators on plain tables. All are DataFrame compositions, left to Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut


def newest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in `order` (which must be total): a correlated top-1 as a window with a group limit."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; both have the same columns. Keys are unique within each side."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` are added where their key isn't in `old` yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each row of `left` with the columns `take` of the last row of `right` of its group at or before it (NULL if there is none).

    Both sides are put in one order and the last value carried along: one shuffle, no range join. Of right rows at the same
    place, the greatest by `take` counts. Rows with a null place meet nothing.
    """
    packed = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*take)).alias("_r"))
    both = left.withColumn("_r", F.lit(None).cast(packed.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(packed.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(*left.columns, *[F.col(f"_last.{c}").alias(f"last_{c}") for c in take])


def _climbed(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Pointer doubling to a fixed point. `nodes`: scope, node, at (a node above), depth, path (from below `at` to the node), done (whether
    `at` is where the node's climb ends). Each round joins what isn't done and doubles its step; it is cut from its lineage, so plans
    don't grow. A climb longer than there are nodes runs in a cycle: its `at`, depth and path become null."""
    now, step = cut(nodes), 1
    limit = now.count()
    while step <= limit and not now.where("not done").isEmpty():
        jump = now.select(*scope, F.col("node").alias("at"), F.col("at").alias("_to"), F.col("depth").alias("_d"), F.col("path").alias("_p"), F.col("done").alias("_e"))
        moved = now.where("not done").join(jump, [*scope, "at"]).select(*scope, "node", F.col("_to").alias("at"), (F.col("depth") + F.col("_d")).alias("depth"), F.concat_ws("/", "_p", "path").alias("path"), F.col("_e").alias("done"))
        now, step = cut(now.where("done").unionByName(moved)), 2 * step
    return now.select(*scope, "node", *[F.when(F.col("done"), F.col(c)).alias(c) for c in ("at", "depth", "path")])


def paths(files: DataFrame, ident: str, parent: str, scope: list[str], step: str) -> DataFrame:
    """Every node with the root of its tree, its depth, and its path: the values of `step` from the root down to it. A node whose parent
    isn't there is a root; nodes of a cycle have a null root, depth and path. Trees may be of any depth."""
    nodes = files.select(*scope, F.col(ident).alias("node"), F.col(parent).alias("up"), F.col(step).cast("string").alias("path"))
    known = nodes.select(*scope, F.col("node").alias("up"), F.lit(True).alias("_there"), F.col("path").alias("_above"))
    met = nodes.join(known, [*scope, "up"], "left").withColumn("top", F.col("_there").isNull())
    top = met.where("top").select(*scope, F.col("node").alias("up"), F.lit(True).alias("_top"))
    met = met.join(top, [*scope, "up"], "left")
    # a climb ends at a root; its path then lacks the root's own step, which is put before it
    start = met.select(
        *scope, "node", F.when(F.col("top"), F.col("node")).otherwise(F.col("up")).alias("at"), F.when(F.col("top"), 0).otherwise(1).alias("depth"),
        F.when(F.col("_top"), F.concat_ws("/", "_above", "path")).otherwise(F.col("path")).alias("path"), (F.col("top") | F.coalesce("_top", F.lit(False))).alias("done"),
    )
    return _climbed(start, scope).select(*scope, "node", F.col("at").alias("root"), F.col("depth").cast("bigint").alias("depth"), "path")


def roots(files: DataFrame, ident: str, parent: str, scope: list[str]) -> DataFrame:
    """Every node with the root of its tree and its depth, as `paths`."""
    return paths(files, ident, parent, scope, ident).drop("path").withColumn("depth", F.col("depth").cast("int"))


def nearest_above(nodes: DataFrame, ident: str, parent: str, scope: list[str], good: Column) -> DataFrame:
    """(scope, node, found, depth): the nearest node at or above each node that is `good`; nodes without one, and nodes whose climb runs
    in a cycle of others, are left out. Trees may be of any depth."""
    n = nodes.select(*scope, F.col(ident).alias("node"), F.col(parent).alias("up"), F.coalesce(good, F.lit(False)).alias("good"))
    known = n.select(*scope, F.col("node").alias("up"), F.lit(True).alias("_there"))
    met = n.join(known, [*scope, "up"], "left")
    ends = F.col("good") | F.col("_there").isNull()
    start = met.select(*scope, "node", F.when(ends, F.col("node")).otherwise(F.col("up")).alias("at"), F.when(ends, 0).otherwise(1).alias("depth"), F.lit("").alias("path"), ends.alias("done"))
    return _climbed(start, scope).join(n.where("good").select(*scope, F.col("node").alias("at")), [*scope, "at"]).select(*scope, "node", F.col("at").alias("found"), "depth")


def page_of(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Offset pagination of every group at once: `page_no` and `row_no` (from 0) in a total order; no group is one task's."""
    n = prefix_sums(df, by, order, F.lit(1))
    return n.select(*[n[c] for c in df.columns], F.expr(f"before div {size}").alias("page_no"), F.col("before").alias("row_no"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on one side only, with the side: empty if both have the same set of keys."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def prefix_sums(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """`df` with `before`, the sum of whole numbers `value` (null counts as 0) over the rows of its group that come before it in `order`
    (ascending, nulls first, total), and `whole`, the group's sum. With a value of 1 these are the row's place and the group's size.

    A window over a group would put the whole group into one task. Here rows are sorted by ranges, so a large group is many partitions;
    each adds up its own rows, and only one row per group and partition is put in order."""
    names = df.columns
    kept = df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", _in bigint, _part int"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, used = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(names.index(b)).to_pylist() for b in by), strict=True))
            new = np.array([keys[i] != (keys[i - 1] if i else last) for i in range(n)])
            v = batch.column(len(names)).to_numpy(zero_copy_only=False)
            sums = np.cumsum(v) - v
            start = np.flatnonzero(new)
            base = np.zeros(n, np.int64)
            base[start] = sums[start]
            base = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            own = np.where(base >= 0, sums - sums[np.maximum(base, 0)], sums + used)
            used, last = int(own[-1] + v[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, "_in", "_part"])

    # cut, because ranges are sampled anew when a plan is run again
    laid = cut(kept.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(run, schema))
    w = Window.partitionBy(*by)
    parts = laid.groupBy(*by, "_part").agg(F.sum("_v").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("whole", F.sum("_s").over(w))
    parts = parts.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_b", "whole")
    same = laid["_part"] == parts["_p"]
    for i, b in enumerate(by):
        same = same & laid[b].eqNullSafe(parts[f"_k{i}"])
    return laid.join(parts, same).select(*[laid[c] for c in names], (F.col("_in") + F.col("_b")).alias("before"), "whole")
