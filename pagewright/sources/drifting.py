"""Parquet files whose schemas drift: headers are read in parallel, folded through a promotion lattice, files cast to the union.

Headers (Parquet footers) are read by tasks, not by the driver; one row per distinct (file, column, type) comes back to be folded.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widening order of numbers; anything else that differs meets in text.
NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def promote(a: str, b: str) -> str:
    """The least type both are cast to without loss of meaning: numbers widen (decimals to hold the digits of both), dates become times,
    structs merge field by field, arrays and maps by their elements; anything else that differs meets in text."""
    return _wide(_parsed(a), _parsed(b)).simpleString()


@functools.lru_cache(maxsize=10_000)
def _parsed(kind: str) -> T.DataType:
    return T.NullType() if kind == "void" else T.DataType.fromDDL(kind)


def _wide(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b}
        own = [T.StructField(f.name, _wide(f.dataType, other.get(f.name, T.NullType()))) for f in a]
        return T.StructType([*own, *(T.StructField(f.name, f.dataType) for f in b if f.name not in a.fieldNames())])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wide(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, _wide(a.valueType, b.valueType))
    x, y = a.simpleString(), b.simpleString()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if x in NUMBERS and y in NUMBERS:
        high = NUMBERS[max(NUMBERS.index(x), NUMBERS.index(y))]
        return _parsed("double" if {x, y} & {"bigint", "int"} and high == "float" else high)
    if "date" in (x, y) and {x, y} & {"timestamp", "timestamp_ntz"}:
        return a if y == "date" else b
    return T.StringType()


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column of one type as a type above it in the lattice; structs are cast field by field."""
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have}
        made = F.struct(*[(as_type(c.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
        return F.when(c.isNotNull(), made)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) and isinstance(want, T.StringType):
        return F.to_json(c)
    return c.cast(want)


def open_schema(path: str) -> T.StructType:
    """The schema in a file's footer, read through the file system that its URI names (local paths, file:, hdfs:, s3: and s3a:, gs:)."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    uri = path.replace("s3a://", "s3://").replace("file:///", "/").replace("file:/", "/")
    where, inside = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    with where.open_input_file(inside) as f:
        return from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a folder in order of their names, listed by Spark's file system; no file is opened."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path")
    return [r.path for r in rows.orderBy("path").collect()]


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, path, place, column, type) of every column of every file, from its footer. Footers are read by tasks."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for n, path in zip(batch["file_no"], batch["path"], strict=True):
                out += [(n, path, i, f.name, f.dataType.simpleString()) for i, f in enumerate(open_schema(path))]
            yield pd.DataFrame(out, columns=["file_no", "path", "place", "column", "type"])

    files = spark.createDataFrame(list(enumerate(paths)), "file_no long, path string").repartition(max(1, min(len(paths), 1000)))
    return files.mapInPandas(read, "file_no long, path string, place int, column string, type string")


def union_schema(found: DataFrame) -> list[tuple[str, str]]:
    """Columns in order of first appearance with their promoted types. Only distinct (column, type) pairs reach the driver."""
    pairs = found.groupBy("column", "type").agg(F.min(F.struct("file_no", "place")).alias("first")).orderBy("first").collect()
    types: dict[str, list[str]] = {}
    for r in pairs:
        types.setdefault(r.column, []).append(r.type)
    return [(c, functools.reduce(promote, ts)) for c, ts in types.items()]


def differences(found: DataFrame) -> DataFrame:
    """(file_no, change, column, was, now): what each file's header changed against the file before it."""
    last = found.select((F.col("file_no") + 1).alias("file_no"), "column", F.col("type").alias("was"))
    there = found.select("file_no").distinct()
    both = found.select("file_no", "column", F.col("type").alias("now")).where("file_no > 0").join(last, ["file_no", "column"], "full").join(there, "file_no", "left_semi")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "retyped")
    return both.withColumn("change", change).where("change is not null").select("file_no", "change", "column", "was", "now")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one table of the union schema, with null for columns a file lacks.

    Files of one header are read together, so there are as many scans as there are different headers.
    """
    found = headers(spark, paths)
    schema = union_schema(found)
    kinds = found.groupBy("file_no", "path").agg(F.sort_array(F.collect_list(F.struct("place", "column", "type"))).alias("h")).groupBy("h").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    out = None
    for kind in kinds:
        own = {x.column: x.type for x in kind.h}
        df = spark.read.parquet(*kind.paths)
        df = df.select(*[(as_type(F.col(f"`{c}`"), _parsed(own[c]), _parsed(t)) if c in own else F.lit(None).cast(t)).alias(c) for c, t in schema])
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], T.StructType([]))
