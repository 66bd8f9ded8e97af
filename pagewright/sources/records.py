"""Small sinks and the sources that read them again: exports, records one by one with bad ones apart, analyses saved beside their version.

A writing job of Spark puts its files aside and makes them visible when it commits, so a reader sees a whole export or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exported(rows: DataFrame, path: str, form: str) -> DataFrame:
    """Rows written to a folder that mustn't exist yet (`json`, or `text` for one column `value`), and read from there with their own schema."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").format(form).save(path)
    reader = rows.sparkSession.read
    return reader.text(path) if form == "text" else reader.schema(rows.schema).format(form).load(path)


def isolated(spark: SparkSession, path: str, schema: str, body: str) -> DataFrame:
    """Lines of JSON in `path` as rows of `schema` with `outcome`: `error` where the line, or the JSON object in its column `body`, doesn't
    decode; the other rows aren't touched by it."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    whole = F.col("_bad").isNull() & F.try_parse_json(body).isNotNull() & F.ltrim(body).startswith("{")
    return rows.withColumn("outcome", F.when(F.coalesce(whole, F.lit(False)), "row").otherwise("error")).drop("_bad")


def save_versioned(rows: DataFrame, path: str) -> None:
    """Saves (page_id, version, body) with the length of each body."""
    rows.withColumn("size", F.length("body")).write.mode("errorifexists").parquet(path)


def load_versioned(spark: SparkSession, path: str, now: DataFrame) -> DataFrame:
    """The saved rows whose version is the one in `now` (page_id, version) and whose body is as long as when it was saved. Null versions
    are never current."""
    saved = spark.read.parquet(path)
    return saved.where(F.length("body") == F.col("size")).join(now, ["page_id", "version"], "left_semi").select("page_id", "version", "body")


def contained(paths: DataFrame, column: str, root: str) -> DataFrame:
    """Rows with `inside`: whether a path, relative or absolute, stays in the folder `root` after its `.` and `..` are followed; an empty one
    doesn't, null stays null. Nothing is opened."""
    base, path = root.rstrip("/") + "/", F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    own = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    parts = F.filter(F.split(own, "/"), lambda x: (x != "") & (x != "."))
    step = lambda x: F.when(x == "..", -1).otherwise(1)
    low = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("low")), lambda a, x: F.struct((a["n"] + step(x)).alias("n"), F.least(a["low"], a["n"] + step(x)).alias("low")), lambda a: a["low"])
    inside = ~own.rlike("^([A-Za-z]:|/)") & (low >= 0) & (F.size(parts) > 0)
    return paths.withColumn("inside", F.when(F.col(column).isNotNull(), inside))
