"""Small text sources beside documents: measurement tables and compiler logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The format's first line and header.
MAGIC = "measurement-v2"
HEADER = ["token", "natural_width_bp", "height_bp", "depth_bp", "anchor_prefix_bp"]


def measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, problems) of measurement files: a magic line, an exact header, then unique tokens with finite values >= 0.

    Problems are (file, token, problem); a file without magic line or header has one problem and no rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    heads = lines.where("n < 2").groupBy("file").agg(F.max(F.when(F.col("n") == 0, F.col("line"))).alias("magic"), F.max(F.when(F.col("n") == 1, F.col("line"))).alias("header"))
    bad = heads.where((F.col("magic") != MAGIC) | F.col("header").isNull() | (F.col("header") != ",".join(HEADER))).select("file", F.lit("").alias("token"), F.lit("format").alias("problem"))
    parts = F.split("line", ",")
    rows = lines.where("n > 1 and line <> ''").join(bad.select("file"), "file", "left_anti")
    rows = rows.select("file", F.get(parts, F.lit(0)).alias("token"), *[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(HEADER[1:], 1)], (F.size(parts) == 5).alias("_width"))
    rows = rows.withColumn("_copies", F.count("*").over(Window.partitionBy("file", "token")))
    value = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    wrong = F.when(~F.col("_width"), "columns").when(F.col("_copies") > 1, "token").when(value(HEADER[1]) | value(HEADER[2]) | value(HEADER[3]) | value(HEADER[4]), "value")
    rows = rows.withColumn("problem", wrong)
    return rows.where("problem is null").select("file", *HEADER), bad.unionByName(rows.where("problem is not null").select("file", "token", "problem"))


def log_warnings(log: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page_id, line_no, kind, box, amount) of warnings in compiler logs, for widths (box h) and heights (box v). `log`: doc, line;
    `pages`: doc, page_id, start_line. A source line belongs to the page with the greatest start at or before it; a warning without a line,
    or before all pages, belongs to the page of its document if there is only one."""
    from pagewright.operators.relational import as_of

    over = r"^(Overfull|Underfull) \\([hv])box \((?:([0-9.]+)pt too (?:wide|high)|badness ([0-9]+))\)"
    part = lambda n: F.regexp_extract("line", over, n)
    found = log.where(F.col("line").rlike(over)).select(
        "doc", F.nullif(F.regexp_extract("line", "lines? ([0-9]+)", 1), F.lit("")).cast("int").alias("at"), F.lower(part(1)).alias("kind"), part(2).alias("box"), F.coalesce(part(3).try_cast("double"), part(4).try_cast("double")).alias("amount")
    )
    only = pages.groupBy("doc").agg(F.count("*").alias("_n"), F.min("page_id").alias("_only")).where("_n = 1").drop("_n")
    met = as_of(found, pages.select("doc", F.col("start_line").alias("at"), "page_id"), ["doc"], "at", ["page_id"]).join(only, "doc", "left")
    return met.select("doc", F.coalesce("last_page_id", "_only").alias("page_id"), F.col("at").alias("line_no"), "kind", "box", "amount")
