"""Readers of the fixture tables.

Every table is one Parquet file or folder. Rows of `pages`, `page_attempts`, `source_files`, `books` and `settings` may
arrive twice, equal in everything but `ingested_at`; `once()` keeps one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identity of a row in the tables that may hold a row twice.
KEYS = {
    "pages": ["page_id"],
    "page_attempts": ["book_id", "page_number", "attempt"],
    "source_files": ["book_id", "id"],
    "books": ["id", "file_no"],
    "settings": ["install_id", "file_no"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row of each key, for narrow tables (aggregation with map-side combine)."""
    return df.dropDuplicates(list(keys))


def once_wide(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row of each key for rows that carry long texts.

    `dropDuplicates` would sort whole rows on both sides of the shuffle. Here rows are hashed to a partition by their key
    and each partition drops keys it has seen; its memory is the keys of one partition. Which of the rows stays is
    undefined, as they differ in nothing that is kept.
    """
    keys = list(keys)
    names = df.columns
    at = [names.index(k) for k in keys]

    def first_seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set = set()
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            keep = []
            for i, r in enumerate(rows):
                if r not in seen:
                    seen.add(r)
                    keep.append(i)
            yield batch if len(keep) == len(rows) else batch.take(pa.array(keep, pa.int64()))

    return df.repartition(*[F.col(f"`{k}`") for k in keys]).mapInArrow(first_seen, df.schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, spread over the cores before work that is heavy for each row. A scan with as many
    partitions as cores or more, as any large table has, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
