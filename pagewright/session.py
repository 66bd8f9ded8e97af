"""Session factory and the few settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every session should have; a cluster may set sizes of its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "pagewright", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g", **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; make one of our own only where none is set (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="pagewright-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)


def checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder in the one that spark.checkpoint.dir names."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in that folder; what is written there is removed when the application ends."""
    sc = spark.sparkContext
    folder = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/rows"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the checkpoint folder and read from there: cuts the lineage, survives lost executors
    and is smaller than a checkpoint of rows. The table is removed when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
