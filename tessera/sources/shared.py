"""Tables that cut lineage, kept in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs in this
    process (tests): executors elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _own_folder[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither recompute it nor
    lose it with an executor. The folder's owner clears it; a lazy result may still read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``cut``, in buckets of ``keys``, as many as a shuffle has partitions: joins on these keys don't move it again."""
    spark = df.sparkSession
    n, held = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(held)
    return spark.table(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
