"""Writers, and tables that a plan writes for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = (), files: int | None = None) -> None:
    """Write a table, in ``files`` files at most where given, laid out by ``partition_by``.

    Without ``files`` a partitioned table is dealt by its partition columns first, so that each folder gets few files.
    """
    if files is not None:
        df = df.coalesce(files)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report in one file: JSON lines, or CSV with header."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; without one, a temporary folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows is not worked out anew for each statistic."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/retail/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
