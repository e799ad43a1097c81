"""What the operators share: cut lineage, and joins with tables whose size is checked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: What may be broadcast: rows, and bytes of the written files or of the strings.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20
#: Bytes of one column that a Python worker turns into objects at once.
SLICE = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see; without one, a temporary folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Null-safe equi-join with a table that is usually small.

    ``right`` must be written already, so counting it is cheap. Up to BROADCAST_ROWS rows and BROADCAST_BYTES it is
    broadcast; beyond, its rows are repeated once for each salt and hot keys of ``left`` are dealt over the salts.
    """
    names = {k: f"_right_{k}" for k in keys}
    other = right.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    if right.count() <= BROADCAST_ROWS and int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
        return left.join(F.broadcast(other), same, how).drop(*names.values())
    salted = left.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    other = other.withColumn("_salts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(other, [F.col("_salt") == F.col("_salts"), *same], how).drop("_salt", "_salts", *names.values())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of ``column``: Arrow counts rows, not bytes."""
    for batch in batches:
        values, rows = batch.column(batch.schema.get_field_index(column)), batch.num_rows
        if values.nbytes <= most or rows < 2:
            yield batch
            continue
        is_list = pa.types.is_list(values.type)
        sizes = pc.fill_null(pc.list_value_length(values) if is_list else pc.binary_length(values), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) * (values.type.value_type.bit_width // 8 if is_list else 1))
        at = 0
        while at < rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
