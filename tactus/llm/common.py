"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; only a session that has none (local
    tests) gets a temporary folder, set once.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tactus-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, read back; in parts by a column, if one is given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing will read again."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Stored tables of one operator's run, deleted as soon as nothing will read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        out = written(df, name, by)
        self.paths.append(out.stored_at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.remove(t.stored_at)
            discard(self.spark, t.stored_at)
        release(self.spark)

    def drop_part(self, stored: DataFrame, by: str, value: int) -> None:
        """Deletes the rows of a table stored in parts that have the value; no later step may ask for them."""
        discard(self.spark, f"{stored.stored_at}/{by}={value}")
        release(self.spark)

    def close(self, *but: DataFrame) -> None:
        left = {t.stored_at for t in but}
        for path in self.paths:
            if path not in left:
                discard(self.spark, path)
        self.paths = [p for p in self.paths if p in left]
        release(self.spark)


def tasks(df: DataFrame) -> int:
    """Partitions for work that its bytes don't tell: as many as the session sets for shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
