"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Bytes of a bucket, and the most buckets that Spark writes.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. A temporary folder serves where that is unset and Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="answerlens-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a written table in the shared folder: lineage is cut, and the files outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, total_bytes: float, **options: str) -> DataFrame:
    """As materialise, in buckets of key, so that a join on it moves the other side alone."""
    spark = df.sparkSession
    path = scratch(spark, name)
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / BUCKET_BYTES)))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.options(path=path, **options).bucketBy(buckets, key).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise() or bucketed() made; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
