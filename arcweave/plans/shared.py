"""The work folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and everything runs in one process (tests) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="arcweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Rows of the largest table for each shuffle partition, and bytes of a file or of shuffled data that one task reads.
ROWS_A_PARTITION, TASK_BYTES = 250_000, 16 << 20


def fit_session(spark: SparkSession, rows: int) -> None:
    """Shuffles of this session, from now on, in partitions that follow the input: a task's hash tables and sorts are then of one size
    whatever the tables' size. Settings that give smaller tasks already stay."""
    conf = spark.conf
    if int(conf.get("spark.sql.shuffle.partitions")) < (n := -(-rows // ROWS_A_PARTITION)):
        conf.set("spark.sql.shuffle.partitions", n)
    # splits of files, and what adaptive execution merges partitions up to: compressed bytes, so that a task of the usual 64 MB or
    # 128 MB holds ten million arcs
    for name, most in (("spark.sql.files.maxPartitionBytes", TASK_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES // 4)):
        if in_bytes(spark, conf.get(name)) > most:
            conf.set(name, most)


def in_bytes(spark: SparkSession, size: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here and survives lost executors."""
    path = work_folder(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
