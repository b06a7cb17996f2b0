"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a session in one local process gets a temporary folder; on a cluster an error says what to set, as a
    folder of one machine would lose what executors write.
    """
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set(SETTING, base)
    context.setCheckpointDir(base)
    return base


def settled(df):
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tabled(df):
    """df with its lineage cut by a table in the shared folder.

    A checkpoint computes df twice, and keeps the constraints of the plan before it, on which unions in later plans can fail
    ("key not found").
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled_to(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MOST_KEYS = 2_000_000  # broadcast as 64-bit numbers, some 100 MB in memory


def among(rows, key: str, keys):
    """rows whose key may be one of keys (one column, read twice): rows that can't match are left out before they are shuffled.

    By a broadcast of 64-bit hashes, so a join on the keys themselves has to follow; of more than MOST_KEYS keys all rows.
    """
    if keys.count() > MOST_KEYS:
        return rows
    hashes = keys.select(F.xxhash64(keys.columns[0]).alias("_h")).distinct()
    return rows.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
