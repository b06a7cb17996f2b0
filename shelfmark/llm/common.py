"""Tables, shared scratch space and bounded memory that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.shared import shared_dir

ARROW_ROWS = 1_000  # rows of a batch that goes to Python, at most
SLICE_BYTES = 4 << 20  # of texts that are taken from a batch at once
MASK_BITS = (1 << 16, 1 << 28)  # least and most bits of a mask
BITS_PER_KEY = 16
HEAVY_KEYS = 1_000  # keys of which the rows are many enough to be dealt by themselves, at most
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. From here on batches to Python have at most ARROW_ROWS rows, as rows may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new place in the folder all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends: what it wrote is read from the shared folder from then on."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> tuple[DataFrame, str]:
    """df written to the shared folder as a table in n buckets of a key, and the table's name: grouping it by the key or joining
    it by it moves no row of it. The caller drops the table, and with it the files (`unbucketed`)."""
    spark, name = df.sparkSession, f"shelfmark_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def unbucketed(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dropped(spark, f"{shared_dir(spark)}/{name}")


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column of df (by Spark, in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle gets; it is set in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, null as empty: 128 bits tell texts apart at any number of rows."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("_h1"), F.xxhash64(body, F.lit(1)).alias("_h2")]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts of one column, null as empty, of about `most` bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right"))
        last = max(last, first + 1)
        part = batch.slice(first, last - first)
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
        first = last


def release_worker_memory(keep_tokens: bool = False) -> None:
    """Give back what earlier tasks of this reused Python worker left: freed memory, and token maps unless they are kept."""
    tokens = sys.modules.get("shelfmark.llm.tokens")
    if tokens is not None and not keep_tokens:
        tokens._ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(work: Callable, keep_tokens: bool = False) -> Callable:
    """An Arrow function that gives memory back before and after its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_memory(keep_tokens)
        try:
            yield from work(batches)
        finally:
            release_worker_memory(keep_tokens)

    return run


def mask_of(keys: DataFrame) -> np.ndarray:
    """A bit mask over 64-bit keys (one column): in word (k >>> 12) mod words the bits k mod 64 and (k >>> 6) mod 64 are set.

    It grows with the number of keys up to MASK_BITS[1] (32 MB), and is fuller beyond. A mask only saves work: what it lets
    through is checked by a join, so a full one costs time and never a result.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    place = scratch_dir(spark)
    keys = written(keys.select(F.col(name).alias("k")), place)
    least, most = MASK_BITS
    words = min(most, max(least, 1 << max(0, keys.count() * BITS_PER_KEY - 1).bit_length())) // 64
    bits = F.expr("shiftleft(1L, cast(k & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(k, 6) & 63 as int))")
    found = keys.groupBy(F.expr(f"shiftrightunsigned(k, 12) % {words}L").alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    mask = np.zeros(words, np.int64)
    mask[found["word"].to_numpy()] = found["bits"].to_numpy()
    dropped(spark, place)
    return mask


def masked(keys: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be among those of a mask."""
    keys, words = keys.view(np.uint64), mask.view(np.uint64)
    word = words[((keys >> np.uint64(12)) % np.uint64(len(words))).astype(np.int64)]
    return (word >> (keys & np.uint64(63))) & (word >> ((keys >> np.uint64(6)) & np.uint64(63))) & np.uint64(1) == 1


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose 64-bit key may be one of keys, and those whose isn't: the first take part in a join, the others need no shuffle.

    Native: a broadcast row of at most 32 MB holds the mask; a null key is none of the keys.
    """
    mask, name = mask_of(keys), free_name(rows, "_mask")
    one = F.broadcast(rows.sparkSession.createDataFrame(pa.table({name: pa.array([mask], pa.list_(pa.int64()))})))
    word = F.get(F.col(name), F.pmod(F.shiftrightunsigned(key, 12), F.lit(len(mask))).cast("int"))
    bit = lambda k: F.call_function("shiftright", word, k.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    there = F.coalesce(bit(key).bitwiseAND(bit(F.shiftrightunsigned(key, 6))) == 1, F.lit(False))
    return rows.join(one, there, "left_semi"), rows.join(one, there, "left_anti")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], n: int, how: str = "left", heavy: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has each key once, so that no key's rows of left meet in one task.

    Keys that more than one in HEAVY_KEYS of left's n rows share are fewer than HEAVY_KEYS: right's rows of those are
    broadcast; all others are joined by a shuffle. Rows of left with a null key match nothing and are not dealt at all.
    heavy: those keys, where they are known. left is read a few times.
    """
    lone = F.lit(False)
    for k in keys:
        lone = lone | F.col(k).isNull()
    out = None
    if how == "left":
        own = [c for c in left.columns if c not in keys]
        out = left.filter(lone).select(*keys, *own, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys])
    left = left.filter(~lone)
    if heavy is None:
        heavy = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") * HEAVY_KEYS > n).select(*keys)
    heavy = F.broadcast(heavy.limit(HEAVY_KEYS))  # the limit is never met: it states the bound
    some = left.join(heavy, keys, "left_semi").join(F.broadcast(right.join(heavy, keys, "left_semi")), keys, how)
    both = some.unionByName(left.join(heavy, keys, "left_anti").join(right, keys, how))
    return both if out is None else both.unionByName(out)
