"""What several operators need: the shared folder, cut lineages, gapless row numbers, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: spark_partition_id() sits above this many bits in monotonically_increasing_id().
ROW_BITS = 33


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (tests) a temporary folder takes its place;
    on a cluster it must be set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marginalia-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    _goes_at_exit(spark, sc.getCheckpointDir())
    return base.rstrip("/")


def _goes_at_exit(spark: SparkSession, where: str) -> None:
    """Makes a folder, and has it deleted when the driver's JVM ends: only one that is there already can be named for that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A place for a new folder below the shared one; it goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/marginalia-{what}-{uuid.uuid4().hex}"
    _goes_at_exit(spark, own)
    return f"{own}/rows"


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(session_of(df))
    return df.checkpoint(eager=True)


def table(df: DataFrame, what: str) -> DataFrame:
    """The frame written as compressed Parquet to the shared folder and read again (for wide rows)."""
    where = fresh_dir(session_of(df), what)
    df.write.option("compression", "zstd").parquet(where)
    return session_of(df).read.schema(df.schema).parquet(where)


def spread(df: DataFrame) -> DataFrame:
    """The frame, dealt over all cores if fewer parts than cores have rows (a small input, or files of one row group). Reads no column to find out."""
    cores = session_of(df).sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df.repartition(cores) if held < cores else df


def byte_size() -> Column:
    """UTF-8 bytes of a text as a long; null has none."""
    return F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds gapless numbers from 0 within each group, in the given order.

    Rows are dealt by ranges of (group, order), so that a large group spans many partitions; each
    partition numbers its own rows, and the offsets come from one row for each partition and group.
    """
    row, part = F.col("_row"), F.shiftright("_row", ROW_BITS)
    dealt = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id()))
    spans = dealt.groupBy(group, part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    # spans has at most one row for each partition and one more for each group: a bounded broadcast
    joined = dealt.withColumn("_part", part).join(F.broadcast(spans), [group, "_part"])
    return joined.withColumn(name, row + F.col("_shift")).drop("_row", "_part", "_shift")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """The batch in runs of rows of about `limit` bytes of text (one row may be longer)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
