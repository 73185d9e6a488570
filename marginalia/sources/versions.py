"""Tables that change as a whole: Parquet folders behind numbered pointers.

A change writes new folders first and then one small file, the next pointer, which is renamed into
place and never overwritten. Readers see the last pointer's folders only. A change that dies before
its pointer leaves nothing that is read; of two changes that began at one version, one finds its
pointer's place taken and is made again on top of the other.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session that driver and executors share, below spark.checkpoint.dir; it goes when the driver's JVM ends.

    Only where that is unset and all runs on one machine a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _goes_at_exit(spark, tempfile.mkdtemp(prefix="marginalia-"))
        spark.sparkContext.setCheckpointDir(base)
    return _goes_at_exit(spark, f"{base.rstrip('/')}/marginalia-{uuid.uuid4().hex}")


def _goes_at_exit(spark: SparkSession, where: str) -> str:
    """Makes a folder and has it deleted when the driver's JVM ends; only one that is there already can be named for that."""
    fs, path = _at(spark, where)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


#: Rows from which a written table is never broadcast, whatever its files' size.
MOST_BROADCAST = 100_000


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, for what is used several times or in rounds: written once as Parquet, so that each use reads its own columns only and texts lie on disk compressed.

    Spark takes the size of a table from its compressed files, here 30 times too small and more, and
    would broadcast millions of rows through the driver; from MOST_BROADCAST rows on joins are shuffled.
    """
    spark = df.sparkSession
    where = shared_folder(spark)
    df.write.mode("append").option("compression", "zstd").parquet(where)
    written = spark.read.schema(df.schema).parquet(where)
    return written.hint("merge") if written.count() > MOST_BROADCAST else written  # from the files' footers


def _at(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_once(spark: SparkSession, where: str, text: str) -> bool:
    """Writes a small file that is seen whole or not at all; False if there is one of that name already."""
    fs, path = _at(spark, where)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{where.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(own), fs.makeQualified(path), options)
    except Exception as e:
        fs.delete(own, False)
        if fs.exists(path):
            return False
        raise e
    return True


class Pointers:
    """The numbered states of what lies in a folder. A state is a dict; of each number there is one."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def numbers(self) -> list[int]:
        fs, path = _at(self.spark, f"{self.where}/_versions")
        if not fs.exists(path):
            return []
        return sorted(int(name) for f in fs.listStatus(path) if (name := f.getPath().getName()).isdigit())

    def at(self, number: int) -> dict:
        fs, path = _at(self.spark, f"{self.where}/_versions/{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The number and state now; 0 and no state at first."""
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, {})

    def put(self, number: int, state: dict) -> bool:
        return put_once(self.spark, f"{self.where}/_versions/{number:012d}", json.dumps(state, sort_keys=True))

    def change(self, make: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Puts make(state) behind the state that it was made from, anew as long as another change comes first; None changes nothing."""
        for _ in range(tries):
            number, state = self.last()
            made = make(state)
            if made is None:
                return number
            if self.put(number + 1, made):
                return number + 1
        raise RuntimeError(f"others changed {self.where} {tries} times meanwhile")

    def drop(self, folder: str) -> None:
        fs, path = _at(self.spark, f"{self.where}/{folder}")
        fs.delete(path, True)


class Table:
    """Rows by key in buckets of the key's hash; a change writes the buckets that it touches anew and leaves the others.

    A change can carry a writer's name and batch number: one that is not above the writer's last is a
    replay and changes nothing, so that a stream's batch counts once however often it is sent.
    """

    def __init__(self, spark: SparkSession, where: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.pointers = Pointers(spark, where)
        self.columns = spark.createDataFrame([], schema).columns

    def version(self) -> int:
        return self.pointers.last()[0]

    def read(self, version: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """The rows now, or as they were at a version that has not been forgotten."""
        state = self.pointers.last()[1] if version is None else self.pointers.at(version)
        return self._rows(spark or self.spark, state.get("folders", {}).items())

    def _rows(self, spark: SparkSession, folders) -> DataFrame:
        paths = [f"{self.pointers.where}/{folder}/_bucket={bucket}" for bucket, folder in folders if folder]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def apply(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None, batch: int | None = None) -> int:
        """Sets what the keys' buckets hold to how(what they hold, new rows); the version after that.

        new has the key columns, as has what comes back, whose keys must lie in the same buckets (an
        upsert, a replacement or a deletion by key does).
        """
        spark = new.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()]  # at most one for each bucket
        made: list[str] = []

        def make(state: dict) -> dict | None:
            if writer is not None and batch is not None and batch <= state.get("writers", {}).get(writer, -1):
                return None
            folders, folder = dict(state.get("folders", {})), f"data-{uuid.uuid4().hex}"
            rows = how(self._rows(spark, [(b, folders[b]) for b in touched if b in folders]), new).select(*self.columns)
            if touched:
                where = f"{self.pointers.where}/{folder}"
                # rebalanced: a large bucket becomes several files
                rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(where)
                fs, path = _at(spark, where)
                full = {name.partition("=")[2] for f in fs.listStatus(path) if "=" in (name := f.getPath().getName())}
                folders |= {b: folder if b in full else None for b in touched}
                if full:
                    made.append(folder)
                else:
                    self.pointers.drop(folder)
            writers = state.get("writers", {}) | ({writer: batch} if writer is not None else {})
            return {"folders": folders, "writers": writers}

        number = self.pointers.change(make)
        for folder in made[:-1]:  # made on top of a version that was the last no more
            self.pointers.drop(folder)
        return number

    def forget(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last `keep` versions reads, and those versions' pointers."""
        numbers = self.pointers.numbers()
        held = {f for n in numbers[-keep:] for f in self.pointers.at(n)["folders"].values()}
        for n in numbers[:-keep]:
            for folder in set(self.pointers.at(n)["folders"].values()) - held - {None}:
                self.pointers.drop(folder)
        for n in numbers[:-keep]:
            self.pointers.drop(f"_versions/{n:012d}")


def stream_into(stream: DataFrame, table: Table, how: Callable[[DataFrame, DataFrame], DataFrame], name: str, checkpoint: str):
    """A writer (to be started) that applies a stream's batches to a table, each once: after a crash the batch that is sent again is known by its number."""
    return stream.writeStream.foreachBatch(lambda rows, batch: table.apply(rows, how, name, batch)).option("checkpointLocation", checkpoint)


def cached(spark: SparkSession, where: str, key: str, version: int, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, read if they were written for this key and version, else written first.

    Each writer writes to a folder of its own and then points to it; of several at once the first
    counts for all, and a write that fails leaves nothing that is read.
    """
    pointers = Pointers(spark, f"{where.rstrip('/')}/{key}.v{version}")

    def write(state: dict) -> dict | None:
        if state:
            return None
        folder = f"data-{uuid.uuid4().hex}"
        make().write.parquet(f"{pointers.where}/{folder}")
        return {"folder": folder}

    pointers.change(write)
    return spark.read.parquet(f"{pointers.where}/{pointers.last()[1]['folder']}")
