"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives lost executors.  The folder is the
session's ``spark.checkpoint.dir``; only where that is unset and the master is
local (tests, a single machine) is a temporary folder of our own made and used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile hand Python workers batches of at most about 8 MB, however long the rows."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def if_small(table: DataFrame, bytes_a_row: int, most: int = 64 << 20) -> DataFrame:
    """A written ``table``, marked for broadcast where its counted rows take at most ``most`` bytes, as one side of a join.

    Beyond that the join shuffles, and adaptive execution splits its skewed partitions.
    """
    return F.broadcast(table) if table.count() * bytes_a_row <= most else table


WORDS = 1 << 19  # of a sieve, at most: 4 MB of bits


class Sieve:
    """A filter of bounded size for the keys of a written table: it lets all of them through, and few other rows.

    Every key sets four bits of one of at most WORDS words of 64 bits, so what
    is broadcast does not grow with the data.  With very many keys more other
    rows pass, which costs the exact join behind it, never a result.
    """

    def __init__(self, keys: DataFrame, *key: str):
        n = keys.count()
        self.words = min(WORDS, 1 << (n // 6).bit_length())
        self.bits = keys.select(*self._place(*map(F.col, key))).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))

    def _place(self, *key: Column) -> list[Column]:
        h = F.xxhash64(*key, F.lit(77))
        mask = F.lit(0).cast("long")
        for k in range(4):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
        return [F.pmod(F.shiftright(h, 24), F.lit(self.words)).alias("__word"), mask.alias("__mask")]

    def split(self, df: DataFrame, *key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows of ``df`` that may have one of the keys, and rows that have none; no row is shuffled."""
        word, mask = self._place(*key)
        marked = df.withColumns({"__w": word, "__m": mask})
        hit = (F.col("__w") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__m")) == F.col("__m"))
        bits = F.broadcast(self.bits)
        return tuple(marked.join(bits, hit, how).select(*df.columns) for how in ("left_semi", "left_anti"))


class Scratch:
    """Named tables under one fresh folder; ``close`` removes all but those kept."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._turn = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        self._turn += 1
        name = name or f"t{self._turn}"
        self.names.add(name)
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(self.path(name))
            fs.delete(p, True)
            self.names.discard(name)

    def close(self, *keep: str) -> None:
        """Remove every table but ``keep``; those go when the application ends."""
        self.drop(*(self.names - set(keep)))
        fs, p = self._fs(self.root)
        if keep:
            fs.deleteOnExit(p)
        else:
            fs.delete(p, True)
