"""What the operators of this subpackage share: reading, registering, naming."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL giving the same rows where there is one."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_KEYS = 1_000_000  # of at most 16 bytes each


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(rows: DataFrame, on: Column, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``on`` is not among ``keys``, a stored table of one column without repeats.

    Up to a number of keys that is counted first they are broadcast, so that the texts stay where they are;
    beyond it both sides are shuffled. The result is the same.
    """
    name = free_name(rows, "_gone")
    gone = keys.select(F.col(keys.columns[0]).alias(name))
    gone = F.broadcast(gone) if keys.count() <= BROADCAST_KEYS else gone
    return rows.join(gone, on == F.col(name), "left_anti")


HOT_KEYS = 10_000  # a key with more than this part of all rows is a hot one: there are fewer of them


def attach_by_key(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """All ``rows`` with the columns of ``side``, which has one row per ``key``; both are stored tables.

    Rows of one key never fill a task: those of hot keys stay where they are and meet their row of ``side`` by a
    broadcast, which holds fewer than ``HOT_KEYS`` rows whatever the data, and rows without a key meet nothing.
    The rest is shuffled, where no key has more than that part of the rows.
    """
    known = rows.where(F.col(key).isNotNull())
    hot = known.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") * HOT_KEYS > rows.count())
    hot = F.broadcast(materialize(hot.select(key)))
    often = known.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, "left")
    seldom = known.join(hot, key, "left_anti").join(side, key, "left")
    without_key = rows.where(F.col(key).isNull())
    for field in side.schema:
        if field.name != key:
            without_key = without_key.withColumn(field.name, F.lit(None).cast(field.dataType))
    return often.unionByName(seldom).unionByName(without_key)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for the Python workers; at the end of a task they give the memory it needed back to the machine.

    Workers live on and serve the tasks of later stages, beside whose needs what allocators hold back would count.
    """
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: there is nothing to ask for
    return task


def buckets(spark: SparkSession, each: int = 1) -> int:
    """Pieces for work dealt out by a hash, in proportion to the shuffle partitions."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memory:
    """Values remembered by key in two halves: what is used again moves to the newer one, the older one is dropped
    when the newer one is full. So what comes often stays, and at most twice ``half`` values are held."""

    def __init__(self, half: int):
        self.half = half
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


BATCH_BYTES = 8 << 20  # of rows that go to a Python worker at once
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, and rows to them in batches of bounded size.

    Workers need not find the package on their own path: the driver may have put the folder
    on its path only after the session started. The bound is a setting of the session, lowered to
    ``BATCH_BYTES`` where it is higher: long texts otherwise fill batches of ten thousand rows on both
    sides of every task. It changes no result.
    """
    context = spark.sparkContext
    held = spark.conf.get(_BATCH_SETTING).strip().lower().removesuffix("b")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    if (int(held[:-1]) * units[held[-1]] if held[-1:] in units else int(held)) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    if getattr(context, "_package_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._package_shipped = True
