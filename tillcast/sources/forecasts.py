"""Storage of forecasts: every write of a run is a version of its own, and a pointer names the one that counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "run_id string, number bigint, version string"


def write_forecasts(df: DataFrame, path: str, run_id: str) -> None:
    """Store the rows of one run. Writing a run again replaces only that run.

    The rows are written beside what is there; then one file, a pointer to them, makes them visible at once. A
    write that is ended before that changes nothing for readers, and neither does it if it is begun again.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.withColumn("run_id", F.lit(run_id)).write.parquet(_place(path, version))
    known = _pointers(spark, path)
    number = 1 if known is None else (known.agg(F.max("number").alias("n")).first()["n"] or 0) + 1
    spark.createDataFrame([(run_id, number, version)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def read_forecasts(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Stored forecasts, of all runs or of one; only the files of versions that count are read."""
    wanted = _current(spark, path)
    if run_id is not None:
        wanted = [(run, version) for run, version in wanted if run == run_id]
    if not wanted:
        raise ValueError(f"no such run in {path}: {run_id}")
    return spark.read.parquet(*[_place(path, version) for _, version in wanted])


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete versions that no pointer names any more, or never did; returns how many. No run may be being written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {version for _, version in _current(spark, path)}
    gone = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().removeprefix("version-") not in named]
    for place in gone:
        files.delete(place, True)
    return len(gone)


def _place(path: str, version: str) -> str:
    return f"{path}/data/version-{version}"


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).parquet(f"{path}/runs")
    except AnalysisException:  # nothing has been written yet
        return None


def _current(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Run and version, one pair per run: of pointers with one number, as two writers at a time may leave, the greater version."""
    known = _pointers(spark, path)
    if known is None:
        return []
    newest = known.groupBy("run_id").agg(F.max_by("version", F.struct("number", "version")).alias("version"))
    return sorted((r.run_id, r.version) for r in newest.collect())
