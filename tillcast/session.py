"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. Only the join skew and partition sizing
# settings matter for results at scale; none changes a result.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tillcast", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the recommended settings, for scripts and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without one gets a fresh temporary folder. A cluster without
    one is an error: a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tillcast-")
    if named.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError(f"{named} is a folder of one machine; spark.checkpoint.dir has to be shared by all executors")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the stored table.

    Later jobs neither recompute the plan above nor lose it with an executor, and
    they read only the columns and row groups they need.
    """
    return materialize_at(df)[0]


def materialize_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``materialize``, with the path of the stored table for those who delete it."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_stored(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more; only tables of the shared folder."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not in the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def side_by_side(spark: SparkSession, job, items, parallelism: int) -> list:
    """Results of ``job`` on each item, up to ``parallelism`` at a time.

    Model fits are chains of short Spark jobs that leave a cluster waiting for
    the driver; independent fits fill the gaps.
    """
    items = list(items)
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(job), items)
