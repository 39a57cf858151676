"""Tables that end a lineage: written to the folder that the cluster shares, and read back."""
from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset: a folder under /tmp in local mode, an error on a cluster,
    where a machine's own folder would lose files with the machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return at.rstrip("/")


def mounted_dir(spark: SparkSession) -> str:
    """The shared folder as a path that programs open as well; an error where it isn't one (a file system that isn't mounted)."""
    at = shared_dir(spark)
    path = at.removeprefix("file://") if at.startswith("file://") else at.removeprefix("file:")
    if "://" in path:
        raise EngineError(f"{at} is no folder that is mounted; a repository's files have to be in one")
    return path


_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a written table: lost executors cost no recomputation of what is above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._staged_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is wanted of them has to be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """The rows with their place in an order, from 0, in a written table.

    A sort over all partitions, and the counts of these, instead of a window that takes all rows to one task.
    """
    spark = df.sparkSession
    laid = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    before, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in laid.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        rows.append((p, before))
        before += n
    starts = spark.createDataFrame(rows, "_part int, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start", "_at")
