"""What changed since a snapshot, by content hashes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changeset(current: DataFrame, old: DataFrame) -> DataFrame:
    """file_path, status (added, modified, unchanged, deleted), and the other columns of both sides but the old hash.

    Both: file_path, hash, and columns that the other side doesn't have.
    """
    now = current.withColumn("_now", F.lit(True))
    then = old.withColumnRenamed("hash", "_then").withColumn("_there", F.lit(True))
    same = F.col("hash").eqNullSafe(F.col("_then"))
    state = F.when(F.col("_there").isNull(), "added").when(F.col("_now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    more = [c for c in (*current.columns, *old.columns) if c not in ("file_path", "hash")]
    return now.join(then, "file_path", "full_outer").select("file_path", state.alias("status"), "hash", *more)
