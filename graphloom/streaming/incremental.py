"""Changes of files as a stream: each micro-batch of file contents becomes facts, and the graph is linked anew."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CALLS, HERITAGE, IMPORTS, NODES
from ..sources import facts as facts_of
from ..sources import store
from ..staging import scratch, staged

_KEY = [T.StructField("relative_path", T.StringType()), T.StructField("batch", T.LongType())]
_FILES = T.StructType([*_KEY, T.StructField("language", T.StringType()), T.StructField("alive", T.BooleanType())])
_FACTS = {"nodes": NODES, **{n: T.StructType([T.StructField("ordinal", T.IntegerType()), *s.fields]) for n, s in (("imports", IMPORTS), ("calls", CALLS), ("heritage", HERITAGE))}}


def latest(files: DataFrame) -> DataFrame:
    """One row for each path: the last by `arrived`."""
    rest = [c for c in files.columns if c != "relative_path"]
    return files.groupBy("relative_path").agg(F.max_by(F.struct(*rest), "arrived").alias("r")).select("relative_path", *[F.col(f"r.{c}").alias(c) for c in rest])


class FactTables:
    """Facts by file in a folder, a part for each micro-batch: what a batch has of a file replaces what earlier ones had.

    Parts are added, not rewritten; when there are `most_parts`, they become one. The folder is a store of generations, each with the
    number of its batch, so a stream that is started again goes on with all files, and a batch that is given twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str, most_parts: int = 32):
        self.spark, self.path, self.most_parts = spark, path, most_parts

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        found = store.manifest(self.spark, self.path)
        parts = [f"{self.path}/{t}" for t in (found["tables"].get(name, []) if found else [])]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _newest(self) -> DataFrame:
        every = self._read("files", _FILES)
        return every.groupBy("relative_path").agg(F.max_by(F.struct("batch", "language", "alive"), "batch").alias("r")).select("relative_path", "r.*")

    @property
    def files(self) -> DataFrame:
        """relative_path, language of the files that are there."""
        return self._newest().filter("alive").select("relative_path", "language")

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The facts by kind, with relative_path."""
        now = self._newest().filter("alive").select("relative_path", "batch")
        return {n: self._read(n, T.StructType([*_KEY, *s.fields])).join(now, ["relative_path", "batch"], "left_semi").drop("batch") for n, s in _FACTS.items()}

    def last_batch(self) -> int:
        found = store.manifest(self.spark, self.path)
        return int(found["tables"]["batch"][0]) if found else -1

    def apply(self, batch: DataFrame, number: int) -> None:
        """batch: relative_path, language, content (null: the file is gone), arrived."""
        if number <= self.last_batch():
            return
        with scratch(self.spark):
            now = staged(latest(batch), "arrived")
            fresh = facts_of.exploded(staged(facts_of.parse(now.filter("content is not null")), "parsed"))
            fresh["nodes"] = fresh["nodes"].withColumn("relative_path", F.col("file_path"))
            before = store.manifest(self.spark, self.path)
            made = store.Generation(self.spark, self.path, before)
            whole = before is not None and len(before["tables"]["files"]) >= self.most_parts
            mine = F.lit(number).cast("long").alias("batch")
            rows = {"files": now.select("relative_path", mine, "language", F.col("content").isNotNull().alias("alive"))}
            rows |= {n: fresh[n].select("relative_path", mine, *s.names) for n, s in _FACTS.items()}
            if whole:
                old = {"files": self._newest().select(*_FILES.names)} | {n: t.join(self._newest().select("relative_path", "batch"), "relative_path").select("relative_path", "batch", *_FACTS[n].names) for n, t in self.tables.items()}
                rows = {n: r.unionByName(old[n]) for n, r in rows.items()}
            elif before:
                made.tables = {n: list(t) for n, t in before["tables"].items() if n != "batch"}
            for n, r in rows.items():
                made.put(r, n)
            made.tables["batch"] = [str(number)]
            made.done()


def follow(stream: DataFrame, checkpoint: str, path: str, linked: Callable[[FactTables, int], None]):
    """Start a query that keeps the fact tables in `path` up to date and calls `linked` after each micro-batch.

    stream: a streaming DataFrame as FactTables.apply takes it.
    """
    state = FactTables(stream.sparkSession, path)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            state.apply(batch, number)
            linked(state, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
