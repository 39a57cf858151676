"""A graph on disk: Parquet tables, JSON for interchange, and the registry of graphs."""
from __future__ import annotations

import json
import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, StoreVersionError
from ..operators.graph import Graph
from ..schema import EDGES, FILE_HASHES, NODES, conform

VERSION = 1
FACTS = ("imports", "calls", "heritage")
#: Of each file: its content's hash, and a hash of its facts (null: not known).
HASHES = T.StructType([*FILE_HASHES.fields, T.StructField("facts", T.LongType())])


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


# A graph is a folder of tables in folders by generation, and of manifests. A manifest names the tables of a
# generation, of which some may be an earlier one's; it is written when all its tables are, so a run that breaks off
# leaves the generation before it as it was.


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, p = _path(spark, f"{path}/manifests")
    return sorted(int(m[1]) for f in (fs.listStatus(p) if fs.exists(p) else []) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName())))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest generation's number and tables, None without a graph. What was cut off while it was written doesn't count."""
    for n in reversed(_manifests(spark, path)):
        fs, p = _path(spark, f"{path}/manifests/{n}.json")
        stream = fs.open(p)
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            continue
        finally:
            stream.close()
        if found.get("version") != VERSION:
            raise StoreVersionError(f"{path} has version {found.get('version')}; this is {VERSION}")
        return found
    return None


def exists(spark: SparkSession, path: str) -> bool:
    """In any file system that Spark reads."""
    return bool(_manifests(spark, path))


class Generation:
    """A generation that is being written: tables are put into it, and `done` makes it the newest."""

    def __init__(self, spark: SparkSession, path: str, before: dict | None = None):
        self.spark, self.path, self.before = spark, path, before
        numbers = _manifests(spark, path)
        self.number = numbers[-1] + 1 if numbers else 1
        self.folder = f"{self.number}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, list[str]] = {}
        self.notes: dict = {}  # what else the manifest says

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        """A part of a table, read back."""
        at = f"{self.folder}/{name}-{len(self.tables.get(name, []))}"
        rows.write.parquet(f"{self.path}/{at}")
        self.tables.setdefault(name, []).append(at)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{at}")

    def keep(self, *names: str) -> None:
        """The tables of the generation before, as they are."""
        self.tables |= {n: self.before["tables"][n] for n in names if n in self.before["tables"]}

    def done(self) -> None:
        fs, p = _path(self.spark, f"{self.path}/manifests/{self.number}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"version": VERSION, "generation": self.number, "tables": self.tables, "notes": self.notes}).encode()))
        out.close()
        self._forget()

    def _forget(self) -> None:
        """Deletes what neither this generation nor the one before it needs: readers of that one may still be at work."""
        used = {t.split("/")[0] for m in (self.before, {"tables": self.tables}) if m for parts in m["tables"].values() for t in parts}
        fs, p = _path(self.spark, self.path)
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if re.fullmatch(r"\d+-[0-9a-f]{8}", name) and name not in used and int(name.split("-")[0]) < self.number:
                fs.delete(f.getPath(), True)
        least = self.before["generation"] if self.before else self.number
        for n in _manifests(self.spark, self.path):
            if n < least:
                drop(self.spark, f"{self.path}/manifests/{n}.json")


def _table(spark: SparkSession, path: str, found: dict, name: str, schema: T.StructType) -> DataFrame:
    parts = [f"{path}/{t}" for t in found["tables"].get(name, [])]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def laid(edges: DataFrame) -> DataFrame:
    """Edges by relation within each file, so that a scan for one relation skips the rest."""
    return conform(edges, EDGES).sortWithinPartitions("rel_type", "source_id")


def save(graph: Graph, file_hashes: DataFrame, path: str, facts: dict[str, DataFrame] | None = None) -> None:
    """Nodes, edges, hashes and facts (None: there are none) as the newest generation."""
    spark = graph.nodes.sparkSession
    made = Generation(spark, path, manifest(spark, path))
    made.put(conform(graph.nodes, NODES), "nodes")
    made.put(laid(graph.edges), "edges")
    made.put(conform(file_hashes, HASHES), "file_hashes")
    for name, rows in (facts or {}).items():
        if rows is not None:
            made.put(rows, name)
    made.done()


def load(spark: SparkSession, path: str, found: dict | None = None) -> tuple[Graph, DataFrame]:
    found = found or manifest(spark, path)
    if found is None:
        raise EngineError(f"no graph in {path}")
    return Graph(_table(spark, path, found, "nodes", NODES), _table(spark, path, found, "edges", EDGES)), _table(spark, path, found, "file_hashes", HASHES)


def load_facts(spark: SparkSession, path: str, found: dict | None = None) -> dict[str, DataFrame]:
    """The facts by kind; None where there are none."""
    found = found or manifest(spark, path)
    return {n: spark.read.parquet(*[f"{path}/{t}" for t in found["tables"][n]]) if n in found["tables"] else None for n in FACTS}


def read_graph_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A graph from one JSON document {version, nodes, edges, file_hashes}: labels, relations and languages by their names in code
    (`StepInProcess`), hashes as unsigned numbers."""
    number = T.DecimalType(20, 0)
    inner = T.StructType([T.StructField(f.name, number if f.name == "body_hash" else f.dataType) for f in NODES if f.name not in ("id", "label", "annotations")])
    node = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", inner)])
    whole = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("nodes", T.ArrayType(node)), T.StructField("edges", T.ArrayType(EDGES)), T.StructField("file_hashes", T.MapType(T.StringType(), number))])
    doc = spark.read.schema(whole).option("multiLine", True).json(path)
    version = doc.select("version").first()
    if version is None or version[0] != VERSION:
        raise StoreVersionError(f"{path} has no version {VERSION}")
    signed = lambda c: F.when(F.col(c) >= F.lit(str(1 << 63)).cast(number), F.col(c) - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(F.col(c)).cast("long")
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", "n.label", "n.properties.*").withColumns({"body_hash": signed("body_hash"), "language": F.lower("language")})
    edges = doc.select(F.explode("edges").alias("e")).select("e.*").withColumn("rel_type", F.upper(F.regexp_replace("rel_type", "(?<=[a-z])(?=[A-Z])", "_")))
    hashes = doc.select(F.explode("file_hashes").alias("file_path", "hash")).withColumn("hash", signed("hash"))
    return Graph(conform(nodes, NODES), conform(edges, EDGES)), conform(hashes, FILE_HASHES)


def _nested(columns: tuple[str, ...]):
    return F.struct(*[F.col(c) for c in columns]).alias("properties")


def write_json(graph: Graph, file_hashes: DataFrame, path: str) -> None:
    """The interchange format as JSON lines: each line has `kind` and a node, an edge or a file's hash; nulls are left out."""
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "label", _nested(tuple(f.name for f in NODES if f.name not in ("id", "label"))))).alias("value"))
    edges = graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *EDGES.names)).alias("value"))
    hashes = file_hashes.select(F.to_json(F.struct(F.lit("file_hash").alias("kind"), "file_path", "hash")).alias("value"))
    head = graph.nodes.sparkSession.createDataFrame([(json.dumps({"kind": "version", "version": VERSION}),)], "value string")
    head.unionByName(nodes).unionByName(edges).unionByName(hashes).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    version = lines.filter(kind == "version").select(F.get_json_object("value", "$.version").cast("int")).first()
    if version is None or version[0] != VERSION:
        raise StoreVersionError(f"{path} has no version {VERSION}")

    def rows(name: str, schema) -> DataFrame:
        return lines.filter(kind == name).select(F.from_json("value", schema).alias("r"))

    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES if f.name not in ("id", "label"))
    nodes = rows("node", f"id string, label string, properties struct<{inner.replace(' ', ':').replace(',:', ',')}>").select("r.id", "r.label", "r.properties.*")
    return Graph(conform(nodes, NODES), conform(rows("edge", EDGES).select("r.*"), EDGES)), conform(rows("file_hash", FILE_HASHES).select("r.*"), FILE_HASHES)


# --- the registry of graphs ------------------------------------------------------------------


class Registry:
    """Names of graphs and where they are, in one small JSON file; a file that can't be read is empty."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def entries(self) -> dict[str, dict]:
        try:
            found = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}
        repos = found.get("repos") if isinstance(found, dict) else None
        return repos if isinstance(repos, dict) else {}

    def _write(self, repos: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"repos": repos}, indent=1, sort_keys=True))
        os.replace(part, self.path)

    def upsert(self, root: str, store: str, **counts: int) -> str:
        name = os.path.basename(os.path.abspath(root))
        self._write(self.entries() | {name: {"path": os.path.abspath(root), "store": store, "indexed_at": f"unix:{int(time.time())}", **counts}})
        return name

    def remove(self, root: str) -> bool:
        repos = self.entries()
        gone = repos.pop(os.path.basename(os.path.abspath(root)), None)
        if gone is not None:
            self._write(repos)
        return gone is not None

    def listing(self) -> list[dict]:
        """Entries by name; stale if the repository isn't there any more."""
        return [{"name": n, **e, "stale": not os.path.isdir(e.get("path", ""))} for n, e in sorted(self.entries().items())]


def clean(spark: SparkSession, root: str, store: str, registry: Registry | None = None) -> bool:
    """Without a graph's tables and its entry."""
    found = drop(spark, store)
    if registry:
        registry.remove(root)
    return found

