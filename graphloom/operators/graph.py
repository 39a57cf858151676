"""Upserts, lookups, degrees and listings over `nodes` and `edges`. Edges may dangle: lookups of their ends are left joins."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NODES, conform, file_nodes, is_symbol, make_edges

# Names that a symbol listing takes for a label.
LABEL_ALIASES = {
    "function": "Function", "fn": "Function", "class": "Class", "method": "Method", "interface": "Interface", "enum": "Enum", "type": "TypeAlias", "typealias": "TypeAlias",
    "variable": "Variable", "var": "Variable", "property": "Property", "prop": "Property", "struct": "Struct", "trait": "Trait",
}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


# --- upserts ---------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows of both by `id`; a new row replaces an old one, and of several new ones the last by `order` (a column of `new`; the
    rows' order in the table, if it isn't given) stays."""
    rank = order if order is not None else F.monotonically_increasing_id()
    both = old.select(F.lit(0).alias("_new"), F.lit(None).cast("long").alias("_rank"), *old.columns).unionByName(new.select(F.lit(1).alias("_new"), rank.cast("long").alias("_rank"), *old.columns))
    # a struct maximum aggregates before the shuffle, where row_number() would move and sort every row
    rest = F.struct(*[c for c in old.columns if c != "id"])
    last = both.groupBy("id").agg(F.max_by(rest, F.struct("_new", "_rank", F.xxhash64(*old.columns))).alias("r"))
    return last.select(*[F.col("id") if c == "id" else F.col(f"r.`{c}`").alias(c) for c in old.columns])


def remove_files(graph: Graph, paths: DataFrame) -> Graph:
    """Without the nodes of the files (column file_path) and all edges at those nodes."""
    gone = graph.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("gone"))
    edges = graph.edges.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("target_id") == F.col("gone"), "left_anti")
    return Graph(graph.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), edges)


def structure(files: DataFrame, link_all: bool = False) -> Graph:
    """Project, File and Folder nodes; each folder contains its first file only, or all with `link_all`.

    files: relative_path, language.
    """
    spark = files.sparkSession
    project = conform(spark.createDataFrame([("project::root", "Project", "root", "")], "id string, label string, name string, file_path string"), NODES)
    own = files.select("relative_path", "language", X.dirname(F.col("relative_path")).alias("dir"))
    folders = own.filter("dir <> ''").groupBy("dir").agg(F.min("relative_path").alias("first"))
    folder_nodes = conform(folders.select(F.concat(F.lit("folder::"), "dir").alias("id"), F.lit("Folder").alias("label"), X.basename(F.col("dir")).alias("name"), F.col("dir").alias("file_path")), NODES)
    linked = own.filter("dir <> ''").select("dir", F.col("relative_path").alias("first")) if link_all else folders
    edges = make_edges(linked, F.concat(F.lit("folder::"), "dir"), F.concat(F.lit("file::"), "first"), "CONTAINS", 1.0, "folder contains file")
    return Graph(project.unionByName(file_nodes(own, F.col("relative_path"), F.col("language"))).unionByName(folder_nodes), edges)


def file_contains(nodes: DataFrame) -> DataFrame:
    """CONTAINS edges from each symbol's file to it."""
    return make_edges(nodes.filter(is_symbol(F.col("label"))), F.concat(F.lit("file::"), "file_path"), F.col("id"), "CONTAINS", 1.0, "file contains definition")


# --- lookups ---------------------------------------------------------------------------------


def by_id(rows: DataFrame, ids: Iterable[str]) -> DataFrame:
    return rows.filter(F.col("id").isin(*ids))


def outgoing(edges: DataFrame, node_id: str, rel_type: str | None = None) -> DataFrame:
    found = edges.filter(F.col("source_id") == node_id)
    return found.filter(F.col("rel_type") == rel_type) if rel_type else found


def incoming(edges: DataFrame, node_id: str, rel_type: str | None = None) -> DataFrame:
    found = edges.filter(F.col("target_id") == node_id)
    return found.filter(F.col("rel_type") == rel_type) if rel_type else found


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path)


def substring_search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols whose name contains the query, in any case; the first `limit` by id."""
    return nodes.filter(is_symbol(F.col("label")) & F.lower("name").contains(query.lower())).orderBy("id").limit(limit)


def symbols(nodes: DataFrame, label: str | None = None, limit: int = 20) -> DataFrame:
    """The first symbols by id; a label that isn't known filters nothing."""
    known = LABEL_ALIASES.get(label.lower()) if label else None
    found = nodes.filter(F.col("label") == known) if known else nodes.filter(is_symbol(F.col("label")))
    return found.orderBy("id").limit(limit)


def node_view(nodes: DataFrame) -> DataFrame:
    """The ten public fields of a node."""
    return nodes.select(
        "id", "name", "label", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "end_line", F.col("is_exported").alias("exported"), "language", "return_type", F.col("is_async").alias("async")
    )


def enriched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends, null where an end has no node."""
    name = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    joined = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    return joined.select("id", F.col("source_id").alias("source"), "source_name", F.col("target_id").alias("target"), "target_name", F.col("rel_type").alias("type"), "confidence", "reason")


# --- counts ----------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree of each node that has an edge; a loop counts on both sides."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    # one pass and one shuffle for both directions; map-side sums take the heat off hubs
    out = edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("out_degree", "in_degree", "degree")}
    return nodes.join(degrees(edges), "id", "left").withColumns(zero)


def totals(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("node_count"), F.countDistinct("file_path").alias("file_count"))
    return n.crossJoin(graph.edges.agg(F.count("*").alias("edge_count")))  # one row by one row


def status(graph: Graph) -> DataFrame:
    """Counts of the usual labels, and totals."""
    labels = ("Function", "Class", "Method", "Interface", "File")
    n = graph.nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("label") == x).alias(f"{x.lower()}s") for x in labels])
    return n.crossJoin(graph.edges.agg(F.count("*").alias("edges")))  # one row by one row


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).count().orderBy(column)


# --- neighbourhoods --------------------------------------------------------------------------


def context(graph: Graph, name: str, limit: int = 15) -> DataFrame:
    """For each node of a name, its first `limit` edges of each direction by edge id, with the neighbour's name."""
    own = by_name(graph.nodes, name).select(F.col("id").alias("node_id"), "label", "file_path")
    each = []
    for side, other, direction in (("source_id", "target_id", "out"), ("target_id", "source_id", "in")):
        each.append(graph.edges.join(own, F.col(side) == F.col("node_id")).select("node_id", F.lit(direction).alias("direction"), "id", "rel_type", F.col(other).alias("neighbour_id"), "confidence"))
    order = Window.partitionBy("node_id", "direction").orderBy("id")
    top = each[0].unionByName(each[1]).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    names = graph.nodes.select(F.col("id").alias("neighbour_id"), F.col("name").alias("neighbour_name"))
    return top.join(names, "neighbour_id", "left").select("node_id", "direction", "position", "rel_type", "neighbour_id", "neighbour_name", "confidence")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids (column id)."""
    keep = ids.select(F.col("id").alias("_keep"))
    return edges.join(keep, F.col("source_id") == F.col("_keep"), "left_semi").join(keep, F.col("target_id") == F.col("_keep"), "left_semi")


def top_by_degree(graph: Graph, limit: int) -> DataFrame:
    """Symbols with the most edges; ties by id."""
    return with_degrees(graph.nodes.filter(is_symbol(F.col("label"))), graph.edges).orderBy(F.desc("degree"), "id").limit(limit)


def whole(graph: Graph) -> tuple[DataFrame, DataFrame]:
    return node_view(graph.nodes), enriched(graph.edges, graph.nodes)
