"""What changed between two graphs: files, symbols matched in three stages, and edges under one set of ids."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import is_symbol, location_key, with_diff_metadata
from ..staging import staged
from .graph import Graph, degrees

# The order in which changes are shown, and the viewer's groups of labels.
PRIORITY = {"modified": 0, "moved": 1, "added": 2, "removed": 3, "unchanged": 4}
GROUPS = {"File": 0, "Class": 1, "Interface": 2, "Function": 3, "Method": 4, "Enum": 5, "Property": 6, "TypeAlias": 7}
OTHER_GROUP = 8
BODY_FIELDS = ("body_hash", "parameter_count", "return_type", "visibility", "is_async", "is_static", "annotations")
MAX_SYMBOLS = 2000


def _lookup(column: Column, table: dict, otherwise) -> Column:
    return reduce(lambda acc, kv: acc.when(column == kv[0], kv[1]), list(table.items())[1:], F.when(column == next(iter(table)), next(iter(table.values())))).otherwise(otherwise)


def group_of(label: Column) -> Column:
    return _lookup(label, GROUPS, OTHER_GROUP)


def diff_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status, base_hash, head_hash. Both: file_path, hash of the File nodes."""
    joined = base.select(F.col("file_path").alias("path"), F.col("hash").alias("base_hash"), F.lit(True).alias("b")).join(head.select(F.col("file_path").alias("path"), F.col("hash").alias("head_hash"), F.lit(True).alias("h")), "path", "full_outer")
    state = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("base_hash").eqNullSafe(F.col("head_hash")), "unchanged").otherwise("modified")
    return joined.select("path", state.alias("status"), "base_hash", "head_hash")


def _unique(keys: DataFrame, name: str) -> DataFrame:
    """key, id of the keys that one row has. Counts are summed before the shuffle, so a hot key costs nothing."""
    return keys.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias(name)).filter("n = 1").select("key", name)


def match_symbols(base: DataFrame, head: DataFrame) -> DataFrame:
    """base_id, head_id, match_kind: equal keys that are unique among what is left on both sides; place, then symbol, then body."""
    keys = {"location": location_key(), "symbol": F.col("symbol_key"), "body": F.concat_ws("::", "label", F.when(F.col("body_hash").isNotNull(), F.col("body_hash").cast("string")))}
    keys["body"] = F.when(F.col("body_hash").isNotNull(), keys["body"])
    rest_b, rest_h, found = base, head, []
    for kind, key in keys.items():
        pairs = _unique(rest_b.select(key.alias("key"), "id"), "base_id").join(_unique(rest_h.select(key.alias("key"), "id"), "head_id"), "key").select("base_id", "head_id", F.lit(kind).alias("match_kind"))
        pairs = staged(pairs, "matches")  # each stage reads it three times
        found.append(pairs)
        rest_b = rest_b.join(pairs.select(F.col("base_id").alias("id")), "id", "left_anti")
        rest_h = rest_h.join(pairs.select(F.col("head_id").alias("id")), "id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def body_changed(b: str = "base", h: str = "head") -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{b}.{c}").eqNullSafe(F.col(f"{h}.{c}")) for c in BODY_FIELDS])


def diff_symbols(base: Graph, head: Graph) -> DataFrame:
    """canonical_id, status, match_kind, body_changed, base, head (structs of the nodes), and the node's degrees."""
    fields = ("id", "name", "label", "file_path", "qualified_name", "symbol_key", "start_line", "container_name", *BODY_FIELDS)
    side = lambda g: with_diff_metadata(g.nodes.filter(is_symbol(F.col("label")))).select(*fields)
    b, h = side(base), side(head)
    pairs = match_symbols(b, h)
    b_row = b.select(F.col("id").alias("base_id"), F.struct(*fields).alias("base"))
    h_row = h.select(F.col("id").alias("head_id"), F.struct(*fields).alias("head"))
    rows = h_row.join(pairs, "head_id", "left").join(b_row, "base_id", "full_outer")
    moved = (F.col("match_kind") != "location") | (F.col("base.file_path") != F.col("head.file_path")) | ~F.col("base.qualified_name").eqNullSafe(F.col("head.qualified_name"))
    both = F.col("base").isNotNull() & F.col("head").isNotNull()
    status = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(moved, "moved").when(body_changed(), "modified").otherwise("unchanged")
    canonical = F.coalesce(F.col("head.id"), F.concat(F.lit("removed::"), F.col("base.id")))
    own = rows.select(canonical.alias("canonical_id"), status.alias("status"), "match_kind", (both & body_changed()).alias("body_changed"), "base", "head", F.coalesce("head.id", "base.id").alias("_id"), F.col("head").isNotNull().alias("_in_head"))
    d = degrees(head.edges).withColumn("_in_head", F.lit(True)).unionByName(degrees(base.edges).withColumn("_in_head", F.lit(False))).withColumnRenamed("id", "_id")
    return own.join(d, ["_id", "_in_head"], "left").select("canonical_id", "status", "match_kind", "body_changed", "base", "head", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("degree", "in_degree", "out_degree")])


def select_symbols(records: DataFrame, limit: int = MAX_SYMBOLS) -> DataFrame:
    """canonical_id of the first `limit`: changes by kind, then by degree and id, then what is unchanged."""
    order = [_lookup(F.col("status"), PRIORITY, 4), F.desc("degree"), F.col("canonical_id")]
    return records.orderBy(*order).limit(limit).select("canonical_id")


def select_files(selected: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """path of the changed files, and of those that the selected symbols are in on either side."""
    mine = records.join(selected, "canonical_id", "left_semi")
    at = mine.select(F.explode(F.array(F.col("head.file_path"), F.col("base.file_path"))).alias("path")).filter("path is not null")
    return files.filter("status <> 'unchanged'").select("path").unionByName(at).distinct()


def canonical_ids(records: DataFrame, paths: DataFrame, side: str) -> DataFrame:
    """id, canonical_id of a side's symbols, and of the selected files as they are."""
    own = records.filter(F.col(side).isNotNull()).select(F.col(f"{side}.id").alias("id"), "canonical_id")
    file_id = F.concat(F.lit("file::"), "path")
    return own.unionByName(paths.select(file_id.alias("id"), file_id.alias("canonical_id")))


def _mapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    s = ids.select(F.col("id").alias("source_id"), F.col("canonical_id").alias("source"))
    t = ids.select(F.col("id").alias("target_id"), F.col("canonical_id").alias("target"))
    found = edges.join(s, "source_id").join(t, "target_id")
    return found.groupBy("source", F.col("rel_type").alias("type"), "target").agg(F.max("confidence").alias("confidence"))


def diff_edges(base: Graph, head: Graph, base_ids: DataFrame, head_ids: DataFrame, selected: DataFrame) -> DataFrame:
    """source, target, type, status, confidence of edges between selected nodes. selected: id."""
    key = ["source", "type", "target"]
    b, h = _mapped(base.edges, base_ids), _mapped(head.edges, head_ids)
    both = h.withColumnRenamed("confidence", "ch").withColumn("h", F.lit(True)).join(b.withColumnRenamed("confidence", "cb").withColumn("b", F.lit(True)), key, "full_outer")
    status = F.when(F.col("h").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("unchanged")
    rows = both.select("source", "target", "type", status.alias("status"), F.coalesce("ch", "cb").alias("confidence"))
    keep = selected.select(F.col("id").alias("_keep"))
    return rows.join(keep, F.col("source") == F.col("_keep"), "left_semi").join(keep, F.col("target") == F.col("_keep"), "left_semi")


def symbol_records(records: DataFrame, selected: DataFrame, files: DataFrame) -> DataFrame:
    """What a viewer shows of the selected symbols."""
    own = records.join(selected, "canonical_id", "left_semi").withColumn("p", F.coalesce("head", "base"))
    own = own.join(files.select(F.col("path"), (F.col("status") != "unchanged").alias("file_changed")), F.col("p.file_path") == F.col("path"), "left")
    return own.select(
        F.col("canonical_id").alias("id"), "p.name", "p.label", F.col("p.file_path").alias("file"), X.basename(F.col("p.file_path")).alias("file_name"), X.dirname(F.col("p.file_path")).alias("folder"),
        F.coalesce("p.start_line", F.lit(0)).alias("line"), F.col("base.file_path").alias("base_file"), F.col("base.start_line").alias("base_line"), F.col("head.file_path").alias("head_file"), F.col("head.start_line").alias("head_line"),
        "status", F.when(F.col("head").isNotNull(), "head").otherwise("base").alias("layer"), group_of(F.col("p.label")).alias("group"), "degree", "in_degree", "out_degree", F.coalesce("p.return_type", F.lit("")).alias("return_type"),
        F.coalesce("p.is_async", F.lit(False)).alias("is_async"), F.coalesce("p.container_name", F.lit("")).alias("container_name"), "p.qualified_name", "body_changed", F.coalesce("file_changed", F.lit(False)).alias("file_changed"), "match_kind",
    )


def file_records(paths: DataFrame, files: DataFrame, base: Graph, head: Graph) -> DataFrame:
    """What a viewer shows of the selected files; `base_file` is the path even of an added one."""
    own = files.join(paths, "path", "left_semi").withColumns({"layer": F.when(F.col("status") == "removed", "base").otherwise("head"), "id": F.concat(F.lit("file::"), "path")})
    d = degrees(head.edges).withColumn("layer", F.lit("head")).unionByName(degrees(base.edges).withColumn("layer", F.lit("base")))
    own = own.join(d, ["id", "layer"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    null_int, name = F.lit(None).cast("int"), X.basename(F.col("path"))
    return own.select(
        "id", name.alias("name"), F.lit("File").alias("label"), F.col("path").alias("file"), name.alias("file_name"), X.dirname(F.col("path")).alias("folder"), F.lit(0).alias("line"), F.col("path").alias("base_file"), null_int.alias("base_line"),
        F.when(F.col("status") != "removed", F.col("path")).alias("head_file"), null_int.alias("head_line"), "status", "layer", F.lit(GROUPS["File"]).alias("group"), zero("degree"), zero("in_degree"), zero("out_degree"), F.lit("").alias("return_type"),
        F.lit(False).alias("is_async"), F.lit("").alias("container_name"), F.col("path").alias("qualified_name"), (F.col("status") == "modified").alias("body_changed"), (F.col("status") != "unchanged").alias("file_changed"), F.lit(None).cast("string").alias("match_kind"),
    )


def summary(files: DataFrame, records: DataFrame, links: DataFrame, refs: tuple[str, str] = ("base", "head")) -> DataFrame:
    """The two revisions' names and eleven counts in one row."""
    count = lambda rows, names, prefix: rows.agg(*[F.count_if(F.col("status") == n).alias(f"{prefix}_{n}") for n in names])
    a = count(files, ("added", "removed", "modified", "unchanged"), "files")
    b = count(records, ("added", "removed", "modified", "moved", "unchanged"), "symbols")
    counts = a.crossJoin(b).crossJoin(count(links, ("added", "removed"), "edges"))  # one row each
    return counts.select(F.lit(refs[0]).alias("base_ref"), F.lit(refs[1]).alias("head_ref"), *counts.columns)


def diff(base: Graph, head: Graph, base_hashes: DataFrame, head_hashes: DataFrame, limit: int = MAX_SYMBOLS, refs: tuple[str, str] = ("base", "head")) -> dict[str, DataFrame]:
    """files, records, nodes, links, summary. Hashes: file_path, hash."""
    own = lambda g, hashes: g.nodes.filter("label = 'File'").select("file_path").join(hashes, "file_path", "left")
    files = diff_files(own(base, base_hashes), own(head, head_hashes))
    records = staged(diff_symbols(base, head), "records")
    selected = staged(select_symbols(records, limit), "selected")
    paths = staged(select_files(selected, records, files), "paths")
    nodes = symbol_records(records, selected, files).unionByName(file_records(paths, files, base, head))
    # the nodes' ids, without the degrees that a viewer shows
    ids = selected.select(F.col("canonical_id").alias("id")).unionByName(files.join(paths, "path", "left_semi").select(F.concat(F.lit("file::"), "path").alias("id")))
    links = staged(diff_edges(base, head, canonical_ids(records, paths, "base"), canonical_ids(records, paths, "head"), ids), "links")
    return {"files": files, "records": records, "nodes": nodes, "links": links, "summary": summary(files, records, links, refs)}

