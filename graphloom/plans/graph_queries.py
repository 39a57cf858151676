"""Queries of the graph operators (M*, G*, K*, S*) with their oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import export, graph, traverse
from ..operators.graph import Graph
from ..schema import NODES, conform, edge_id, is_callable, is_symbol, is_type_def, language_of_extension, location_key, make_edges, with_diff_metadata
from ..sources import scan
from ..sources.changes import changeset
from ..staging import staged
from .bench_views import Views
from .registry import query

SYMBOL = "label NOT IN ('Folder', 'File', 'Project', 'Package', 'Module', 'Community', 'Process', 'Section', 'Import')"
LINK = "SELECT id, source_id, target_id, rel_type, confidence, reason FROM edges"


def g(v: Views) -> Graph:
    return Graph(v.nodes, v.edges)


def stored(v: Views) -> Graph:
    """The graph with its edges as a written table, as rounds of joins have it."""
    return Graph(v.nodes, staged(v.edges, "edges"))


# --- lookups ---------------------------------------------------------------------------------


@query("SELECT id, label, name, file_path FROM nodes WHERE id IN ('customer::7', 'part::5', 'order::11')")
def g1_node_lookup(v: Views) -> DataFrame:
    return graph.by_id(v.nodes, ["customer::7", "part::5", "order::11"]).select("id", "label", "name", "file_path")


@query("SELECT id, rel_type, confidence FROM edges WHERE id = 'customer::7-[IMPORTS]->file::src/n' || (SELECT c_nationkey FROM customer WHERE c_custkey = 7) || '.ts'")
def g1_edge_lookup(v: Views) -> DataFrame:
    nation = v.customer.filter("c_custkey = 7").select(F.format_string("customer::7-[IMPORTS]->file::src/n%d.ts", "c_nationkey").alias("id"))
    return v.edges.join(F.broadcast(nation), "id", "left_semi").select("id", "rel_type", "confidence")  # one row


@query(f"{LINK} WHERE source_id = 'order::11'")
def g2_outgoing(v: Views) -> DataFrame:
    return graph.outgoing(v.edges, "order::11")


@query(f"{LINK} WHERE source_id = 'customer::7' AND rel_type = 'CALLS'")
def g2_outgoing_calls(v: Views) -> DataFrame:
    return graph.outgoing(v.edges, "customer::7", "CALLS")


@query(f"{LINK} WHERE target_id = 'part::5'")
def g3_incoming(v: Views) -> DataFrame:
    return graph.incoming(v.edges, "part::5")


@query(f"{LINK} WHERE target_id = 'supplier::3' AND rel_type = 'IMPLEMENTS'")
def g3_incoming_implements(v: Views) -> DataFrame:
    return graph.incoming(v.edges, "supplier::3", "IMPLEMENTS")


@query("SELECT id, name FROM nodes WHERE label = 'Class'")
def g4_by_label(v: Views) -> DataFrame:
    return graph.by_label(v.nodes, "Class").select("id", "name")


@query("SELECT id, label, file_path FROM nodes WHERE name = 'red widget'")
def g5_by_name(v: Views) -> DataFrame:
    return graph.by_name(v.nodes, "red widget").select("id", "label", "file_path")


@query("SELECT id, label, name FROM nodes WHERE file_path = 'src/n3.ts'")
def g6_in_file(v: Views) -> DataFrame:
    return graph.in_file(v.nodes, "src/n3.ts").select("id", "label", "name")


# --- traversal -------------------------------------------------------------------------------

_REACH = """WITH arcs AS ({arcs}), reach AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT arcs.b, depth + 1 FROM reach JOIN arcs ON reach.id = arcs.a WHERE depth < {depth})
SELECT '{start}' AS start_id, id AS node_id, CAST(min(depth) AS INT) AS depth FROM reach WHERE id <> '{start}' GROUP BY id"""
_OUT, _IN = "SELECT source_id AS a, target_id AS b FROM edges", "SELECT target_id AS a, source_id AS b FROM edges"


def start(v: Views, node_id: str) -> DataFrame:
    return v.spark.createDataFrame([(node_id,)], "id string")


@query(_REACH.format(arcs=_OUT, start="customer::7", depth=3))
def g7_bfs_out(v: Views) -> DataFrame:
    return traverse.bfs(stored(v).edges, start(v, "customer::7"), "out", 3).drop("path")


@query(_REACH.format(arcs=_IN, start="part::5", depth=3))
def g7_bfs_in(v: Views) -> DataFrame:
    return traverse.bfs(stored(v).edges, start(v, "part::5"), "in", 3).drop("path")


@query(_REACH.format(arcs=f"{_OUT} UNION {_IN}", start="part::5", depth=2))
def g7_bfs_both(v: Views) -> DataFrame:
    return traverse.bfs(stored(v).edges, start(v, "part::5"), "both", 2).drop("path")


@query(_REACH.format(arcs=_OUT, start="part::5", depth=2))
def g7_bfs_both_along_edges(v: Views) -> DataFrame:
    return traverse.bfs(stored(v).edges, start(v, "part::5"), "both", 2, strict_reference=True).drop("path")


@query("""WITH p AS (SELECT 'view_3' AS id, 0 AS depth, ['view_3'] AS path UNION ALL SELECT target_id, depth + 1, list_append(path, target_id) FROM p JOIN event_edges e ON e.source_id = p.id WHERE depth < 4 AND NOT list_contains(path, target_id))
SELECT 'view_3' AS start_id, id AS node_id, CAST(min(depth) AS INT) AS depth, array_to_string(arg_min(path, (depth, path)), '>') AS path FROM p WHERE depth > 0 GROUP BY id""")
def g7_bfs_paths(v: Views) -> DataFrame:
    return traverse.bfs(v.event_edges, start(v, "view_3"), "out", 4).withColumn("path", F.array_join("path", ">"))


_IMPACT = """WITH arcs AS (SELECT {ends} FROM edges WHERE rel_type IN ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'USES')), starts AS (SELECT id FROM nodes WHERE name = '{name}' AND {symbol}),
reach AS (SELECT id AS start_id, id, 0 AS depth FROM starts UNION SELECT start_id, arcs.b, depth + 1 FROM reach JOIN arcs ON reach.id = arcs.a WHERE depth < {depth}),
hits AS (SELECT start_id, id AS node_id, CAST(min(depth) AS INT) AS depth FROM reach WHERE id <> start_id GROUP BY start_id, id)"""


@query(_IMPACT.format(ends="target_id AS a, source_id AS b", name="red widget", symbol=SYMBOL, depth=2) + " SELECT start_id, node_id, depth, label, name, file_path, start_line AS line FROM hits LEFT JOIN nodes ON node_id = id")
def g13_impact_up(v: Views) -> DataFrame:
    return traverse.impact(stored(v), "red widget", "up", 2)


@query(_IMPACT.format(ends="source_id AS a, target_id AS b", name="handle_low", symbol=SYMBOL + " AND id LIKE 'order::%'", depth=2) + " SELECT start_id, depth, count(*) AS n FROM hits GROUP BY start_id, depth")
def g13_impact_down_counts(v: Views) -> DataFrame:
    return traverse.impact(stored(v), "handle_low", "down", 2).groupBy("start_id", "depth").agg(F.count("*").alias("n"))


@query(_IMPACT.format(ends="target_id AS a, source_id AS b", name="red widget", symbol=SYMBOL, depth=2) + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY start_id, depth ORDER BY node_id) AS position, count(*) OVER (PARTITION BY start_id, depth) AS total FROM hits)
SELECT start_id, node_id, depth, CAST(position AS INT) AS position, total FROM ranked JOIN nodes ON node_id = id WHERE position <= 20 AND {SYMBOL}""")
def g13_impact_shown(v: Views) -> DataFrame:
    return traverse.impact_shown(traverse.impact(stored(v), "red widget", "up", 2)).select("start_id", "node_id", "depth", "position", "total")


# --- degrees and counts ----------------------------------------------------------------------

_DEGREES = "d AS (SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) x GROUP BY id)"


@query(f"WITH {_DEGREES} SELECT id, out_degree, in_degree, out_degree + in_degree AS degree FROM d")
def g8_degrees(v: Views) -> DataFrame:
    return graph.degrees(v.edges)


@query("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(DISTINCT file_path) FROM nodes) AS file_count, (SELECT count(*) FROM edges) AS edge_count")
def g9_totals(v: Views) -> DataFrame:
    return graph.totals(g(v))


@query("SELECT id, rel_type, confidence FROM edges")
def g10_all_edges(v: Views) -> DataFrame:
    return v.edges.select("id", "rel_type", "confidence")


@query(f"SELECT id, name FROM nodes WHERE {SYMBOL} AND contains(lower(name), 'wid') ORDER BY id LIMIT 40")
def g11_substring(v: Views) -> DataFrame:
    return graph.substring_search(v.nodes, "WiD", 40).select("id", "name")


@query("""WITH own AS (SELECT id AS node_id FROM nodes WHERE name = 'building_7'),
e AS (SELECT node_id, 'out' AS direction, id, rel_type, target_id AS neighbour_id, confidence FROM edges JOIN own ON source_id = node_id UNION ALL SELECT node_id, 'in', id, rel_type, source_id, confidence FROM edges JOIN own ON target_id = node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY id) AS position FROM e)
SELECT node_id, direction, CAST(position AS INT) AS position, rel_type, neighbour_id, n.name AS neighbour_name, confidence FROM r LEFT JOIN nodes n ON n.id = neighbour_id WHERE position <= 15""")
def g12_context(v: Views) -> DataFrame:
    return graph.context(g(v), "building_7")


@query("SELECT id, name, file_path FROM nodes WHERE label = 'Function' ORDER BY id LIMIT 30")
def g14_symbols_label(v: Views) -> DataFrame:
    return graph.symbols(v.nodes, "fn", 30).select("id", "name", "file_path")


@query(f"SELECT id, name, file_path FROM nodes WHERE {SYMBOL} ORDER BY id LIMIT 20")
def g14_symbols_unknown_label(v: Views) -> DataFrame:
    return graph.symbols(v.nodes, "no such label").select("id", "name", "file_path")


@query("""SELECT count(*) AS nodes, count(*) FILTER (label = 'Function') AS functions, count(*) FILTER (label = 'Class') AS classs, count(*) FILTER (label = 'Method') AS methods, count(*) FILTER (label = 'Interface') AS interfaces,
count(*) FILTER (label = 'File') AS files, (SELECT count(*) FROM edges) AS edges FROM nodes""")
def g15_status(v: Views) -> DataFrame:
    return graph.status(g(v))


@query("SELECT label, count(*) AS count FROM nodes GROUP BY label")
def g16_count_labels(v: Views) -> DataFrame:
    return graph.counts_by(v.nodes, "label")


@query("SELECT rel_type, count(*) AS count FROM edges GROUP BY rel_type")
def g16_count_relations(v: Views) -> DataFrame:
    return graph.counts_by(v.edges, "rel_type")


@query("""SELECT e.id, source_id AS source, s.name AS source_name, target_id AS target, t.name AS target_name, rel_type AS type, confidence, reason FROM edges e LEFT JOIN nodes s ON source_id = s.id LEFT JOIN nodes t ON target_id = t.id""")
def g17_enriched_edges(v: Views) -> DataFrame:
    return graph.enriched(v.edges, v.nodes)


@query("SELECT id, name, label, file_path AS file, start_line AS line, end_line, is_exported AS exported, language, return_type, is_async AS async FROM nodes")
def g18_node_view(v: Views) -> DataFrame:
    return graph.node_view(v.nodes)


@query("SELECT 'node' AS kind, label AS what, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type")
def g19_whole_graph_counts(v: Views) -> DataFrame:
    nodes, edges = graph.whole(g(v))
    count = lambda rows, kind, c: rows.groupBy(F.col(c).alias("what")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "what", "n")
    return count(nodes, "node", "label").unionByName(count(edges, "edge", "type"))


@query("""WITH keep AS (SELECT id FROM nodes WHERE file_path IN ('src/n1.ts', 'src/n2.ts') OR label = 'Folder') SELECT id, rel_type FROM edges WHERE source_id IN (SELECT id FROM keep) AND target_id IN (SELECT id FROM keep)""")
def g22_induced(v: Views) -> DataFrame:
    keep = v.nodes.filter(F.col("file_path").isin("src/n1.ts", "src/n2.ts") | (F.col("label") == "Folder")).select("id")
    return graph.induced(v.edges, keep).select("id", "rel_type")


# --- upserts and structure -------------------------------------------------------------------


@query("""SELECT n.id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE n.name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Struct' ELSE n.label END AS label FROM nodes n LEFT JOIN customer ON n.id = 'customer::' || c_custkey""")
def m1_upsert_nodes(v: Views) -> DataFrame:
    old = v.nodes.select("id", "name", "label")
    new = v.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("customer::"), "c_custkey").alias("id"), F.lit("renamed").alias("name"), F.lit("Struct").alias("label"))
    return graph.upsert(old, new)


@query("""SELECT id, source_id, CASE WHEN source_id LIKE 'part::%' AND rel_type = 'IMPLEMENTS' THEN 'supplier::0' ELSE target_id END AS target_id, CASE WHEN source_id LIKE 'part::%' AND rel_type = 'IMPLEMENTS' THEN CAST(0.25 AS DOUBLE) ELSE confidence END AS confidence FROM edges""")
def m2_upsert_edges(v: Views) -> DataFrame:
    old = v.edges.select("id", "source_id", "target_id", "confidence")
    new = v.edges.filter("rel_type = 'IMPLEMENTS'").select("id", "source_id", F.lit("supplier::0").alias("target_id"), F.lit(0.25).alias("confidence"))
    both = new.withColumn("confidence", F.lit(0.75)).withColumn("n", F.lit(1)).unionByName(new.withColumn("n", F.lit(2)))
    return graph.upsert(old, both, F.col("n"))


@query("""WITH gone AS (SELECT id FROM nodes WHERE file_path IN ('src/n1.ts', 'lib/b7.ts')) SELECT 'node' AS kind, id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', id FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""")
def m3_remove_files(v: Views) -> DataFrame:
    left = graph.remove_files(g(v), v.spark.createDataFrame([("src/n1.ts",), ("lib/b7.ts",)], "file_path string"))
    return left.nodes.select(F.lit("node").alias("kind"), "id").unionByName(left.edges.select(F.lit("edge").alias("kind"), "id"))


_FILES = "f AS (SELECT DISTINCT file_path AS p, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE label <> 'Folder')"


def files_of(v: Views) -> DataFrame:
    return v.nodes.filter("label <> 'Folder'").select(F.col("file_path").alias("relative_path"), F.lit("typescript").alias("language")).distinct()


@query(f"""WITH {_FILES} SELECT 'project::root' AS id, 'Project' AS label, 'root' AS name, '' AS file_path UNION ALL SELECT 'file::' || p, 'File', regexp_extract(p, '([^/]*)$', 1), p FROM f
UNION ALL SELECT DISTINCT 'folder::' || dir, 'Folder', regexp_extract(dir, '([^/]*)$', 1), dir FROM f WHERE dir <> ''""")
def m4_structure_nodes(v: Views) -> DataFrame:
    return graph.structure(files_of(v)).nodes.select("id", "label", "name", "file_path")


@query(f"WITH {_FILES} SELECT 'folder::' || dir || '-[CONTAINS]->file::' || min(p) AS id, 'folder::' || dir AS source_id, 'file::' || min(p) AS target_id FROM f WHERE dir <> '' GROUP BY dir")
def m4_structure_edges(v: Views) -> DataFrame:
    return graph.structure(files_of(v)).edges.select("id", "source_id", "target_id")


@query(f"SELECT 'file::' || file_path || '-[CONTAINS]->' || id AS id, 'file::' || file_path AS source_id, id AS target_id, 'CONTAINS' AS rel_type, CAST(1.0 AS DOUBLE) AS confidence FROM nodes WHERE {SYMBOL}")
def m5_file_contains(v: Views) -> DataFrame:
    return graph.file_contains(v.nodes).select("id", "source_id", "target_id", "rel_type", "confidence")


@query("""SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'added' WHEN a.file_path IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS status FROM head_hashes a FULL JOIN base_hashes b ON a.file_path = b.file_path""")
def m8_changeset(v: Views) -> DataFrame:
    return changeset(v.head_hashes, v.base_hashes).select("file_path", "status")


@query("SELECT count(*) = 0 AS unchanged FROM (SELECT file_path, hash FROM base_hashes EXCEPT SELECT file_path, hash FROM base_hashes) x")
def m9_no_change(v: Views) -> DataFrame:
    same = changeset(v.base_hashes, v.base_hashes)
    return same.agg((F.count_if(F.col("status") != "unchanged") == 0).alias("unchanged"))


@query("SELECT file_path, hash FROM head_hashes UNION ALL SELECT file_path, hash FROM base_hashes WHERE file_path NOT IN (SELECT file_path FROM head_hashes)")
def m11_file_hashes(v: Views) -> DataFrame:
    old, new = (h.select(F.col("file_path").alias("id"), F.col("hash").cast("long").alias("hash")) for h in (v.base_hashes, v.head_hashes))
    return graph.upsert(old, new).select(F.col("id").alias("file_path"), "hash")


@query("SELECT 'customer::' || c_custkey || '-[USES]->nation::' || c_nationkey AS id, 'customer::' || c_custkey AS source_id, 'nation::' || c_nationkey AS target_id, 'USES' AS rel_type, CAST(0.7 AS DOUBLE) AS confidence, 'home' AS reason, CAST(NULL AS INT) AS step FROM customer")
def m12_edge_rows(v: Views) -> DataFrame:
    return make_edges(v.customer, F.concat(F.lit("customer::"), "c_custkey"), F.concat(F.lit("nation::"), "c_nationkey"), "USES", 0.7, "home")


@query("SELECT DISTINCT label, label IN ('Function', 'Method', 'Constructor') AS callable, label IN ('Class', 'Interface', 'Struct', 'Enum', 'Trait', 'TypeAlias', 'Record', 'Union', 'Delegate', 'Template') AS type_def, " + SYMBOL + " AS symbol FROM nodes")
def t1_label_predicates(v: Views) -> DataFrame:
    label = F.col("label")
    return v.nodes.select("label").distinct().select("label", is_callable(label).alias("callable"), is_type_def(label).alias("type_def"), is_symbol(label).alias("symbol"))


@query("""WITH q AS (SELECT id, label, file_path, language, parameter_count, CASE WHEN container_name IS NULL THEN name ELSE container_name || '.' || name END AS qualified_name FROM nodes)
SELECT id, qualified_name, coalesce(language, 'unknown') || '::' || label || '::' || qualified_name || '::' || coalesce(parameter_count, 0) AS symbol_key, file_path || '::' || label || '::' || qualified_name || '::' || coalesce(parameter_count, 0) AS location_key FROM q""")
def p19_diff_metadata(v: Views) -> DataFrame:
    return with_diff_metadata(conform(v.nodes, NODES)).select("id", "qualified_name", "symbol_key", location_key().alias("location_key"))


# --- scans -----------------------------------------------------------------------------------


@query("""WITH x AS (SELECT path, regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS ext FROM paths) SELECT path, CASE ext WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' END AS language FROM x""")
def s5_language(v: Views) -> DataFrame:
    return v.paths.select("path", language_of_extension(X.extension(F.col("path"))).alias("language"))


@query("""SELECT path FROM paths WHERE ends_with(path, '.ts') AND NOT ends_with(path, '/.ts') AND length(path) <= 40 ORDER BY path""")
def s2_admitted_files(v: Views) -> DataFrame:
    rows = v.paths.select(F.col("path").alias("relative_path"), F.length("path").cast("long").alias("size"))
    return scan.admitted(rows, languages=("typescript",), max_file_size=40).select(F.col("relative_path").alias("path"))


@query("""SELECT path, regexp_matches(path, '/en/.*1') AND NOT regexp_matches(path, '0[.]ts$') OR regexp_matches(path, '[.]js$') AS ignored FROM paths""")
def s6_ignored_paths(v: Views) -> DataFrame:
    rules = [scan.parse_rule(line, "") for line in ("*/en/*1*", "!*/*0.ts", "*.js", "# no rule", "dir/")]
    return v.paths.select("path", scan.ignored(F.col("path"), [r for r in rules if r]).alias("ignored"))


@query("""SELECT path, regexp_matches(path, '^blog[.].*$') AS a, regexp_matches(path, '^.*/fr/.*[.]ts$') AS b FROM paths""")
def s8_globs(v: Views) -> DataFrame:
    return v.paths.select("path", F.col("path").rlike(X.glob_regex("blog.*")).alias("a"), F.col("path").rlike(X.glob_regex("*/fr/*.ts")).alias("b"))


# --- exports ---------------------------------------------------------------------------------

_TOP = f"WITH {_DEGREES}, top AS (SELECT n.*, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree + in_degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.id = n.id WHERE {SYMBOL} ORDER BY degree DESC, n.id LIMIT 50)"


@query(f"WITH keep AS (SELECT id FROM nodes WHERE {SYMBOL} OR label = 'File' ORDER BY id LIMIT 200) SELECT 'node' AS kind, id FROM keep UNION ALL SELECT 'edge', id FROM edges WHERE source_id IN (SELECT id FROM keep) AND target_id IN (SELECT id FROM keep)")
def k2_export_json(v: Views) -> DataFrame:
    part = export.json_part(g(v), 200)
    return part.nodes.select(F.lit("node").alias("kind"), "id").unionByName(part.edges.select(F.lit("edge").alias("kind"), "id"))


@query(f"""WITH keep AS (SELECT id, name, label FROM nodes WHERE {SYMBOL} ORDER BY id LIMIT 100)
SELECT '  ' || regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') || ' [label="' || name || '\\n(' || label || ')", fillcolor="' || CASE label WHEN 'Class' THEN '#4FC3F7' WHEN 'Interface' THEN '#81C784' WHEN 'Function' THEN '#FFB74D' WHEN 'Method' THEN '#FF8A65' WHEN 'Enum' THEN '#CE93D8' ELSE '#E0E0E0' END || '"];' AS line FROM keep
UNION ALL SELECT '  ' || regexp_replace(source_id, '[^A-Za-z0-9_]', '_', 'g') || ' -> ' || regexp_replace(target_id, '[^A-Za-z0-9_]', '_', 'g') || ' [color=' || CASE rel_type WHEN 'CALLS' THEN 'red' WHEN 'IMPORTS' THEN 'blue' WHEN 'EXTENDS' THEN 'green' WHEN 'IMPLEMENTS' THEN 'green' WHEN 'CONTAINS' THEN 'gray' ELSE 'black' END || ', label="' || rel_type || '"];'
FROM edges WHERE source_id IN (SELECT id FROM keep) AND target_id IN (SELECT id FROM keep)""")
def k3_export_dot(v: Views) -> DataFrame:
    return export.dot_lines(g(v), 100).select("line")


@query(_TOP + """ SELECT id, name, label, file_path AS file, regexp_extract(file_path, '([^/]*)$', 1) AS file_name, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, coalesce(start_line, 0) AS line, is_exported AS exported,
CASE label WHEN 'Class' THEN 1 WHEN 'Interface' THEN 2 WHEN 'Function' THEN 3 WHEN 'Method' THEN 4 ELSE 8 END AS "group", degree, in_degree, out_degree, coalesce(return_type, '') AS return_type, is_async FROM top""")
def k4_html_nodes(v: Views) -> DataFrame:
    return export.html_part(g(v), 50).nodes


@query(_TOP.replace("LIMIT 50", "LIMIT 3000") + " SELECT source_id AS source, target_id AS target, rel_type AS type, confidence FROM edges WHERE rel_type <> 'CONTAINS' AND source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)")
def k4_html_links(v: Views) -> DataFrame:
    return export.html_part(g(v), 3000).edges


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'ring') AND label IN ('Function', 'Method') ORDER BY id LIMIT 12")
def k10_viewer_search(v: Views) -> DataFrame:
    return export.viewer_search(v.nodes, "RING", ("Function", "Method")).select("id", "name")


@query(_TOP.replace("LIMIT 50", "LIMIT 3000") + """, li AS (SELECT source_id AS source, target_id AS target, rel_type AS type FROM edges WHERE rel_type <> 'CONTAINS' AND source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)), hub AS (SELECT source AS id FROM li GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
o AS (SELECT 'out' AS direction, target AS other, type FROM li WHERE source = (SELECT id FROM hub) UNION ALL SELECT 'in', source, type FROM li WHERE target = (SELECT id FROM hub))
SELECT direction, other, type FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY type, other) AS k FROM o) x WHERE k <= 30""")
def k10_viewer_links(v: Views) -> DataFrame:
    """The first 30 links of each side of the node with the most links going out; none where the viewer's nodes have no links."""
    links = staged(export.html_part(g(v), 3000).edges, "links")
    hub = links.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    return export.viewer_links(links, hub["source"] if hub else None)


@query("SELECT id, name FROM head_nodes WHERE label = 'Interface' AND contains(name, 'pplier_1') ORDER BY id LIMIT 12")
def k10_viewer_status(v: Views) -> DataFrame:
    """A diff's nodes by name and status: suppliers are the added ones."""
    made = v.head_nodes.select("id", "name", "label", F.when(F.col("id").startswith("added::"), "added").otherwise("unchanged").alias("status"))
    return export.viewer_search(made, "PPLIER_1", None, 12, ("added",)).select("id", "name")


@query("SELECT source_id || '-[' || rel_type || ']->' || target_id AS id FROM edges")
def t2_edge_ids(v: Views) -> DataFrame:
    return v.edges.select(edge_id(F.col("source_id"), F.col("rel_type"), F.col("target_id")).alias("id"))
