"""Queries of the analytics and diff operators (A*, D*, R24-like iterations) with their oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics, diff
from ..operators.graph import Graph
from ..schema import NODES, conform, make_edges
from .bench_views import Views
from .registry import query

SYMBOL = "label NOT IN ('Folder', 'File')"


def business(v: Views) -> Graph:
    return Graph(v.nodes, v.edges)


def events(v: Views) -> Graph:
    return Graph(v.event_nodes, v.event_edges)


# --- communities -----------------------------------------------------------------------------

_CLUSTER = f"ce AS (SELECT source_id AS a, target_id AS b FROM edges WHERE rel_type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS') AND confidence >= 0.5 AND source_id <> target_id AND source_id IN (SELECT id FROM nodes WHERE {SYMBOL}) AND target_id IN (SELECT id FROM nodes WHERE {SYMBOL}))"
_NEAR = f"{_CLUSTER}, near AS (SELECT a AS src, b AS dest, count(*) AS weight FROM (SELECT a, b FROM ce UNION ALL SELECT b, a FROM ce) x GROUP BY a, b)"
# a fixed division into groups, to hold the operators that follow a division against SQL
_MEMBERS = f"members AS (SELECT id, file_path AS community FROM nodes WHERE {SYMBOL} AND NOT id LIKE 'order::%')"


def members(v: Views) -> DataFrame:
    return v.nodes.filter(f"{SYMBOL} and not id like 'order::%'").select("id", F.col("file_path").alias("community"))


@query(f"WITH {_CLUSTER} SELECT a, b FROM ce")
def a1_clustering_edges(v: Views) -> DataFrame:
    return analytics.clustering_edges(business(v))


@query(f'WITH {_NEAR} SELECT src AS "at", dest AS "to", weight FROM near')
def a1_adjacency(v: Views) -> DataFrame:
    return analytics.adjacency(analytics.clustering_edges(business(v)))


_SWEEP = """WITH ev AS (SELECT source_id AS a, target_id AS b FROM event_edges WHERE confidence >= 0.5 AND source_id <> target_id), near AS (SELECT a AS src, b AS dest, count(*) AS weight FROM (SELECT a, b FROM ev UNION ALL SELECT b, a FROM ev) x GROUP BY a, b),
m AS (SELECT src AS id, sum(weight) AS k, CAST(substring(src, length(src), 1) || length(src) AS BIGINT) AS community FROM near GROUP BY src), tot AS (SELECT CAST(sum(weight) AS DOUBLE) AS m2 FROM near), s AS (SELECT community, sum(k) AS sigma FROM m GROUP BY community),
l AS (SELECT src AS id, m.community AS target, sum(weight) AS links FROM near JOIN m ON m.id = dest GROUP BY src, m.community),
o AS (SELECT m.id, m.community, m.k, s.sigma - m.k AS sigma_own, coalesce(l.links, 0) AS links_own FROM m JOIN s USING (community) LEFT JOIN l ON l.id = m.id AND l.target = m.community),
g AS (SELECT o.id, l.target, round((l.links - o.links_own) / m2 - o.k * (s.sigma - o.sigma_own) / (m2 * m2), 15) AS gain FROM o JOIN l ON l.id = o.id JOIN s ON s.community = l.target, tot WHERE l.target < o.community),
best AS (SELECT id, arg_max(target, (gain, -target)) AS moved FROM g WHERE gain > 0 GROUP BY id)
SELECT m.id, coalesce(moved, community) AS community FROM m LEFT JOIN best USING (id)"""


@query(_SWEEP)
def a2_louvain_sweep(v: Views) -> DataFrame:
    near = analytics.adjacency(analytics.clustering_edges(events(v)))
    degree = near.groupBy(F.col("at").alias("id")).agg(F.sum("weight").alias("k"))
    first = degree.select("id", F.concat(F.substring("id", -1, 1), F.length("id")).cast("long").alias("community"))
    m2 = float(near.agg(F.sum("weight")).first()[0] or 1)
    return analytics.louvain_sweep(near, degree, first, m2, 1.0, upward=False)


def _sweep(k: int) -> str:
    """The k-th sweep, as the one above: to smaller numbers first, then to larger ones, in turn."""
    c, side = f"c{k - 1}", "<" if k % 2 else ">"
    return f"""s{k} AS MATERIALIZED (SELECT community, sum(k) AS sigma FROM {c} JOIN deg USING (id) GROUP BY community), l{k} AS MATERIALIZED (SELECT src AS id, m.community AS target, sum(weight) AS links FROM near JOIN {c} m ON m.id = dest GROUP BY src, m.community),
o{k} AS MATERIALIZED (SELECT m.id, m.community, deg.k, s.sigma - deg.k AS sigma_own, coalesce(l.links, 0) AS links_own FROM {c} m JOIN deg USING (id) JOIN s{k} s USING (community) LEFT JOIN l{k} l ON l.id = m.id AND l.target = m.community),
g{k} AS (SELECT o.id, l.target, round((l.links - o.links_own) / m2 - o.k * (s.sigma - o.sigma_own) / (m2 * m2), 15) AS gain FROM o{k} o JOIN l{k} l ON l.id = o.id JOIN s{k} s ON s.community = l.target, tot WHERE l.target {side} o.community),
c{k} AS MATERIALIZED (SELECT m.id, coalesce(moved, m.community) AS community FROM {c} m LEFT JOIN (SELECT id, arg_max(target, (gain, -target)) AS moved FROM g{k} WHERE gain > 0 GROUP BY id) b USING (id))"""


SWEEPS = 20
# numbers by the order of the ids; sweeps that move nothing change nothing, so all of them are written out
_LOUVAIN = """ev AS (SELECT source_id AS a, target_id AS b FROM event_edges WHERE confidence >= 0.5 AND source_id <> target_id), near AS MATERIALIZED (SELECT a AS src, b AS dest, count(*) AS weight FROM (SELECT a, b FROM ev UNION ALL SELECT b, a FROM ev) x GROUP BY a, b),
deg AS MATERIALIZED (SELECT src AS id, sum(weight) AS k FROM near GROUP BY src), tot AS (SELECT CAST(sum(weight) AS DOUBLE) AS m2 FROM near), c0 AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS community FROM deg), """ + ", ".join(_sweep(k) for k in range(1, SWEEPS + 1)) + f", com AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY community) AS community FROM c{SWEEPS})"


@query(f"WITH {_LOUVAIN} SELECT id, community FROM com")
def a2_louvain(v: Views) -> DataFrame:
    """Each node with its community, named by its first member."""
    found = analytics.louvain(events(v), sweeps=SWEEPS)[0]
    return found.join(found.groupBy("community").agg(F.min("id").alias("first")), "community").select("id", F.col("first").alias("community"))


@query(f"WITH {_MEMBERS} SELECT community, count(*) AS size, min(id) AS first, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS position FROM members GROUP BY community HAVING count(*) >= 2")
def a3_ranked_communities(v: Views) -> DataFrame:
    return analytics.ranked_communities(members(v))


_GENERIC = ", ".join(f"'{f}'" for f in analytics.GENERIC_FOLDERS)


@query(f"""WITH o AS (SELECT id, 'g' || (length(id) % 4) AS community, string_split(file_path, '/') AS p FROM nodes WHERE {SYMBOL}), c AS (SELECT community, p[-2] AS folder, count(*) AS n FROM o WHERE len(p) >= 2 AND lower(p[-2]) NOT IN ({_GENERIC}) GROUP BY ALL),
b AS (SELECT community, max(n) AS n FROM c GROUP BY community) SELECT community, min(folder) AS folder FROM c JOIN b USING (community, n) GROUP BY community""")
def a4_community_labels(v: Views) -> DataFrame:
    own = v.nodes.filter(SYMBOL).select("id", F.concat(F.lit("g"), F.length("id") % 4).alias("community"))
    return analytics.community_labels(own, v.nodes)


# two members and more, the largest first; a name by the folder that most have; of the first 50 members the links that stay inside
@query(f"""WITH {_LOUVAIN}, rk AS (SELECT community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS position FROM com GROUP BY community HAVING count(*) >= 2),
fo AS (SELECT community, string_split(file_path, '/')[-2] AS folder, count(*) AS n FROM com JOIN event_nodes USING (id) GROUP BY ALL), be AS (SELECT community, min(folder) AS folder FROM fo JOIN (SELECT community, max(n) AS n FROM fo GROUP BY community) x USING (community, n) GROUP BY community),
fi AS (SELECT id, community FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM com) x WHERE i <= 50), sh AS (SELECT fi.community, sum(CASE WHEN com.community = fi.community THEN weight ELSE 0 END) / sum(weight) AS share FROM fi JOIN near ON src = fi.id LEFT JOIN com ON com.id = dest GROUP BY fi.community)
SELECT 'comm_' || position AS id, upper(folder[1]) || folder[2:] AS name, round(share, 6) AS cohesion, CAST(size AS INT) AS symbol_count, size AS members FROM rk JOIN be USING (community) JOIN sh USING (community)""")
def a3_communities(v: Views) -> DataFrame:
    nodes, edges, _ = analytics.communities(events(v))
    sizes = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("members"))
    return nodes.select("id", "name", F.round("cohesion", 6).alias("cohesion"), "symbol_count").join(sizes, "id")


@query(f"""WITH {_NEAR}, {_MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM members),
l AS (SELECT r.community, m.community AS other, weight FROM r JOIN near ON near.src = r.id LEFT JOIN members m ON m.id = dest WHERE k <= 50), s AS (SELECT community, sum(CASE WHEN other = community THEN weight ELSE 0 END) / sum(weight) AS share FROM l GROUP BY community)
SELECT m.community, round(coalesce(share, 1.0), 6) AS cohesion FROM (SELECT DISTINCT community FROM members) m LEFT JOIN s USING (community)""")
def a5_cohesion(v: Views) -> DataFrame:
    near = analytics.adjacency(analytics.clustering_edges(business(v)))
    return analytics.cohesion(members(v), near).withColumn("cohesion", F.round("cohesion", 6))


# --- execution flows -------------------------------------------------------------------------


def _like(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_CALLS = "ca AS (SELECT source_id AS a, target_id AS b FROM {edges} WHERE rel_type = 'CALLS' AND confidence >= 0.5)"
_ENTRY = f"""entry AS (SELECT n.id, n.name, CASE WHEN coalesce(i.n, 0) = 0 THEN 3.0 ELSE least(o.n / (i.n + 1.0), 3.0) END + CASE WHEN is_exported THEN 1.5 ELSE 0 END + CASE WHEN {_like("lower(n.name)", analytics.ENTRY_PATTERNS)} THEN 2.0 ELSE 0 END AS score
FROM {{nodes}} n JOIN (SELECT a, count(*) AS n FROM ca GROUP BY a) o ON o.a = n.id LEFT JOIN (SELECT b, count(*) AS n FROM ca GROUP BY b) i ON i.b = n.id WHERE label IN ('Function', 'Method') AND NOT {_like("lower(file_path)", analytics.TEST_PATTERNS)})"""
_EVENT = f"{_CALLS.format(edges='event_edges')}, {_ENTRY.format(nodes='event_nodes')}"
_TRACES = _EVENT + """, walk AS (SELECT id AS entry, [id] AS path FROM entry UNION ALL SELECT entry, list_append(path, b) FROM walk JOIN (SELECT DISTINCT a, b FROM ca) c ON c.a = path[-1] WHERE len(path) <= 10 AND NOT list_contains(path, b)),
tr AS (SELECT entry, path FROM walk w WHERE len(path) > 10 OR NOT EXISTS (SELECT 1 FROM ca WHERE ca.a = w.path[-1] AND NOT list_contains(w.path, ca.b)))"""
_LONG = _TRACES + """, lt AS (SELECT * FROM tr WHERE len(path) >= 3), cn AS (SELECT e.id, e.score, n FROM entry e JOIN (SELECT entry, count(*) AS n FROM lt GROUP BY entry) x ON x.entry = e.id),
bf AS (SELECT id, coalesce(sum(n) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cn), lo AS (SELECT lt.* FROM lt JOIN bf ON bf.id = entry WHERE before < 100)"""
_KEPT = _LONG + """, st AS (SELECT entry, path, list_sort(path) AS s FROM lo), ke AS (SELECT entry, path FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE (len(b.path) > len(a.path) OR len(b.path) = len(a.path) AND b.path < a.path) AND list_has_all(b.path, a.path)))"""
_ENDS = _KEPT + ", en AS (SELECT path[1] AS f, path[-1] AS l, max(len(path)) AS n FROM ke GROUP BY ALL), be AS (SELECT f AS entry, min(path) AS path FROM ke JOIN en ON path[1] = f AND path[-1] = l AND len(path) = n GROUP BY f, l)"
_SHOW = " SELECT entry, array_to_string(path, '>') AS path FROM "


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("entry", F.array_join("path", ">").alias("path"))


def traces(v: Views) -> tuple[DataFrame, DataFrame]:
    entries = analytics.entry_points(events(v))
    return entries, analytics.trace(entries, analytics.call_arcs(v.event_edges))


def long_traces(v: Views) -> DataFrame:
    entries, found = traces(v)
    return analytics.long_enough(found, entries, 50)


@query(f"WITH {_CALLS.format(edges='edges')}, {_ENTRY.format(nodes='nodes')} SELECT id, name, round(score, 6) AS score FROM entry")
def a6_entry_points(v: Views) -> DataFrame:
    return analytics.entry_points(business(v)).withColumn("score", F.round("score", 6))


@query("WITH " + _TRACES + _SHOW + "tr")
def a7_traces(v: Views) -> DataFrame:
    return shown(traces(v)[1])


@query("WITH " + _LONG + _SHOW + "lo")
def a8_long_traces(v: Views) -> DataFrame:
    return shown(long_traces(v))


@query("WITH " + _KEPT + _SHOW + "ke")
def a9_without_subsets(v: Views) -> DataFrame:
    return shown(analytics.drop_subsets(long_traces(v)))


@query("WITH " + _ENDS + _SHOW + "be")
def a10_by_endpoints(v: Views) -> DataFrame:
    return shown(analytics.by_endpoints(analytics.drop_subsets(long_traces(v))))


_FLOWS = _ENDS + ", fw AS (SELECT path, row_number() OVER (ORDER BY len(path) DESC, path) - 1 AS i FROM be QUALIFY i < 50)"


def flows(v: Views):
    membership = v.event_nodes.select("id", F.concat(F.lit("comm_"), F.split("file_path", "/")[2]).alias("community_id"))
    return analytics.processes(events(v), membership, max_processes=50, max_depth=10)


@query("WITH " + _FLOWS + """, x AS (SELECT i, path, a.name AS an, b.name AS bn FROM fw JOIN event_nodes a ON a.id = path[1] JOIN event_nodes b ON b.id = path[-1])
SELECT 'proc_' || i || '_' || an AS id, upper(an[1]) || an[2:] || ' -> ' || upper(bn[1]) || bn[2:] AS name, CAST(len(path) AS INT) AS step_count, path[1] AS entry_point_id, path[-1] AS terminal_id, 'cross_community' AS process_type FROM x""")
def a11_processes(v: Views) -> DataFrame:
    return flows(v)[0].select("id", "name", "step_count", "entry_point_id", "terminal_id", "process_type")


@query("WITH " + _FLOWS + ", x AS (SELECT i, path, a.name AS an FROM fw JOIN event_nodes a ON a.id = path[1]) SELECT path[k] AS source_id, 'proc_' || i || '_' || an AS target_id, CAST(k AS INT) AS step, 'step ' || k || ' of ' || len(path) AS reason FROM x, unnest(generate_series(1, len(path))) AS t(k)")
def a11_step_edges(v: Views) -> DataFrame:
    return flows(v)[1].select("source_id", "target_id", "step", "reason")


@query("SELECT c_custkey, upper(substring(lower(c_mktsegment), 1, 1)) || substring(lower(c_mktsegment), 2) AS capital, regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') AS clean FROM customer")
def a12_names(v: Views) -> DataFrame:
    return v.customer.select("c_custkey", X.capitalize(F.lower("c_mktsegment")).alias("capital"), X.sanitize(F.col("c_name")).alias("clean"))


# --- diff ------------------------------------------------------------------------------------

_FILES = """fd AS (SELECT coalesce(b.file_path, h.file_path) AS path, CASE WHEN b.file_path IS NULL THEN 'added' WHEN h.file_path IS NULL THEN 'removed' WHEN b.hash IS NOT DISTINCT FROM h.hash THEN 'unchanged' ELSE 'modified' END AS status, b.hash AS base_hash, h.hash AS head_hash FROM base_hashes b FULL JOIN head_hashes h ON b.file_path = h.file_path)"""
_SIDE = """{s} AS (SELECT *, file_path || '::' || label || '::' || qn || '::' || ar AS k1, coalesce(language, 'unknown') || '::' || label || '::' || qn || '::' || ar AS k2, label || '::' || body_hash AS k3 FROM (SELECT *, CASE WHEN container_name IS NULL THEN name ELSE container_name || '.' || name END AS qn, coalesce(parameter_count, 0) AS ar FROM {s}_nodes WHERE label <> 'File') q)"""


def _stage(k: int, b: str, h: str) -> str:
    one = lambda t: f"(SELECT k{k}, min(id) AS id FROM {t} WHERE k{k} IS NOT NULL GROUP BY k{k} HAVING count(*) = 1)"
    return f"m{k} AS (SELECT x.id AS base_id, y.id AS head_id, '{('location', 'symbol', 'body')[k - 1]}' AS match_kind FROM {one(b)} x JOIN {one(h)} y USING (k{k})), b{k} AS (SELECT * FROM {b} WHERE id NOT IN (SELECT base_id FROM m{k})), h{k} AS (SELECT * FROM {h} WHERE id NOT IN (SELECT head_id FROM m{k}))"


_MATCH = f"{_SIDE.format(s='base')}, {_SIDE.format(s='head')}, {_stage(1, 'base', 'head')}, {_stage(2, 'b1', 'h1')}, {_stage(3, 'b2', 'h2')}, mt AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"
_DEGREE = "d{s} AS (SELECT id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM {s}_edges UNION ALL SELECT target_id, 0, 1 FROM {s}_edges) x GROUP BY id)"
_BODY = " OR ".join(f"b.{c} IS DISTINCT FROM h.{c}" for c in ("body_hash", "parameter_count", "return_type"))
_RECORDS = f"""{_MATCH}, {_DEGREE.format(s='base')}, {_DEGREE.format(s='head')}, rec AS (
SELECT h.id AS canonical_id, CASE WHEN b.id IS NULL THEN 'added' WHEN match_kind <> 'location' OR b.file_path <> h.file_path OR b.qn <> h.qn THEN 'moved' WHEN {_BODY} THEN 'modified' ELSE 'unchanged' END AS status, match_kind, b.id IS NOT NULL AND ({_BODY}) AS body_changed, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, h.id AS hid, b.id AS bid, h.file_path AS hf, b.file_path AS bf
FROM head h LEFT JOIN mt ON head_id = h.id LEFT JOIN base b ON b.id = base_id LEFT JOIN dhead d ON d.id = h.id
UNION ALL SELECT 'removed::' || b.id, 'removed', NULL, false, coalesce(o, 0), coalesce(i, 0), NULL, b.id, NULL, b.file_path FROM base b LEFT JOIN dbase d ON d.id = b.id WHERE b.id NOT IN (SELECT base_id FROM mt))"""
_SELECT = f"""{_RECORDS}, sel AS (SELECT canonical_id FROM rec ORDER BY CASE status WHEN 'modified' THEN 0 WHEN 'moved' THEN 1 WHEN 'added' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END, out_degree + in_degree DESC, canonical_id LIMIT 150), {_FILES},
pa AS (SELECT path FROM fd WHERE status <> 'unchanged' UNION SELECT hf FROM rec WHERE canonical_id IN (SELECT canonical_id FROM sel) AND hf IS NOT NULL UNION SELECT bf FROM rec WHERE canonical_id IN (SELECT canonical_id FROM sel) AND bf IS NOT NULL)"""
_LINKS = f"""{_SELECT}, bm AS (SELECT bid AS id, canonical_id FROM rec WHERE bid IS NOT NULL UNION ALL SELECT 'file::' || path, 'file::' || path FROM pa), hm AS (SELECT hid AS id, canonical_id FROM rec WHERE hid IS NOT NULL UNION ALL SELECT 'file::' || path, 'file::' || path FROM pa),
be AS (SELECT DISTINCT s.canonical_id AS source, rel_type AS type, t.canonical_id AS target, confidence FROM base_edges JOIN bm s ON s.id = source_id JOIN bm t ON t.id = target_id), he AS (SELECT DISTINCT s.canonical_id AS source, rel_type AS type, t.canonical_id AS target, confidence FROM head_edges JOIN hm s ON s.id = source_id JOIN hm t ON t.id = target_id),
ids AS (SELECT canonical_id AS id FROM sel UNION SELECT 'file::' || path FROM pa WHERE path IN (SELECT path FROM fd)),
li AS (SELECT coalesce(h.source, b.source) AS source, coalesce(h.type, b.type) AS type, coalesce(h.target, b.target) AS target, CASE WHEN h.source IS NULL THEN 'removed' WHEN b.source IS NULL THEN 'added' ELSE 'unchanged' END AS status, coalesce(h.confidence, b.confidence) AS confidence FROM he h FULL JOIN be b ON h.source = b.source AND h.type = b.type AND h.target = b.target),
lk AS (SELECT * FROM li WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids))"""


def sides(v: Views) -> tuple[Graph, Graph]:
    return Graph(conform(v.base_nodes, NODES), v.base_edges), Graph(conform(v.head_nodes, NODES), v.head_edges)


def whole_diff(v: Views) -> dict[str, DataFrame]:
    base, head = sides(v)
    return diff.diff(base, head, v.base_hashes, v.head_hashes, limit=150)


@query(f"WITH {_FILES} SELECT path, status, base_hash, head_hash FROM fd")
def d1_files(v: Views) -> DataFrame:
    return diff.diff_files(v.base_hashes, v.head_hashes)


@query(f"WITH {_MATCH} SELECT base_id, head_id, match_kind FROM mt")
def d2_staged_match(v: Views) -> DataFrame:
    from ..schema import with_diff_metadata

    base, head = (with_diff_metadata(g.nodes.filter("label <> 'File'")) for g in sides(v))
    return diff.match_symbols(base, head)


@query(f"WITH {_RECORDS} SELECT canonical_id, status, match_kind, out_degree, in_degree FROM rec")
def d3_symbol_status(v: Views) -> DataFrame:
    return whole_diff(v)["records"].select("canonical_id", "status", "match_kind", "out_degree", "in_degree")


@query(f"WITH {_RECORDS} SELECT canonical_id, body_changed FROM rec")
def d4_body_changed(v: Views) -> DataFrame:
    return whole_diff(v)["records"].select("canonical_id", "body_changed")


@query(f"WITH {_SELECT} SELECT canonical_id FROM sel")
def d5_selected_symbols(v: Views) -> DataFrame:
    return diff.select_symbols(diff.diff_symbols(*sides(v)), 150)


@query(f"WITH {_SELECT} SELECT path FROM pa")
def d6_selected_files(v: Views) -> DataFrame:
    records = diff.diff_symbols(*sides(v))
    return diff.select_files(diff.select_symbols(records, 150), records, diff.diff_files(v.base_hashes, v.head_hashes))


@query(f"WITH {_LINKS} SELECT 'base' AS side, id, canonical_id FROM bm UNION ALL SELECT 'head', id, canonical_id FROM hm")
def d7_canonical_ids(v: Views) -> DataFrame:
    records = diff.diff_symbols(*sides(v))
    paths = diff.select_files(diff.select_symbols(records, 150), records, diff.diff_files(v.base_hashes, v.head_hashes))
    one = lambda s: diff.canonical_ids(records, paths, s).select(F.lit(s).alias("side"), "id", "canonical_id")
    return one("base").unionByName(one("head"))


@query(f"WITH {_LINKS} SELECT source, type, target, status, confidence FROM lk")
def d8_edges(v: Views) -> DataFrame:
    return whole_diff(v)["links"]


@query(f"""WITH {_LINKS}, fi AS (SELECT 'file::' || path AS id, regexp_extract(path, '([^/]*)$', 1) AS name, 'File' AS label, path AS file, status, CASE WHEN status = 'removed' THEN 'base' ELSE 'head' END AS layer, 0 AS "group", path AS base_file FROM fd WHERE path IN (SELECT path FROM pa)),
sy AS (SELECT r.canonical_id AS id, coalesce(h.name, b.name) AS name, coalesce(h.label, b.label) AS label, coalesce(hf, bf) AS file, status, CASE WHEN hid IS NULL THEN 'base' ELSE 'head' END AS layer, CASE coalesce(h.label, b.label) WHEN 'Interface' THEN 2 WHEN 'Function' THEN 3 ELSE 8 END AS "group", bf AS base_file FROM rec r JOIN sel USING (canonical_id) LEFT JOIN head h ON h.id = hid LEFT JOIN base b ON b.id = bid)
SELECT * FROM fi UNION ALL SELECT * FROM sy""")
def d9_node_records(v: Views) -> DataFrame:
    return whole_diff(v)["nodes"].select("id", "name", "label", "file", "status", "layer", "group", "base_file")


_COUNT = lambda t, names, p: ", ".join(f"(SELECT count(*) FROM {t} WHERE status = '{n}') AS {p}_{n}" for n in names)


@query(f"WITH {_LINKS} SELECT 'base' AS base_ref, 'head' AS head_ref, {_COUNT('fd', ('added', 'removed', 'modified', 'unchanged'), 'files')}, {_COUNT('rec', ('added', 'removed', 'modified', 'moved', 'unchanged'), 'symbols')}, {_COUNT('lk', ('added', 'removed'), 'edges')}")
def d10_summary(v: Views) -> DataFrame:
    return whole_diff(v)["summary"]


@query("SELECT id AS target_id, community FROM (SELECT id, 'comm_' || (length(id) % 3) AS community FROM event_nodes) x")
def a3_member_of(v: Views) -> DataFrame:
    made = make_edges(v.event_nodes, F.col("id"), F.concat(F.lit("comm_"), F.length("id") % 3), "MEMBER_OF", 1.0, "community membership")
    return made.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("community"))
