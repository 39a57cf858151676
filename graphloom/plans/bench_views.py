"""The driver's relational tables as a code graph and its facts. Each view is one SQL text that Spark and an oracle read alike."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_NULLS = "CAST(NULL AS STRING) AS container_name, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, CAST(NULL AS STRING) AS language, false AS is_exported, CAST(NULL AS INT) AS parameter_count, CAST(NULL AS STRING) AS return_type, false AS is_async, CAST(NULL AS BIGINT) AS body_hash"

VIEWS = {
    # customers, parts, suppliers and orders are symbols; nations are files, regions are folders
    "nodes": f"""
SELECT 'folder::' || r_name AS id, 'Folder' AS label, r_name AS name, r_name AS file_path, {_NULLS} FROM region
UNION ALL SELECT 'file::src/n' || n_nationkey || '.ts', 'File', 'n' || n_nationkey || '.ts', 'src/n' || n_nationkey || '.ts', {_NULLS} FROM nation
UNION ALL SELECT 'customer::' || c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Class' WHEN 1 THEN 'Method' WHEN 2 THEN 'Interface' ELSE 'Function' END, lower(c_mktsegment) || '_' || (c_custkey % 50), 'src/n' || c_nationkey || '.ts',
  CASE WHEN c_custkey % 5 = 1 THEN c_mktsegment END, CAST((c_custkey % 40) * 25 + 1 AS INT), CAST((c_custkey % 40) * 25 + 1 + c_custkey % 60 AS INT), 'typescript', c_acctbal > 0, CAST(c_custkey % 4 AS INT), CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '_' || (c_custkey % 50) END, c_custkey % 7 = 0, (c_custkey * 7919) % 1000003 FROM customer
UNION ALL SELECT 'part::' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Function' ELSE 'Method' END, p_name, 'lib/b' || substring(p_brand, 7, 5) || '.ts', p_type, p_size * 10, p_size * 10 + CAST(p_partkey % 25 AS INT), 'typescript', p_size > 10, CAST(p_partkey % 3 AS INT), lower(p_type), p_size % 9 = 0, (p_partkey * 104729) % 1000003 FROM part
UNION ALL SELECT 'supplier::' || s_suppkey, 'Interface', 'supplier_' || (s_suppkey % 20), 'src/n' || s_nationkey || '.ts', CAST(NULL AS STRING), CAST(s_suppkey % 500 + 1 AS INT), CAST(s_suppkey % 500 + 31 AS INT), 'typescript', true, CAST(NULL AS INT), CAST(NULL AS STRING), false, s_suppkey * 31 FROM supplier
UNION ALL SELECT 'order::' || o_orderkey, 'Function', 'handle_' || lower(substring(o_orderpriority, 3, 20)), 'app/p' || (o_orderkey % 37) || '/order.ts', CAST(NULL AS STRING), CAST(o_orderkey % 900 + 1 AS INT), CAST(o_orderkey % 900 + 1 + o_orderkey % 50 AS INT), 'typescript', o_orderkey % 2 = 0, CAST(1 AS INT), CAST(NULL AS STRING), false, o_orderkey % 99991 FROM orders""",
    "edges": """
SELECT source_id || '-[' || rel_type || ']->' || target_id AS id, source_id, target_id, rel_type, CAST(confidence AS DOUBLE) AS confidence, rel_type || ' by key' AS reason FROM (
SELECT 'folder::' || r_name AS source_id, 'file::src/n' || n_nationkey || '.ts' AS target_id, 'CONTAINS' AS rel_type, 1.0 AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'file::src/n' || c_nationkey || '.ts', 'customer::' || c_custkey, 'CONTAINS', 1.0 FROM customer
UNION ALL SELECT 'file::src/n' || s_nationkey || '.ts', 'supplier::' || s_suppkey, 'CONTAINS', 1.0 FROM supplier
UNION ALL SELECT 'customer::' || c_custkey, 'file::src/n' || c_nationkey || '.ts', 'IMPORTS', 0.9 FROM customer
UNION ALL SELECT 'customer::' || o_custkey, 'order::' || o_orderkey, 'CALLS', 0.95 FROM orders
UNION ALL SELECT 'order::' || l_orderkey, 'part::' || l_partkey, 'CALLS', CASE WHEN min(l_linenumber) = 3 THEN 0.4 ELSE 0.9 END FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'IMPLEMENTS', 0.9 FROM lineitem GROUP BY l_partkey, l_suppkey) x""",
    # transitions between a user's events: a small graph for each user
    "event_nodes": """
SELECT DISTINCT event_type || '_' || user_id AS id, 'Function' AS label, event_type AS name, 'src/team' || user_id || '/' || event_type || '.ts' AS file_path, event_type <> 'error' AS is_exported FROM events""",
    "event_edges": """
SELECT source_id || '-[CALLS]->' || target_id AS id, source_id, target_id, 'CALLS' AS rel_type, CASE WHEN count(*) > 2 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence FROM (
SELECT event_type || '_' || user_id AS source_id, lead(event_type || '_' || user_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_id FROM events) x WHERE target_id IS NOT NULL GROUP BY source_id, target_id""",
    # files, imports, bindings, calls and heritage among them
    "symbols": """
SELECT id AS node_id, name, label, file_path, 'typescript' AS language, is_exported, return_type, start_line, end_line FROM nodes WHERE label NOT IN ('Folder', 'File') AND NOT id LIKE 'order::%'""",
    "import_map": """
SELECT DISTINCT 'src/n' || c_nationkey || '.ts' AS from_file, 'lib/b' || (c_custkey % 9) || '.ts' AS target_file FROM customer WHERE c_custkey % 4 = 0""",
    "bindings": """
SELECT 'src/n' || (p_partkey % 25) || '.ts' AS file_path, p_name AS local_name, max('lib/b' || (p_partkey % 31) || '.ts') AS source_path, p_name AS exported_name FROM part WHERE p_partkey % 3 = 0 GROUP BY p_partkey % 25, p_name
UNION ALL SELECT 'lib/b' || b || '.ts', p_name, 'lib/b' || (b + 1) || '.ts', p_name FROM (SELECT DISTINCT CAST(substring(p_brand, 7, 5) AS INT) + 25 AS b FROM part) x, (SELECT DISTINCT p_name FROM part WHERE p_size < 20) y
UNION ALL SELECT 'src/n' || (s_suppkey % 25) || '.ts', 'obj' || (s_suppkey % 20), min('src/n' || s_nationkey || '.ts'), 'supplier_' || (s_suppkey % 20) FROM supplier GROUP BY s_suppkey % 25, s_suppkey % 20""",
    "calls": """
SELECT (l_orderkey * 10 + l_linenumber) * 100 + copy AS call_id, 'order::' || l_orderkey AS caller_id,
  CASE l_linenumber WHEN 2 THEN lower(c_mktsegment) || '_' || (c_custkey % 50) WHEN 4 THEN 'supplier_' || (l_suppkey % 20) WHEN 5 THEN 'handle_' || lower(substring(o_orderpriority, 3, 20)) WHEN 6 THEN lower(c_mktsegment) || '_' || (l_partkey % 50) ELSE p_name END AS callee_name,
  CASE l_linenumber WHEN 3 THEN 'obj' || (l_suppkey % 20) WHEN 2 THEN lower(c_mktsegment) || '_' || (l_partkey % 50) WHEN 7 THEN 'obj' || (l_partkey % 25) END AS receiver, 'src/n' || c_nationkey || '.ts' AS from_file
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS copy FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "heritage": """
SELECT 'customer::' || c_custkey AS child_id, CASE c_custkey % 4 WHEN 0 THEN 'supplier_' || (c_custkey % 25) WHEN 1 THEN 'Base' || (c_custkey % 7) ELSE lower(c_mktsegment) || '_' || (c_custkey % 60) END AS parent_name, CASE WHEN c_custkey % 2 = 0 THEN 'Implements' ELSE 'Extends' END AS kind, 'src/n' || c_nationkey || '.ts' AS file_path FROM customer""",
    # paths from page addresses
    "paths": """
SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.ts' AS path FROM pages WHERE page_id % 5 <> 0
UNION SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/index.js' FROM pages WHERE page_id % 5 = 0""",
    "path_imports": """
SELECT DISTINCT a.path AS from_file, m.module_path FROM paths a JOIN (SELECT DISTINCT page_id % 7 AS r, CASE page_id % 4 WHEN 0 THEN './' || (page_id % 900) WHEN 1 THEN '../' || regexp_extract(url, '/([a-z][a-z])/', 1) || '/./' || regexp_extract(url, '/([0-9]+)', 1) WHEN 2 THEN '"pkg/' || regexp_extract(url, '/([a-z][a-z]/[0-9]+)', 1) || '"' ELSE regexp_replace(regexp_extract(url, '/([a-z][a-z]/[0-9]+)', 1), '/', '.') END AS module_path FROM pages) m ON length(a.path) % 7 = m.r""",
    # two revisions of the parts
    "base_nodes": """
SELECT 'file::' || file_path AS id, 'File' AS label, file_path AS name, file_path, CAST(NULL AS STRING) AS container_name, CAST(NULL AS INT) AS start_line, CAST(NULL AS STRING) AS language, CAST(NULL AS INT) AS parameter_count, CAST(NULL AS STRING) AS return_type, CAST(NULL AS BIGINT) AS body_hash FROM (SELECT DISTINCT 'lib/' || p_brand || '/' || (p_partkey % 17) || '.ts' AS file_path FROM part) f
UNION ALL SELECT 'part::' || p_partkey, 'Function', p_name || '_' || (p_partkey % 200), 'lib/' || p_brand || '/' || (p_partkey % 17) || '.ts', CASE WHEN p_size % 2 = 0 THEN p_type END, p_size, 'typescript', CAST(p_partkey % 3 AS INT), p_type, (p_partkey * 104729) % 1000003 FROM part""",
    "head_nodes": """
SELECT 'file::' || file_path AS id, 'File' AS label, file_path AS name, file_path, CAST(NULL AS STRING) AS container_name, CAST(NULL AS INT) AS start_line, CAST(NULL AS STRING) AS language, CAST(NULL AS INT) AS parameter_count, CAST(NULL AS STRING) AS return_type, CAST(NULL AS BIGINT) AS body_hash FROM (SELECT DISTINCT 'lib/' || p_brand || '/' || (p_partkey % 17 + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) || '.ts' AS file_path FROM part WHERE p_partkey % 10 <> 0 UNION SELECT 'lib/new/' || (s_suppkey % 5) || '.ts' FROM supplier) f
UNION ALL SELECT 'part::' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END, 'Function', CASE WHEN p_partkey % 11 = 0 THEN 'new_' ELSE '' END || p_name || '_' || (p_partkey % 200), 'lib/' || p_brand || '/' || (p_partkey % 17 + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) || '.ts', CASE WHEN p_size % 2 = 0 THEN p_type END, p_size + 1, 'typescript', CAST(p_partkey % 3 AS INT), p_type,
  (p_partkey * 104729) % 1000003 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'added::' || s_suppkey, 'Interface', 'supplier_' || s_suppkey, 'lib/new/' || (s_suppkey % 5) || '.ts', CAST(NULL AS STRING), 1, 'typescript', CAST(NULL AS INT), CAST(NULL AS STRING), s_suppkey FROM supplier""",
    "base_edges": """
SELECT 'file::' || file_path || '-[CONTAINS]->' || id AS id, 'file::' || file_path AS source_id, id AS target_id, 'CONTAINS' AS rel_type, CAST(1.0 AS DOUBLE) AS confidence FROM base_nodes WHERE label <> 'File'
UNION ALL SELECT 'part::' || p_partkey || '-[CALLS]->part::' || (p_partkey * 7 % 199), 'part::' || p_partkey, 'part::' || (p_partkey * 7 % 199), 'CALLS', CAST(0.9 AS DOUBLE) FROM part""",
    "head_edges": """
SELECT 'file::' || file_path || '-[CONTAINS]->' || id AS id, 'file::' || file_path AS source_id, id AS target_id, 'CONTAINS' AS rel_type, CAST(1.0 AS DOUBLE) AS confidence FROM head_nodes WHERE label <> 'File'
UNION ALL SELECT 'part::' || p_partkey || '-[CALLS]->part::' || (p_partkey * 7 % 193), 'part::' || p_partkey, 'part::' || (p_partkey * 7 % 193), 'CALLS', CAST(0.9 AS DOUBLE) FROM part""",
    "base_hashes": "SELECT 'lib/' || p_brand || '/' || (p_partkey % 17) || '.ts' AS file_path, sum((p_partkey * 104729) % 1000003) AS hash FROM part GROUP BY 1",
    "head_hashes": """
SELECT 'lib/' || p_brand || '/' || (p_partkey % 17 + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) || '.ts' AS file_path, sum((p_partkey * 104729) % 1000003 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) AS hash FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1
UNION ALL SELECT 'lib/new/' || (s_suppkey % 5) || '.ts', sum(s_suppkey) FROM supplier GROUP BY 1""",
    # variables, from events in their order
    "assignments": """
SELECT CASE event_id % 3 WHEN 0 THEN 'f' || (user_id % 40) WHEN 1 THEN 'f' || (user_id % 40) || '::g' || (event_id % 5) ELSE 'f' || (user_id % 40) || '::h' || (event_id % 7) END AS scope, 'v' || (event_id % 400) AS variable,
  CASE event_type WHEN 'view' THEN 'Constructor' WHEN 'click' THEN 'TypeAnnotation' WHEN 'purchase' THEN 'FunctionCall' ELSE 'Variable' END AS kind,
  CASE event_type WHEN 'view' THEN 'C' || (event_id % 9) WHEN 'click' THEN 'T' || (event_id % 11) WHEN 'purchase' THEN 'fn' || (event_id % 30) ELSE 'v' || ((event_id * 7 + 1) % 400) END AS source, event_id AS ordinal
FROM events""",
}

# what path_imports joins: files and imports of the same number
VIEWS["path_importers"] = "SELECT path AS from_file, length(path) % 7 AS r FROM paths"
VIEWS["path_specifiers"] = re.search(r"JOIN \((SELECT DISTINCT .*)\) m ON length\(a\.path\) % 7 = m\.r$", VIEWS["path_imports"])[1]

_WORD = re.compile(r"[a-z_]+")


def needs(sql: str) -> list[str]:
    """The views that a text names, those that they name first."""
    out: list[str] = []
    for w in _WORD.findall(sql):
        if w in VIEWS and w not in out:
            out += [x for x in needs(VIEWS[w]) if x not in out] + [w]
    return list(dict.fromkeys(out))


def oracle(body: str) -> str:
    """A query over views (a SELECT, or WITH and a SELECT) as one text over the base tables."""
    own = [f"{v} AS ({VIEWS[v]})" for v in needs(body)]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {', '.join([*own, body[5:]])}"
    return f"WITH RECURSIVE {', '.join(own)} {body}" if own else body


class Views:
    """The views of a folder of tables, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                # the text's own tables, by name; arguments become temporary views while it is analysed
                sql = VIEWS[name]
                used = [w for w in dict.fromkeys(_WORD.findall(sql)) if (w in VIEWS or w in BASE) and w != name and re.search(rf"(FROM|JOIN|,)\s+{w}\b", sql)]
                text = sql
                for w in used:
                    text = re.sub(rf"\b(FROM|JOIN)\s+{w}\b", rf"\1 {{{w}}}", text)
                self.made[name] = self.spark.sql(text, **{w: getattr(self, w) for w in used})
            elif name in BASE:
                self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]
