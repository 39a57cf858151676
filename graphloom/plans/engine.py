"""From a repository to its graph, again after changes, and a façade for what can be asked of it."""
from __future__ import annotations

import json
import platform
import time
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import Config
from ..operators import analytics, diff, export, graph, resolve, search, traverse
from ..operators.graph import Graph
from ..schema import EDGES, NODES, conform
from ..sources import facts as facts_of
from ..sources import git, scan, store
from ..sources.changes import changeset
from ..staging import mounted_dir, scratch, staged


@dataclass(frozen=True)
class Analysis:
    """What a run found; `graph` is read from the store."""

    graph: Graph
    files_scanned: int
    added: int
    modified: int
    deleted: int
    unchanged: int
    full: bool
    process_stats: dict


def link(nodes: DataFrame, files: DataFrame, facts: dict[str, DataFrame | None], link_all_folders: bool = False, put=staged) -> Graph:
    """The graph of all facts, without communities and flows. files: relative_path, language.

    A kind of fact of which there is none (None) costs no join. put: writes a table and reads it back.
    """
    spark = nodes.sparkSession
    made = graph.structure(files, link_all_folders)
    parts = [made.edges, graph.file_contains(nodes)]
    bindings = spark.createDataFrame([], "file_path string, local_name string, source_path string, exported_name string")
    imported = spark.createDataFrame([], "from_file string, target_file string")
    heritage = spark.createDataFrame([], "child_id string, parent_name string, kind string, file_path string")
    if facts["heritage"] is not None:
        heritage = facts["heritage"].select("child_id", "parent_name", "kind", F.col("relative_path").alias("file_path"))
    symbols = resolve.symbol_table(nodes)
    if facts["imports"] is not None:
        imports = facts["imports"].select(F.col("relative_path").alias("from_file"), "module_path", "imported_name", "alias", "is_namespace", "ordinal")
        resolved = staged(resolve.resolve_imports(imports, files.select(F.col("relative_path").alias("path"))), "imports")
        bindings, imported = staged(resolve.named_bindings(imports, resolved), "bindings"), resolve.import_map(resolved)
        # two specifiers may lead to one file: the file's last import names the edge
        last = imports.join(resolved, ["from_file", "module_path"]).groupBy("from_file", "target").agg(F.max_by("module_path", "ordinal").alias("module_path"))
        parts.append(resolve.import_edges(last))
    if facts["calls"] is not None:
        calls = facts["calls"].select(F.concat_ws("#", "relative_path", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("call_id"), "caller_id", "callee_name", "receiver", F.col("relative_path").alias("from_file"))
        parts.append(resolve.call_edges(calls, symbols, bindings, imported, heritage))
    if facts["heritage"] is not None:
        parts.append(resolve.heritage_edges(resolve.resolve_heritage(heritage, symbols, bindings, imported)))
    edges = reduce(DataFrame.unionByName, parts)
    return Graph(put(made.nodes.unionByName(conform(nodes, NODES)), "nodes"), put(store.laid(edges), "edges"))


def enrich(linked: Graph, config: Config = Config()) -> tuple[Graph, dict]:
    """The communities and execution flows of a linked graph: what they add to it, and counts."""
    c_nodes, c_edges, membership = analytics.communities(linked, config.community_resolution)
    p_nodes, p_edges, stats = analytics.processes(linked, membership, config.max_processes, config.max_trace_depth)
    return Graph(c_nodes.unionByName(p_nodes), c_edges.unionByName(p_edges)), stats


def _digest(linked: Graph, config: Config) -> str:
    """A hash of all that communities and flows depend on: calls and heritage, the symbols' names and places, settings."""
    total = lambda *cols: F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    edges = linked.edges.filter(F.col("rel_type").isin(*analytics.CLUSTERING)).agg(F.count("*"), total("id", "confidence")).first()
    nodes = linked.nodes.agg(F.count("*"), total("id", "label", "name", "file_path", "is_exported")).first()
    return " ".join(map(str, (*edges, *nodes, config.community_resolution, config.max_processes, config.max_trace_depth)))


def analyze(spark: SparkSession, root: str, out: str, config: Config = Config(), registry: store.Registry | None = None, link_all_folders: bool = False) -> Analysis:
    """Scan, parse what changed, and write the graph to `out` as a new generation.

    Facts are kept for each file, so the graph after a change is the same as that of a first run. Where changed files have the
    same facts as before (a comment, a body), the graph is kept; else all facts are linked anew.
    """
    with scratch(spark):
        return _analyze(spark, root, out, config, registry, link_all_folders)


def _analyze(spark: SparkSession, root: str, out: str, config: Config, registry: store.Registry | None, link_all_folders: bool) -> Analysis:
    listed = scan.listing(spark, root, config)
    old = store.manifest(spark, out)
    kinds = store.FACTS
    if old is None:
        # contents are read once, and never copied
        parsed = staged(facts_of.parse(scan.read(listed, root)), "parsed")
        count = {}
        files, hashes = parsed.select("relative_path", "language"), parsed.select(F.col("relative_path").alias("file_path"), "hash", "facts")
    else:
        before = store.load(spark, out, old)[1].select("file_path", "hash", F.col("facts").alias("old_facts"))
        # hashes first: contents are read again for what has to be parsed
        now = scan.read(listed, root).select(F.col("relative_path").alias("file_path"), "language", "size", "hash")
        changes = staged(changeset(now, before), "changes")
        count = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        if set(count) <= {"unchanged"}:
            return Analysis(store.load(spark, out, old)[0], 0, 0, 0, 0, count.get("unchanged", 0), full=False, process_stats={})
        changed = changes.filter("status in ('added', 'modified')")
        parsed = staged(facts_of.parse(scan.read(changed.select(F.col("file_path").alias("relative_path"), "size"), root)), "parsed")
        files = changes.filter("status <> 'deleted'").select(F.col("file_path").alias("relative_path"), "language")
        fresh = parsed.select(F.col("relative_path").alias("file_path"), F.col("hash").alias("new_hash"), "facts")
        known = changes.filter("status <> 'deleted'").join(fresh, "file_path", "left")
        hashes = known.select("file_path", F.coalesce("new_hash", "hash").alias("hash"), F.coalesce("facts", "old_facts").alias("facts"))
    made = store.Generation(spark, out, old)
    n = {k: count.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")}
    stats: dict = {}
    if old and not n["added"] and not n["deleted"] and known.filter("status = 'modified' and not facts <=> old_facts").isEmpty():
        made.keep("nodes", "edges", *kinds)
        made.notes = old["notes"]
        stats = made.notes.get("stats", {})
        made.put(conform(hashes, store.HASHES), "file_hashes")
    else:
        tables: dict[str, DataFrame | None] = facts_of.exploded(parsed)
        seen = parsed.agg(F.count("*").alias("files"), *[F.sum(F.size(k)).alias(k) for k in kinds]).first()
        if not old:
            n["added"] = seen["files"]
        for k in kinds:
            tables[k] = tables[k] if seen[k] else None
        if old and n["unchanged"]:
            same = changes.filter("status = 'unchanged'").select("file_path")
            kept_nodes = store.load(spark, out, old)[0].nodes.filter("language is not null and label <> 'File'").join(same, "file_path", "left_semi")
            tables["nodes"] = tables["nodes"].unionByName(conform(kept_nodes, NODES))
            for k, rows in store.load_facts(spark, out, old).items():
                if rows is not None:
                    kept = rows.join(same.withColumnRenamed("file_path", "relative_path"), "relative_path", "left_semi")
                    tables[k] = kept if tables[k] is None else tables[k].unionByName(kept)
        for k in kinds:
            tables[k] = made.put(tables[k], k) if tables[k] is not None else None
        # without the facts to be linked, the nodes are read once or twice only
        nodes = staged(tables["nodes"], "nodes") if any(tables[k] is not None for k in kinds) else tables["nodes"]
        linked = link(nodes, files, tables, link_all_folders, made.put)
        if tables["calls"] is not None or tables["heritage"] is not None:
            digest, notes = _digest(linked, config), old["notes"] if old else {}
            if notes.get("digest") == digest:
                # what communities and flows are made of is as it was
                made.tables["nodes"].append(notes["more"][0])
                made.tables["edges"].append(notes["more"][1])
                stats = notes["stats"]
            else:
                more, stats = enrich(linked, config)
                made.put(conform(more.nodes, NODES), "nodes")
                made.put(store.laid(more.edges), "edges")
            made.notes = {"digest": digest, "stats": stats, "more": [made.tables["nodes"][-1], made.tables["edges"][-1]]}
        made.put(conform(hashes, store.HASHES), "file_hashes")
    made.done()
    whole = store.load(spark, out)[0]
    if registry:
        registry.upsert(root, out, nodes=whole.nodes.count(), edges=whole.edges.count())
    return Analysis(whole, n["added"] + n["modified"], full=not (old and n["unchanged"]), process_stats=stats, **n)


def diff_revisions(spark: SparkSession, root: str, base: str = "HEAD", head: str = git.WORKTREE, limit: int = diff.MAX_SYMBOLS) -> dict[str, DataFrame]:
    """The diff of two revisions; each is analysed in a shared folder of its own."""
    import uuid

    top = f"{mounted_dir(spark)}/graphloom-revisions-{uuid.uuid4().hex}"
    sides = []
    for name, revision in (("base", base), ("head", head)):
        at = Path(top, name)
        at.mkdir(parents=True)
        folder = git.checkout(root, revision, at)
        analyze(spark, str(folder), f"{top}/{name}-graph")
        sides.append(store.load(spark, f"{top}/{name}-graph"))
    (b, bh), (h, hh) = sides
    return diff.diff(b, h, bh, hh, limit, (base, head))


def diff_text(found: dict[str, DataFrame], first: int = 20) -> str:
    """A summary and the first changed symbols."""
    s = found["summary"].first().asDict()
    changed = found["records"].filter("status <> 'unchanged'").select("status", "canonical_id").orderBy("status", "canonical_id").limit(first).collect()
    counts = [f"{kind}: " + ", ".join(f"{s[f'{kind}_{k}']} {k}" for k in ("added", "removed", "modified", "moved", "unchanged") if f"{kind}_{k}" in s) for kind in ("files", "symbols", "edges")]
    return "\n".join([f"{s['base_ref']} -> {s['head_ref']}", *counts, *[f"  {r['status']:>9}  {r['canonical_id']}" for r in changed]])


def diff_data(found: dict[str, DataFrame]) -> dict:
    """Summary, files, nodes and links; nodes and links are bounded by the diff's limit."""
    s = found["summary"].first().asDict()
    rows = lambda name, *order: [r.asDict() for r in found[name].orderBy(*order).collect()]
    return {"mode": "diff", "base_ref": s["base_ref"], "head_ref": s["head_ref"], "summary": s, "files": rows("files", "path"), "nodes": rows("nodes", "label", "name", "id"), "links": rows("links", "source", "target", "type")}


def diff_json(found: dict[str, DataFrame]) -> str:
    return json.dumps(diff_data(found))


def diff_html(found: dict[str, DataFrame]) -> str:
    """The viewer's page of a diff: nodes and links by what became of them."""
    data = diff_data(found)
    s = data["summary"]
    return export.page(data, f"Diff: {data['base_ref']} -> {data['head_ref']}", " | ".join(f"{s[f'symbols_{k}']} {k}" for k in ("added", "removed", "modified", "moved")))


def _memory() -> dict:
    """Megabytes of this process at most, and of the JVM's heap now."""
    import resource

    spark = SparkSession.getActiveSession()
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime() if spark else None
    return {"max_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10, "jvm_heap_mb": (heap.totalMemory() - heap.freeMemory()) >> 20 if heap else None}


def benchmark(spark: SparkSession, root: str, out: str, sample_file: str | None = None) -> dict:
    """Seconds of a first run, of one without changes, and of one after a comment was added to a file, which is put back.

    `out` is a folder of its own, so the repository's graph stays as it was, and it is dropped at the end.
    """
    report: dict = {"generated_at_unix": int(time.time()), "versions": {"spark": spark.version, "python": platform.python_version(), "package": __version__}, "cores": spark.sparkContext.defaultParallelism, "runs": {}}
    store.drop(spark, out)

    def timed(name: str) -> Analysis:
        began = time.time()
        done = analyze(spark, root, out)
        seconds = round(time.time() - began, 3)
        labels = {r["label"]: r["count"] for r in graph.counts_by(done.graph.nodes, "label").collect()}
        relations = {r["rel_type"]: r["count"] for r in graph.counts_by(done.graph.edges, "rel_type").collect()}
        report["runs"][name] = {"seconds": seconds, "files_scanned": done.files_scanned, "labels": labels, "relations": relations, **_memory()}
        return done

    try:
        done = timed("cold")
        timed("no_change")
        first = sample_file
        if first is None:
            found = done.graph.nodes.filter("label = 'File'").filter(F.col("file_path").rlike(r"[.](ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs)$")).agg(F.min("file_path")).first()
            first = found[0]
        if first:
            at = Path(root, first)
            before = at.read_bytes()
            try:
                at.write_bytes(before + (b"\n# touched\n" if first.endswith((".py", ".pyi")) else b"\n// touched\n"))
                timed("one_file")
            finally:
                at.write_bytes(before)
    finally:
        store.drop(spark, out)
    return report


class Engine:
    """What a command line or a tool server asks of one stored graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.graph, self.hashes = store.load(spark, path)
        self._index: search.Index | None = None

    @property
    def index(self) -> search.Index:
        if self._index is None:
            made = search.build(self.graph.nodes)
            self._index = search.Index(staged(made.postings, "postings"), staged(made.lengths, "lengths"), staged(made.stats, "stats"), self.graph.nodes)
        return self._index

    def query(self, text: str, limit: int = 10) -> DataFrame:
        return search.query(self.graph.nodes, self.index, text, limit)

    def context(self, name: str, limit: int = 15) -> DataFrame:
        return graph.context(self.graph, name, limit)

    def impact(self, name: str, direction: str = "up", depth: int = 3, limit: int | None = None) -> DataFrame:
        return traverse.impact(self.graph, name, direction, depth, limit)

    def symbols(self, label: str | None = None, limit: int = 20) -> DataFrame:
        return graph.symbols(self.graph.nodes, label, limit)

    def status(self) -> DataFrame:
        return graph.status(self.graph)
