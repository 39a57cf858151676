"""Communities (Louvain moves) and execution flows (path tracing) over the call graph."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NODES, conform, is_symbol, make_edges
from ..staging import numbered, staged
from .graph import Graph

LEAST_CONFIDENCE = 0.5
CLUSTERING = ("CALLS", "EXTENDS", "IMPLEMENTS")

# Folders that name no community; parts of names that entry points have, of paths that tests have.
GENERIC_FOLDERS = ("src", "lib", "core", "utils", "common", "shared", "helpers", "test", "tests")
ENTRY_PATTERNS = ("handle", "on", "main", "init", "start", "run", "execute", "process", "serve", "listen", "route", "controller", "endpoint", "handler", "middleware", "dispatch", "trigger", "invoke")
TEST_PATTERNS = ("test", "spec", "__test__", "__tests__", ".test.", ".spec.", "_test.", "_spec.", "fixture", "mock")


# --- communities -----------------------------------------------------------------------------


def clustering_edges(graph: Graph) -> DataFrame:
    """a, b of the calls and heritage between two different symbols, confident enough; parallel edges stay."""
    ids = graph.nodes.filter(is_symbol(F.col("label"))).select(F.col("id").alias("_id"))
    kept = graph.edges.filter(F.col("rel_type").isin(*CLUSTERING) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("source_id") != F.col("target_id")))
    kept = kept.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")
    return kept.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def adjacency(edges: DataFrame) -> DataFrame:
    """at, to, weight both ways."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("at"), F.col("b").alias("to")).agg(F.count("*").alias("weight"))


def louvain_sweep(near: DataFrame, degree: DataFrame, community: DataFrame, m2: float, resolution: float, upward: bool) -> DataFrame:
    """id, community after one synchronous sweep: every node at once looks for its best gain.

    Only moves to a smaller community number count on one sweep, to a larger one on the next (`upward`), so
    that two nodes can't swap for ever.
    """
    mine = community.join(degree, "id")
    sums = mine.groupBy("community").agg(F.sum("k").alias("sigma"))
    of = community.select(F.col("id").alias("to"), F.col("community").alias("target"))
    links = near.join(of, "to").groupBy(F.col("at").alias("id"), "target").agg(F.sum("weight").alias("links"))
    own = mine.join(sums, "community").select("id", "community", "k", (F.col("sigma") - F.col("k")).alias("sigma_own"))
    here = links.select("id", F.col("target").alias("community"), F.col("links").alias("links_own"))
    own = own.join(here, ["id", "community"], "left").withColumn("links_own", F.coalesce("links_own", F.lit(0)))
    gain = (F.col("links") - F.col("links_own")) / m2 - resolution * F.col("k") * (F.col("sigma") - F.col("sigma_own")) / (m2 * m2)
    side = F.col("target") > F.col("community") if upward else F.col("target") < F.col("community")
    offers = own.join(links, "id").join(sums.select(F.col("community").alias("target"), "sigma"), "target").withColumn("gain", F.round(gain, 15)).filter((F.col("gain") > 0) & side)
    best = offers.groupBy("id").agg(F.max_by("target", F.struct("gain", -F.col("target"))).alias("moved"))
    return community.join(best, "id", "left").select("id", F.coalesce("moved", "community").alias("community"))


def louvain(graph: Graph, resolution: float = 1.0, sweeps: int = 20) -> tuple[DataFrame, DataFrame]:
    """(id, community) of each node that has a clustering edge, and the adjacency. One level of local moves.

    The objective is the usual modularity gain; moves are made for all nodes at once, in a fixed order of
    communities, so the result is the same for any partitioning.
    """
    near = staged(adjacency(clustering_edges(graph)), "adjacency")
    if near.isEmpty():
        return near.select(F.col("at").alias("id"), F.lit(0).cast("long").alias("community")), near
    degree = near.groupBy(F.col("at").alias("id")).agg(F.sum("weight").alias("k"))
    # numbers by a sort over partitions, without a window over all rows
    ids = staged(degree.orderBy("id").select("id", "k", F.monotonically_increasing_id().alias("community")), "louvain")
    degree = ids.select("id", "k")
    m2 = float(near.agg(F.sum("weight")).first()[0] or 0)
    community, still = ids.select("id", "community"), 0
    for sweep in range(sweeps):
        moved = staged(louvain_sweep(near, degree, community, m2, resolution, bool(sweep % 2)), "louvain")
        changed = moved.join(community.select("id", F.col("community").alias("before")), "id").filter("community <> before").count()
        community = moved
        still = 0 if changed else still + 1
        if still == 2:
            break
    return community, near


def modularity(near: DataFrame, community: DataFrame, resolution: float = 1.0) -> float:
    a = community.select(F.col("id").alias("at"), F.col("community").alias("ca"))
    b = community.select(F.col("id").alias("to"), F.col("community").alias("cb"))
    joined = near.join(a, "at").join(b, "to")
    m2 = joined.agg(F.sum("weight")).first()[0]
    if not m2:
        return 0.0
    inside = joined.filter("ca = cb").agg(F.sum("weight")).first()[0] or 0
    sums = joined.groupBy("ca").agg(F.sum("weight").alias("s")).agg(F.sum(F.col("s").cast("double") ** 2)).first()[0]
    return inside / m2 - resolution * sums / (m2 * m2)


def ranked_communities(community: DataFrame, least: int = 2) -> DataFrame:
    """community, size, position: those of two members and more, the largest first, then the smallest number."""
    sizes = community.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first")).filter(F.col("size") >= least)
    return numbered(sizes, F.desc("size"), "first")


def community_labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, folder: the parent folder that most members have (ties: the least), null if all are generic. members: id, community."""
    path = F.split(F.col("file_path"), "/")
    folders = members.join(nodes.select("id", "file_path"), "id").filter(F.size(path) >= 2).select("community", F.try_element_at(path, F.lit(-2)).alias("folder")).filter(~F.lower("folder").isin(*GENERIC_FOLDERS))
    counted = folders.groupBy("community", "folder").agg(F.count("*").alias("n"))
    best = counted.groupBy("community").agg(F.max("n").alias("n"))
    return counted.join(best, ["community", "n"]).groupBy("community").agg(F.min("folder").alias("folder"))


def cohesion(members: DataFrame, near: DataFrame, first: int = 50) -> DataFrame:
    """community, cohesion: the share of the first members' links that stay inside; 1 without links. members: id, community."""
    order = Window.partitionBy("community").orderBy("id")
    some = members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).select(F.col("id").alias("at"), "community")
    to = members.select(F.col("id").alias("to"), F.col("community").alias("other"))
    links = some.join(near, "at").join(to, "to", "left")
    shares = links.groupBy("community").agg((F.sum(F.when(F.col("other") == F.col("community"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("share"))
    return members.select("community").distinct().join(shares, "community", "left").select("community", F.coalesce("share", F.lit(1.0)).alias("cohesion"))


def communities(graph: Graph, resolution: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Community nodes, MEMBER_OF edges, and (id, community_id)."""
    community, near = louvain(graph, resolution)
    if near.isEmpty():
        spark = near.sparkSession
        none = spark.createDataFrame([], "id string, community_id string")
        return spark.createDataFrame([], NODES), make_edges(none, F.col("id"), F.col("community_id"), "MEMBER_OF", 1.0, "community membership"), none
    ranks = ranked_communities(community)
    members = staged(community.join(ranks, "community").select("id", F.col("position").alias("community"), "size"), "members")
    label = community_labels(members, graph.nodes)
    own = members.groupBy("community").agg(F.max("size").alias("size")).join(label, "community", "left").join(cohesion(members.select("id", "community"), near), "community")
    name = F.coalesce(X.ascii_capital(F.col("folder")), F.concat(F.lit("Cluster_"), "community"))
    nodes = own.select(F.concat(F.lit("comm_"), "community").alias("id"), F.lit("Community").alias("label"), name.alias("name"), F.lit("").alias("file_path"), name.alias("heuristic_label"), "cohesion", F.col("size").alias("symbol_count"))
    membership = members.select("id", F.concat(F.lit("comm_"), "community").alias("community_id"))
    return conform(nodes, NODES), make_edges(membership, F.col("id"), F.col("community_id"), "MEMBER_OF", 1.0, "community membership"), membership


# --- execution flows -------------------------------------------------------------------------


def call_arcs(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("rel_type") == "CALLS") & (F.col("confidence") >= LEAST_CONFIDENCE)).select(F.col("source_id").alias("at"), F.col("target_id").alias("to"))


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def entry_points(graph: Graph) -> DataFrame:
    """id, name, score of functions and methods outside tests that call something."""
    calls = call_arcs(graph.edges)
    out = calls.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("n_out"))
    into = calls.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n_in"))
    own = graph.nodes.filter(F.col("label").isin("Function", "Method") & ~_any_of(F.lower("file_path"), TEST_PATTERNS)).select("id", "name", F.coalesce("is_exported", F.lit(False)).alias("is_exported"))
    rows = own.join(out, "id").join(into, "id", "left")
    ratio = F.when(F.coalesce("n_in", F.lit(0)) == 0, 3.0).otherwise(F.least(F.col("n_out") / (F.col("n_in") + 1.0), F.lit(3.0)))
    bonus = F.when(F.col("is_exported"), 1.5).otherwise(0.0) + F.when(_any_of(F.lower("name"), ENTRY_PATTERNS), 2.0).otherwise(0.0)
    return rows.select("id", "name", (ratio + bonus).alias("score"))


def trace(starts: DataFrame, calls: DataFrame, max_depth: int = 10, branching: int = 4, most: int = 500) -> DataFrame:
    """entry, path: paths without a repeated node from each start, at most `branching` callees a step (least ids first).

    A path ends at a leaf, where all callees were visited, or when it is longer than `max_depth`. An entry keeps its
    first `most` paths by length and path. Such a bound is what the operator is for: paths grow exponentially.
    """
    # a path has at most `max_depth` nodes that a step must leave out, so a hub's first few callees are enough
    nearest = Window.partitionBy("at").orderBy("to")
    first = calls.distinct().withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= branching + max_depth)
    arcs = staged(first.groupBy("at").agg(F.sort_array(F.collect_list("to")).alias("callees")), "arcs")
    live = staged(starts.select(F.col("id").alias("entry"), F.array("id").alias("path")), "paths")
    done: list[DataFrame] = []
    # the bound on an entry's live paths, which a queue would have, too
    bound = Window.partitionBy("entry").orderBy("path")
    for length in range(1, max_depth + 2):
        if length > max_depth:
            done.append(live)
            break
        there = live.join(arcs, F.element_at("path", -1) == F.col("at"), "left").select("entry", "path", F.coalesce(F.array_except("callees", "path"), F.array().cast("array<string>")).alias("next"))
        done.append(there.filter(F.size("next") == 0).select("entry", "path"))
        grown = there.select("entry", "path", F.explode(F.slice("next", 1, branching)).alias("to")).select("entry", F.concat("path", F.array("to")).alias("path"))
        live = staged(grown.withColumn("_n", F.row_number().over(bound)).filter(F.col("_n") <= most).drop("_n"), "paths")
        if live.isEmpty():
            break
    order = Window.partitionBy("entry").orderBy(F.size("path"), "path")
    return reduce(DataFrame.unionByName, done).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def long_enough(traces: DataFrame, ranks: DataFrame, max_processes: int, min_steps: int = 3) -> DataFrame:
    """Traces of `min_steps` and more, entry by entry (by score, then id) until there are twice `max_processes`."""
    kept = traces.filter(F.size("path") >= min_steps)
    counts = ranks.select("id", "score").join(kept.groupBy(F.col("entry").alias("id")).agg(F.count("*").alias("n")), "id")
    # each has a trace, so no more than the first 2 * max_processes can be needed: the running sum is over these
    counts = counts.orderBy(F.desc("score"), "id").limit(2 * max_processes)
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = counts.withColumn("before", before).filter(F.col("before") < 2 * max_processes).select(F.col("id").alias("entry"))
    return kept.join(chosen, "entry", "left_semi")


def drop_subsets(traces: DataFrame) -> DataFrame:
    """Without traces whose nodes are all on one earlier trace (longer, or as long and less). At most some hundred rows come here."""
    ranked = traces.select("entry", "path", F.array_sort(F.array_distinct("path")).alias("nodes"), F.size("path").alias("n"))
    # a containing trace holds the least node, too: an equi-join instead of all pairs
    holders = ranked.select(F.explode("nodes").alias("key"), F.col("nodes").alias("o_nodes"), F.col("n").alias("o_n"), F.col("path").alias("o_path"))
    mine = ranked.withColumn("key", F.element_at("nodes", 1))
    earlier = (F.col("o_n") > F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_path") < F.col("path")))
    return mine.join(holders, (mine["key"] == holders["key"]) & earlier & (F.size(F.array_except("nodes", "o_nodes")) == 0), "left_anti").select("entry", "path")


def by_endpoints(traces: DataFrame) -> DataFrame:
    """The longest trace of each first and last node; ties: the least path."""
    ends = [F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last")]
    longest = traces.select(*ends, "entry", "path", F.size("path").alias("n"))
    top = longest.groupBy("first", "last").agg(F.max("n").alias("n"))
    return longest.join(top, ["first", "last", "n"]).groupBy("first", "last").agg(F.min("path").alias("path")).select(F.col("first").alias("entry"), "path")


def processes(graph: Graph, membership: DataFrame, max_processes: int = 200, max_depth: int = 15, branching: int = 4, min_steps: int = 3) -> tuple[DataFrame, DataFrame, dict]:
    """Process nodes, STEP_IN_PROCESS edges, and counts. membership: id, community_id."""
    entries = staged(entry_points(graph), "entries")
    if entries.isEmpty():
        spark = entries.sparkSession
        none = spark.createDataFrame([], "id string, path array<string>")
        return spark.createDataFrame([], NODES), step_edges(none), {"total_processes": 0, "cross_community": 0, "avg_step_count": 0.0, "entry_points_found": 0}
    # entries by rank, in growing batches, until there are traces enough: the rest need not be traced
    ranked = numbered(entries, F.desc("score"), "id")
    total, start, size, long, found = entries.count(), 0, 4 * max_processes, 0, []
    calls = call_arcs(graph.edges)
    while start < total and long < 2 * max_processes:
        batch = ranked.filter(F.col("position").between(start, start + size - 1))
        found.append(staged(trace(batch, calls, max_depth, branching), "traces"))
        long += found[-1].filter(F.size("path") >= min_steps).count()
        start, size = start + size, size * 4
    traces = reduce(DataFrame.unionByName, found)
    kept = by_endpoints(drop_subsets(staged(long_enough(traces, entries, max_processes, min_steps), "long-traces")))
    top = staged(kept.orderBy(F.desc(F.size("path")), "path").limit(max_processes), "flows")
    own = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.size("path")), "path")) - 1)  # `max_processes` rows
    steps = own.select("position", "path", F.posexplode("path").alias("at", "id"))
    touched = steps.join(membership, "id").groupBy("position").agg(F.sort_array(F.collect_set("community_id")).alias("communities"))
    names = graph.nodes.select("id", "name")
    named = own.withColumns({"first": F.element_at("path", 1), "last": F.element_at("path", -1)})
    named = named.join(names.select(F.col("id").alias("first"), F.col("name").alias("first_name")), "first", "left").join(names.select(F.col("id").alias("last"), F.col("name").alias("last_name")), "last", "left").join(touched, "position", "left")
    a, b = F.coalesce("first_name", F.lit("?")), F.coalesce("last_name", F.lit("?"))
    pid = F.concat(F.lit("proc_"), "position", F.lit("_"), X.sanitize(a))
    title = F.concat(X.capitalize(a), F.lit(" -> "), X.capitalize(b))
    several = F.size(F.coalesce("communities", F.array())) > 1
    made = staged(
        named.select(pid.alias("id"), F.lit("Process").alias("label"), title.alias("name"), F.lit("").alias("file_path"), F.when(several, "cross_community").otherwise("intra_community").alias("process_type"), F.size("path").alias("step_count"), F.coalesce("communities", F.array().cast("array<string>")).alias("communities"), F.col("first").alias("entry_point_id"), F.col("last").alias("terminal_id"), "position", "path"),
        "processes",
    )
    edges = step_edges(made)
    stats = made.agg(F.count("*").alias("total_processes"), F.count_if(F.col("process_type") == "cross_community").alias("cross_community"), F.round(F.coalesce(F.avg("step_count"), F.lit(0.0)), 1).alias("avg_step_count")).first().asDict()
    return conform(made, NODES), edges, stats | {"entry_points_found": total}


def step_edges(flows: DataFrame) -> DataFrame:
    """STEP_IN_PROCESS edges, steps from 1. flows: id, path."""
    steps = flows.select(F.col("id").alias("process_id"), F.size("path").alias("n"), F.posexplode("path").alias("at", "node_id"))
    made = make_edges(steps.withColumn("step_no", F.col("at") + 1), F.col("node_id"), F.col("process_id"), "STEP_IN_PROCESS", 1.0, F.concat(F.lit("step "), F.col("step_no"), F.lit(" of "), F.col("n")))
    return made.withColumn("step", F.split("reason", " ")[1].cast("int"))
