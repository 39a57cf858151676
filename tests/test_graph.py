"""Graph store, traversal, search, analytics and diff on small graphs."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.errors import EngineError, SearchError
from graphloom.operators import analytics, diff, export, graph, resolve, search, traverse
from graphloom.operators.graph import Graph
from graphloom.schema import EDGES, NODES, conform


def nodes(spark, rows):
    """rows: dicts."""
    return conform(spark.createDataFrame([{"id": r["id"], "name": r.get("name", r["id"]), "label": r.get("label", "Function"), "file_path": r.get("file_path", "a.ts"), **r} for r in rows], "id string, name string, label string, file_path string, start_line int, end_line int, is_exported boolean, parameter_count int, return_type string, body_hash bigint, language string, container_name string"), NODES)


def edges(spark, rows):
    """rows: (source, relation, target[, confidence])."""
    made = [(f"{s}-[{r}]->{t}", s, t, r, c[0] if c else 0.9, "", None) for s, r, t, *c in rows]
    return spark.createDataFrame(made, EDGES)


@pytest.fixture(scope="module")
def chain(spark):
    return Graph(nodes(spark, [{"id": i} for i in "abc"]), edges(spark, [("a", "CALLS", "b"), ("b", "CALLS", "c")]))


KINDS, RELATIONS = ("Function", "Class", "Method", "File", "Enum"), ("CALLS", "USES", "CONTAINS")


def drawn(seed, n=40, m=120):
    """A drawn graph as plain rows: {id: (name, label, folder)} and a set of (source, relation, target); some ends have no node."""
    rng = random.Random(seed)
    own = {f"n{k}": (f"name{rng.randrange(9)}", rng.choice(KINDS), f"d{rng.randrange(5)}/x.go") for k in range(n)}
    every = [*own, "gone1", "gone2"]
    return own, {(rng.choice(every), rng.choice(RELATIONS), rng.choice(every)) for _ in range(m)}


def as_graph(spark, own, arrows):
    return Graph(nodes(spark, [{"id": i, "name": x, "label": label, "file_path": at} for i, (x, label, at) in own.items()]), edges(spark, sorted(arrows)))


@pytest.fixture(scope="module")
def plain():
    return drawn(1)


@pytest.fixture(scope="module")
def random_graph(spark, plain):
    return as_graph(spark, *plain)


def idset(df, column="id"):
    got = [r[column] for r in df.select(column).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_lookups_are_filters(plain, random_graph):
    own, arrows = plain
    t = graph.totals(random_graph).first()
    assert (t.node_count, t.edge_count, t.file_count) == (len(own), len(arrows), len({at for _, _, at in own.values()}))
    for label in KINDS:
        assert idset(graph.by_label(random_graph.nodes, label)) == {i for i, r in own.items() if r[1] == label}
    for at in ("d0/x.go", "d4/x.go", "nowhere"):
        assert idset(graph.in_file(random_graph.nodes, at)) == {i for i, r in own.items() if r[2] == at}
    for i in ("n0", "n7", "gone1", "nobody"):
        for rel in (None, *RELATIONS):
            assert idset(graph.outgoing(random_graph.edges, i, rel), "target_id") >= {t for s, r, t in arrows if s == i and r == rel} if rel else True
            assert graph.outgoing(random_graph.edges, i, rel).count() == sum(s == i and rel in (None, r) for s, r, _ in arrows)
            assert graph.incoming(random_graph.edges, i, rel).count() == sum(t == i and rel in (None, r) for _, r, t in arrows)


def test_upserts_are_dict_updates(spark, plain):
    own, _ = plain
    later = {f"n{k}": ("changed", "Class", f"new{k}.go") for k in range(20, 60)}
    got = graph.upsert(as_graph(spark, own, [("a", "USES", "b")]).nodes, as_graph(spark, later, [("a", "USES", "b")]).nodes)
    assert {r.id: (r.name, r.label, r.file_path) for r in got.collect()} == own | later
    rows = lambda pairs: spark.createDataFrame(pairs, "id string, source_id string, target_id string")
    assert sorted(map(tuple, graph.upsert(rows([("k", "p", "q"), ("l", "p", "r")]), rows([("k", "p", "z")])).collect())) == [("k", "p", "z"), ("l", "p", "r")]


def test_upsert_keeps_the_last_by_order(spark):
    rows = spark.createDataFrame([("x", 1, 1), ("x", 2, 3), ("x", 3, 2), ("y", None, 1)], "id string, v int, n int")
    got = graph.upsert(rows.select("id", "v").limit(0), rows, F.col("n"))
    assert sorted((r.id, r.v) for r in got.collect()) == [("x", 2), ("y", None)]


def test_removing_files_takes_their_nodes_and_all_edges_there(spark, plain, random_graph):
    own, arrows = plain
    gone = {"d1/x.go", "d3/x.go", "not/there.go"}
    left = graph.remove_files(random_graph, spark.createDataFrame([(p,) for p in gone], "file_path string"))
    dead = {i for i, r in own.items() if r[2] in gone}
    assert idset(left.nodes) == set(own) - dead
    assert {(r.source_id, r.rel_type, r.target_id) for r in left.edges.collect()} == {e for e in arrows if not {e[0], e[2]} & dead}


def walked(arrows, start, direction, depth):
    """node -> (depth, least shortest path), step by step."""
    ways = {("out", s, t) for s, _, t in arrows} | {("in", t, s) for s, _, t in arrows}
    ways = {(a, b) for w, a, b in ways if direction in (w, "both")}
    seen, front = {start: (0, [start])}, {start: [start]}
    for d in range(1, depth + 1):
        nxt = {}
        for a, b in ways:
            if a in front and b not in seen:
                nxt[b] = min(nxt.get(b, [chr(0x10FFFF)]), front[a] + [b])
        front = nxt
        seen |= {b: (d, p) for b, p in nxt.items()}
    return {b: x for b, x in seen.items() if b != start}


@pytest.mark.parametrize("direction, depth", [("out", 1), ("out", 4), ("in", 3), ("both", 2)])
def test_bfs_is_a_walk_by_hand(spark, direction, depth):
    own, arrows = drawn(depth, 60, 80)
    g = as_graph(spark, own, arrows)
    starts = ["n0", "n1", "gone1"]
    rows = traverse.bfs(g.edges, spark.createDataFrame([(s,) for s in starts], "id string"), direction, depth).collect()
    for s in starts:
        assert {r.node_id: (r.depth, r.path) for r in rows if r.start_id == s} == walked(arrows, s, direction, depth)
    short = traverse.bfs(g.edges, spark.createDataFrame([("n0",)], "id string"), direction, depth, with_paths=False).collect()
    assert {r.node_id: r.depth for r in short} == {n: d for n, (d, _) in walked(arrows, "n0", direction, depth).items()}


def test_bfs_both_ways(spark, chain):
    start = spark.createDataFrame([("b",)], "id string")
    assert {r.node_id for r in traverse.bfs(chain.edges, start, "both", 2).collect()} == {"a", "c"}
    assert {r.node_id for r in traverse.bfs(chain.edges, start, "both", 2, strict_reference=True).collect()} == {"c"}
    with pytest.raises(EngineError):
        traverse.bfs(chain.edges, start, "sideways", 2)


def test_bfs_goes_round_circles_once(spark):
    ring = edges(spark, [("a", "CALLS", "b"), ("b", "CALLS", "a"), ("b", "CALLS", "b")])
    assert [r.node_id for r in traverse.bfs(ring, spark.createDataFrame([("a",)], "id string"), "out", 9).collect()] == ["b"]


def test_impact_counts_dangling_hits(spark):
    g = Graph(nodes(spark, [{"id": "a"}]), edges(spark, [("ghost", "CALLS", "a"), ("other", "CONTAINS", "a")]))
    hits = traverse.impact(g, "a", "up").collect()
    assert [(h.node_id, h.label) for h in hits] == [("ghost", None)]
    assert traverse.impact_shown(traverse.impact(g, "a", "up")).count() == 0


def test_degrees_and_loops(spark):
    d = {r.id: (r.out_degree, r.in_degree, r.degree) for r in graph.degrees(edges(spark, [("a", "CALLS", "a"), ("a", "CALLS", "b")])).collect()}
    assert d == {"a": (2, 1, 3), "b": (0, 1, 1)}


# --- search ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def found(spark):
    rows = [("o1", "bakeBread", "Function", "shop/oven.go", 3, True), ("o2", "bakeCake", "Function", "shop/oven.go", 9, False), ("t1", "weighFlour", "Method", "shop/oven/scale.go", 2, False), ("c1", "Till", "Class", "front/desk/till.go", 1, True), ("c2", "openTill", "Method", "front/desk/till.go", 8, False), ("k1", "readMenu", "Function", "menu.go", 1, False)]
    own = nodes(spark, [dict(zip(("id", "name", "label", "file_path", "start_line", "is_exported"), r, strict=True)) for r in rows])
    return own, search.build(own)


def names(df):
    return [r.name for r in df.collect()]


def by_hand(rows, words):
    """BM25 over three fields, from the definition. rows: (id, name, path)."""
    cut = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    score = {}
    for field in ("name", "path", "file"):
        docs = {i: cut(n if field == "name" else p if field == "path" else p.rsplit("/", 1)[-1]) for i, n, p in rows}
        average = sum(map(len, docs.values())) / len(docs)
        for w in words:
            df = sum(w in t for t in docs.values())
            for i, t in docs.items():
                if tf := t.count(w):
                    score[i] = score.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
    return score


def test_search_scores(spark):
    rng = random.Random(6)
    some = ["oven", "till", "menu", "flour", "bread", "cake"]
    rows = [(f"s{k}", " ".join(rng.choices(some, k=rng.randint(1, 4))), "/".join(rng.choices(some, k=rng.randint(1, 3))) + ".go") for k in range(80)]
    index = search.build(nodes(spark, [{"id": i, "name": n, "file_path": p} for i, n, p in rows]))
    for words in (["oven"], ["till", "cake"], ["menu", "menu", "flour"], ["nothing"]):
        want = by_hand(rows, words)
        got = search.search(index, " ".join(words), 100).collect()
        assert {r.node_id: r.score for r in got} == {i: pytest.approx(x, abs=1e-5) for i, x in want.items()}
        assert [r.node_id for r in got] == [i for i, _ in sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))]


def test_search_language(found):
    own, index = found
    assert names(search.search(index, "oven -name:bakeBread -scale")) == ["bakeCake"]
    assert set(names(search.search(index, "+oven AND scale"))) == {"weighFlour"}
    assert set(names(search.search(index, '"front desk"'))) == {"Till", "openTill"}
    with pytest.raises(SearchError):
        search.parse('"never closed')
    assert names(search.query(own, index, '"ENUX')) == []
    assert names(search.query(own, index, "ADME")) == ["readMenu"]
    assert names(search.query(own, index, "keca")) == ["bakeCake"]


# --- analytics -------------------------------------------------------------------------------


def one_by_one(ties, resolution=1.0):
    """Louvain's local moves of one node after the other, until none helps: a division and its modularity."""
    near = {}
    for a, b in ties:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0) + 1
    k = {x: sum(n.values()) for x, n in near.items()}
    m2, home, sigma = sum(k.values()), {x: x for x in near}, dict(k)
    moved = True
    while moved:
        moved = False
        for x in sorted(near):
            links = {}
            for y, w in near[x].items():
                links[home[y]] = links.get(home[y], 0) + w
            own = home[x]
            sigma[own] -= k[x]
            best = max(sorted(links | {own: 0}), key=lambda c: links.get(c, 0) / m2 - resolution * k[x] * sigma[c] / (m2 * m2))
            if links.get(best, 0) / m2 - k[x] * sigma[best] / (m2 * m2) <= links.get(own, 0) / m2 - k[x] * sigma[own] / (m2 * m2) + 1e-12:
                best = own
            sigma[best] += k[x]
            moved |= best != own
            home[x] = best
    inside = sum(w for x, n in near.items() for y, w in n.items() if home[x] == home[y])
    return home, inside / m2 - resolution * sum(s * s for s in sigma.values()) / (m2 * m2)


@pytest.mark.parametrize("groups, size, inner, outer", [(2, 3, 1.0, 0.0), (6, 12, 0.5, 0.01), (10, 20, 0.3, 0.01)])
def test_communities_are_about_as_good_as_moves_one_by_one(spark, groups, size, inner, outer):
    rng = random.Random(groups)
    ids = [f"g{g}m{m:02}" for g in range(groups) for m in range(size)]
    ties = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if rng.random() < (inner if a[:-3] == b[:-3] else outer)]
    own = nodes(spark, [{"id": i, "file_path": f"src/{i.split('m')[0]}/{i}.go"} for i in ids])
    g = Graph(own, edges(spark, [(a, "CALLS", b) for a, b in ties]))
    community, near = analytics.louvain(g)
    assert analytics.modularity(near, community) >= one_by_one(ties)[1] - 0.05
    if not outer:
        found = {}
        for r in community.collect():
            found.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, found.values())) == [[i for i in ids if i.startswith(f"g{k}m")] for k in range(groups)]
        c_nodes, members, _ = analytics.communities(g)
        assert sorted((r.name, r.symbol_count, r.cohesion) for r in c_nodes.collect()) == [(f"G{k}", size, 1.0) for k in range(groups)]
        assert members.count() == len(ids)


def test_no_communities(spark):
    assert analytics.communities(Graph(nodes(spark, [{"id": "a"}]), edges(spark, [("a", "CALLS", "gone")])))[0].count() == 0


def traced(arcs, start, max_depth, branching, most):
    """Paths from a start, by hand: the least callees first, and the first paths of each length."""
    near = {}
    for a, b in sorted(set(arcs)):
        near.setdefault(a, []).append(b)
    done, live = [], [[start]]
    for _ in range(max_depth - 1):
        grown = []
        for p in live:
            nxt = [b for b in near.get(p[-1], []) if b not in p]
            if not nxt:
                done.append(p)
            grown += [p + [b] for b in nxt[:branching]]
        live = sorted(grown)[:most]
    for p in live:
        nxt = [b for b in near.get(p[-1], []) if b not in p]
        done += [p] if not nxt else []
    last = sorted(p + [b] for p in live for b in [b for b in near.get(p[-1], []) if b not in p][:branching])[:most]
    return sorted(done + last, key=lambda p: (len(p), p))[:most]


@pytest.mark.parametrize("depth, branching, most", [(3, 2, 500), (5, 3, 500), (4, 4, 6)])
def test_traces_are_paths_by_hand(spark, depth, branching, most):
    rng = random.Random(depth)
    arcs = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(45)] + [("n00", f"n{k:02}") for k in range(1, 14)]
    starts = ["n00", "n05", "alone"]
    got = analytics.trace(spark.createDataFrame([(s,) for s in starts], "id string"), spark.createDataFrame(arcs, "at string, to string"), depth, branching, most).collect()
    for s in starts:
        assert sorted(r.path for r in got if r.entry == s) == sorted(traced(arcs, s, depth, branching, most))


def test_processes(spark):
    steps = ["startShift", "heatOven", "kneadDough", "sellBread", "countTill"]
    ties = edges(spark, list(zip(steps, ["CALLS"] * 4, steps[1:], strict=False)))
    none = spark.createDataFrame([], "id string, community_id string")
    made, step_edges, stats = analytics.processes(Graph(nodes(spark, [{"id": s} for s in steps]), ties), none)
    first = made.first()
    assert (first.id, first.name, first.step_count, first.process_type) == ("proc_0_startShift", "StartShift -> CountTill", 5, "intra_community")
    assert sorted((r.step, r.source_id) for r in step_edges.collect()) == list(enumerate(steps, 1))
    assert stats["total_processes"] == 1 and stats["avg_step_count"] == 5.0
    tests = nodes(spark, [{"id": s, "file_path": f"shop/__tests__/{s}.spec.ts"} for s in steps])
    assert analytics.processes(Graph(tests, ties), none)[0].count() == 0


# --- diff ------------------------------------------------------------------------------------


def side(spark, files, symbols):
    own = [{"id": f"file::{p}", "name": p, "label": "File", "file_path": p} for p in files]
    own += [{"id": f"{p}::{n}::{line}", "name": n, "file_path": p, "start_line": line, "parameter_count": 1, "body_hash": h, "language": "typescript"} for p, n, line, h in symbols]
    return Graph(nodes(spark, own), edges(spark, [(f"file::{p}", "CONTAINS", f"{p}::{n}::{line}") for p, n, line, _ in symbols if n != "gone"])), spark.createDataFrame(list(files.items()), "file_path string, hash long")


def test_diff(spark):
    base, bh = side(spark, {"src/a.ts": 11, "src/old.ts": 22}, [("src/a.ts", "foo", 1, 100), ("src/old.ts", "bar", 1, 200), ("src/old.ts", "gone", 10, 300)])
    head, hh = side(spark, {"src/a.ts": 33, "src/new.ts": 44}, [("src/a.ts", "foo", 1, 101), ("src/new.ts", "bar", 1, 200), ("src/new.ts", "baz", 9, 500)])
    got = diff.diff(base, head, bh, hh)
    s = got["summary"].first()
    assert (s.files_added, s.files_removed, s.files_modified, s.files_unchanged) == (1, 1, 1, 0)
    assert (s.symbols_added, s.symbols_removed, s.symbols_modified, s.symbols_moved, s.symbols_unchanged) == (1, 1, 1, 1, 0)
    assert {r.canonical_id: r.status for r in got["records"].collect()} == {"src/a.ts::foo::1": "modified", "src/new.ts::bar::1": "moved", "src/new.ts::baz::9": "added", "removed::src/old.ts::gone::10": "removed"}
    again = diff.diff(base, base, bh, bh)["summary"].first().asDict()
    assert {k for k, v in again.items() if v} == {"base_ref", "head_ref", "files_unchanged", "symbols_unchanged"}


# --- resolution ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "from_file, spec, files, want",
    [
        ("src/index.ts", "./models/user", ["src/models/user.ts", "src/services/auth.ts", "src/index.ts"], "src/models/user.ts"),
        ("src/services/auth.ts", "../models/user", ["src/models/user.ts", "src/services/auth.ts"], "src/models/user.ts"),
        ("src/app.ts", "./models", ["src/models/index.ts", "src/app.ts"], "src/models/index.ts"),
        ("src/main.go", "./service", ["src/utils.ts", "src/service.go", "src/main.go", "src/repo.rs"], "src/service.go"),
        ("src/lib.rs", "./repo", ["src/repo.rs", "src/lib.rs"], "src/repo.rs"),
        ("src/app.ts", "./nonexistent", ["src/app.ts"], None),
        ("a/b.py", "pkg.mod", ["x/pkg/mod.py", "a/b.py"], "x/pkg/mod.py"),
        ("a/b.py", "pkg.mod", ["x/pkg/mod.py", "y/pkg/mod.py", "a/b.py"], None),
        ("a/b.ts", "../../../../up", ["up.ts", "a/b.ts"], "up.ts"),
        ("a/b.ts", " './c' ", ["a/c.tsx", "a/c/index.ts"], "a/c.tsx"),
        ("a/b.ts", "bad\x01path", ["badpath.ts"], None),
    ],
)
def test_imports(spark, from_file, spec, files, want):
    got = resolve.resolve_imports(spark.createDataFrame([(from_file, spec)], "from_file string, module_path string"), spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert [r.target for r in got] == ([want] if want else [])


def symbols(spark, rows):
    """rows: (name, file, label, exported, return type, start, end)."""
    made = [(f"{f}::{n}::{s}", n, label, f, "typescript", e, t, s, end) for n, f, label, e, t, s, end in rows]
    return spark.createDataFrame(made, "node_id string, name string, label string, file_path string, language string, is_exported boolean, return_type string, start_line int, end_line int")


BINDING = "file_path string, local_name string, source_path string, exported_name string"


def test_tiers(spark):
    own = symbols(spark, [("User", "src/models.ts", "Class", True, None, 1, 50), ("User", "lib/models.ts", "Class", True, None, 1, 50), ("Deep", "src/models/user.ts", "Class", True, None, 1, 50)])
    bound = spark.createDataFrame([("app.ts", "U", "src/models.ts", "User"), ("far.ts", "Deep", "src/models/index.ts", "Deep"), ("src/models/index.ts", "Deep", "src/models/user.ts", "Deep")], BINDING)
    imported = spark.createDataFrame([("main.ts", "src/models.ts")], "from_file string, target_file string")
    asked = spark.createDataFrame([("src/models.ts", "User"), ("main.ts", "User"), ("app.ts", "U"), ("far.ts", "Deep"), ("x.ts", "Deep"), ("x.ts", "User"), ("x.ts", "Nope")], "from_file string, name string")
    got = {(r.from_file, r.name): (r.tier, r.confidence, r.node_id, r.candidates) for r in resolve.resolve_names(asked, own, bound, imported).collect()}
    assert got == {
        ("src/models.ts", "User"): (1, 0.95, "src/models.ts::User::1", 1),
        ("main.ts", "User"): (3, 0.9, "src/models.ts::User::1", 1),
        ("app.ts", "U"): (2, 0.9, "src/models.ts::User::1", 1),
        ("far.ts", "Deep"): (2, 0.9, "src/models/user.ts::Deep::1", 1),
        ("x.ts", "Deep"): (5, 0.5, "src/models/user.ts::Deep::1", 1),
        ("x.ts", "User"): (5, 0.5, "lib/models.ts::User::1", 2),
    }


@pytest.mark.parametrize("hops, found", [(10, True), (11, False)])
def test_long_binding_chains(spark, hops, found):
    own = symbols(spark, [("X", "m99.ts", "Class", True, None, 1, 5)])
    files = [f"m{k}.ts" for k in range(hops + 1)] + ["m99.ts"]
    bound = spark.createDataFrame([(a, "X", b, "X") for a, b in zip(files, files[1:], strict=False)], BINDING)
    got = resolve.binding_targets(bound, own).filter("file_path = 'm0.ts'").collect()
    assert [r.hop for r in got] == ([hops] if found else [])


def test_binding_circle(spark):
    bound = spark.createDataFrame([("a", "X", "b", "X"), ("b", "X", "a", "X")], BINDING)
    assert resolve.binding_targets(bound, symbols(spark, [("Y", "a", "Class", True, None, 1, 5)])).count() == 0


def test_calls(spark):
    own = symbols(spark, [
        ("greet", "app.ts", "Function", True, None, 1, 3), ("User", "user.ts", "Class", True, None, 1, 20), ("save", "user.ts", "Method", False, None, 5, 6), ("Repo", "repo.ts", "Interface", True, None, 1, 9),
        ("store", "impl.ts", "Method", False, None, 4, 5), ("solo", "solo.ts", "Function", True, None, 1, 2), ("twice", "t1.ts", "Function", True, None, 1, 2), ("twice", "t2.ts", "Function", True, None, 1, 2), ("current", "app.ts", "Function", True, "User", 8, 9),
    ])
    bound = spark.createDataFrame([("app.ts", "User", "user.ts", "User"), ("app.ts", "r", "repo.ts", "Repo")], BINDING)
    imported = spark.createDataFrame([("app.ts", "user.ts")], "from_file string, target_file string")
    heritage = spark.createDataFrame([("c", "Repo", "Implements", "impl.ts")], "child_id string, parent_name string, kind string, file_path string")
    calls = [(1, "greet", None), (2, "User", None), (3, "save", "User"), (4, "store", "r"), (5, "solo", "what"), (6, "twice", None), (7, "twice", "what"), (8, "save", "current"), (9, "nowhere", "r")]
    made = spark.createDataFrame([(i, "me", n, r, "app.ts") for i, n, r in calls], "call_id long, caller_id string, callee_name string, receiver string, from_file string")
    got = {(r.call_id, r.target_id): (round(r.confidence, 6), r.reason) for r in resolve.resolve_calls(made, own, bound, imported, heritage).collect()}
    assert got == {
        (1, "app.ts::greet::1"): (0.95, "same-file call"),
        (2, "user.ts::User::1"): (0.9, "import-scoped call"),
        (3, "user.ts::save::5"): (0.9, "receiver-typed method call"),
        (4, "impl.ts::store::4"): (0.7, "interface-dispatch"),
        (5, "solo.ts::solo::1"): (0.4, "untyped method call"),
        (8, "user.ts::save::5"): (0.9, "receiver-typed method call"),
    }


def test_heritage(spark):
    own = symbols(spark, [("Base", "a.ts", "Class", True, None, 1, 5), ("Serializable", "i.ts", "Interface", True, None, 1, 5), ("Twice", "x.ts", "Interface", True, None, 1, 2), ("Twice", "y.ts", "Class", True, None, 1, 2)])
    bound = spark.createDataFrame([("u.ts", "Serializable", "i.ts", "Serializable")], BINDING)
    none = spark.createDataFrame([], "from_file string, target_file string")
    rows = [("a.ts::Child::9", "Base", "Extends", "a.ts"), ("u.ts::User::1", "Serializable", "Implements", "u.ts"), ("z", "ExternalBase", "Extends", "u.ts"), ("q", "Twice", "Extends", "u.ts"), ("s", "Serializable", "Extends", "u.ts")]
    got = {r.child_id: (r.parent_id, r.rel_type, r.confidence) for r in resolve.resolve_heritage(spark.createDataFrame(rows, "child_id string, parent_name string, kind string, file_path string"), own, bound, none).collect()}
    assert got["a.ts::Child::9"] == ("a.ts::Base::1", "EXTENDS", pytest.approx(0.95))
    assert got["u.ts::User::1"] == ("i.ts::Serializable::1", "IMPLEMENTS", pytest.approx((0.95 * 0.9) ** 0.5))
    assert got["z"] == ("Class::ExternalBase", "EXTENDS", pytest.approx((0.95 * 0.5) ** 0.5))
    assert got["q"][:2] == ("Class::Twice", "IMPLEMENTS")
    assert got["s"][:2] == ("i.ts::Serializable::1", "IMPLEMENTS")


def test_types(spark):
    env = spark.createDataFrame([("f.ts", "x", "File"), ("f.ts::g", "x", "Own")], "scope string, variable string, type_name string")
    asked = spark.createDataFrame([("f.ts::g", "x"), ("f.ts::h", "x"), ("f.ts", "x"), ("other.ts", "x")], "scope string, variable string")
    got = {r.scope: r.type_name for r in resolve.lookup_types(asked, env).collect()}
    assert got == {"f.ts::g": "Own", "f.ts::h": "File", "f.ts": "File", "other.ts": None}
    a = "scope string, variable string, kind string, source string, ordinal long"
    fns = spark.createDataFrame([("getUser", "User")], "name string, type_name string")
    rows = [("f.ts", "user", "FunctionCall", "getUser", 1), ("f.ts", "name", "Variable", "user", 2), ("f.ts", "late", "Variable", "never", 3)]
    known, rounds = resolve.propagate_types(spark.createDataFrame(rows, a), env.limit(0), fns)
    assert {r.variable: r.type_name for r in known.collect()} == {"user": "User", "name": "User"}
    assert rounds == 3
    assert resolve.propagate_types(spark.createDataFrame([("f.ts", "user", "Constructor", "User", 1)], a), env.limit(0), fns)[1] == 2


def test_enclosing_needs_no_nested_loop(spark):
    calls = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 5)], "call_id long, file_path string, line int")
    defs = spark.createDataFrame([("wide", "a", 1, 20, 0), ("narrow", "a", 4, 6, 1), ("tie", "a", 4, 6, 2)], "id string, file_path string, start_line int, end_line int, ordinal int")
    got = resolve.enclosing(calls, defs)
    assert {r.call_id: r.caller_id for r in got.collect()} == {1: "narrow", 2: "a::__module__", 3: "b::__module__"}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


# --- exports ---------------------------------------------------------------------------------


def test_exports(spark, chain):
    text = export.dot_text(chain)
    assert 'a [label="a\\n(Function)", fillcolor="#FFB74D"];' in text and "a -> b [color=red" in text
    page = export.html_text(chain, 2)
    assert "2 symbols | 1 connections" in page
    assert export.viewer_search(chain.nodes, "a").count() == 0
