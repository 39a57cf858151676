"""What the findings of round 2 named, on small tables."""
import json
import re

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.operators import resolve
from graphloom.plans import source_queries, system_queries
from graphloom.plans.bench_views import Views
from graphloom.plans.queries import ORACLES, QUERIES
from graphloom.staging import staged


@pytest.fixture
def folder(spark, tiny, tmp_path):
    """A folder of the smallest tables, some of them in the place of the given ones."""

    def make(**tables):
        for name in oracle.TABLES:
            if name not in tables:
                (tmp_path / f"{name}.parquet").symlink_to(f"{tiny}/{name}.parquet")
        for name, df in tables.items():
            import pyarrow.parquet as pq

            pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


def same_as_sql(spark, at, name):
    return oracle.differences(QUERIES[name](spark, at), oracle.connect(at), ORACLES[name]) == []


def test_types_that_go_round(spark):
    """four variables that are assigned in a circle, each with a type before; a round moves every type one on."""
    own = [("f", f"v{k}", "Constructor", "ABCD"[k], k) for k in range(4)]
    moved = [("f", f"v{k}", "Variable", f"v{(k + 1) % 4}", 4 + k) for k in range(4)]
    rows = spark.createDataFrame(own + moved, "scope string, variable string, kind string, source string, ordinal int")
    none = spark.createDataFrame([], "scope string, variable string, type_name string")
    fns = spark.createDataFrame([], "name string, type_name string")
    got, took = resolve.propagate_types(rows, none, fns, max_rounds=6)
    assert took == 6
    assert {r.variable: r.type_name for r in got.collect()} == {f"v{k}": "ABCD"[(k + 5) % 4] for k in range(4)}


def test_type_rounds_of_many_events(spark, tiny, folder):
    """events of one user, so that variables have many assignments and circles arise."""
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "error")])
    rows = spark.read.parquet(f"{tiny}/events.parquet")
    made = spark.range(12000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.element_at(kinds, (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("event_type"))
    more = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in made.columns]
    assert same_as_sql(spark, folder(events=made.select("*", *more).select(*rows.columns)), "r24_type_fixpoint")


def test_viewer_without_links(spark, tiny, folder):
    """F8: no two of the viewer's nodes are linked."""
    none = {t: spark.read.parquet(f"{tiny}/{t}.parquet").limit(0) for t in ("customer", "orders", "lineitem")}
    at = folder(**none)
    assert same_as_sql(spark, at, "k10_viewer_links")
    assert QUERIES["k10_viewer_links"](spark, at).isEmpty()


def test_sources_are_dealt_out(spark, tiny, folder):
    """A small file of many parts is one task for Spark, and its texts are many seconds of parsing."""
    parts = spark.read.parquet(f"{tiny}/part.parquet")
    many = spark.range(9000).select(F.col("id").alias("p_partkey"), *[F.lit(None).cast(t).alias(c) for c, t in parts.dtypes if c != "p_partkey"])
    v = Views(spark, folder(part=many))
    assert v.part.rdd.getNumPartitions() == 1
    own = source_queries.sources(v, {"rs/f§.rs": source_queries.TEXTS["rs/f§.rs"]})
    sizes = own.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 9000
    assert max(r["count"] for r in sizes) <= source_queries.FILES_OF_A_TASK


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_similar_texts_of_one_component(spark, shard_rows):
    """1 and 2 are alike and share no band; 3, unlike both, connects them. The component counts as large with 16 rows a shard."""
    words = lambda *x: np.array(x, np.uint32).tobytes()
    rows = [(1, bytes(32), [1, 2], words(*range(20))), (2, bytes(31) + b"\x03", [3, 4], words(*range(19))), (3, bytes(31) + b"\x01", [1, 4], words(*range(100, 120)))]
    fps = spark.createDataFrame(rows, "doc_id long, fp binary, keys array<bigint>, shingles binary")
    got = simhash.similar_components(fps, shard_rows=shard_rows).collect()
    assert sorted((bytes(r.fp)[-1], r.component_id) for r in got) == [(0, 1), (1, 3), (3, 1)]


def test_calls_are_settled_by_key(spark, tiny, monkeypatch):
    """what is written on the way is of files, receivers and names; calls with their targets are many more rows."""
    written = []
    monkeypatch.setattr(resolve, "staged", lambda df, label: (written.append(df.columns), staged(df, label))[1])
    QUERIES["r18_calls"](spark, tiny)
    assert written and not [c for c in written if "call_id" in c]


def test_callers_are_found_by_line(spark):
    """F16: definitions meet lines, not calls."""
    calls = spark.range(50).selectExpr("id as call_id", "if(id = 49, 'g', 'f') as file_path", "cast(id % 2 as int) + 1 as line")
    defs = spark.createDataFrame([("wide", "f", 1, 9, "a"), ("narrow", "f", 2, 2, "b")], "id string, file_path string, start_line int, end_line int, ordinal string")
    got = resolve.enclosing(calls, defs)
    assert {r.call_id: r.caller_id for r in got.collect()} == {k: "g::__module__" if k == 49 else "narrow" if k % 2 else "wide" for k in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[file_path#\d+, line#\d+\]", plan)


def test_imports_are_made_once(spark):
    """specifiers and the imports that they settle come from one written table."""
    imports = spark.range(20).selectExpr("'a/f' || id || '.ts' as from_file", "'./f' || (id + 1) as module_path")
    got = resolve.resolve_imports(imports, spark.createDataFrame([("a/f3.ts",), ("a/f7.ts",)], "path string"))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.collect()) == [("a/f2.ts", "./f3", "a/f3.ts"), ("a/f6.ts", "./f7", "a/f7.ts")]


def test_document_of_lines(tmp_path):
    """a JSON document from files of lines, none of which the driver holds."""
    for part, files in {"nodes": ['{"a": 1}\n{"a": 2}\n', "", '{"a": 3}\n'], "edges": [""], "file_hashes": ['"x": 18446744073709551615\n']}.items():
        (tmp_path / part).mkdir()
        for k, text in enumerate(files):
            (tmp_path / part / f"part-{k}.txt").write_text(text)
    system_queries.write_document(tmp_path / "g.json", tmp_path, {"nodes": "[]", "edges": "[]", "file_hashes": "{}"})
    assert json.loads((tmp_path / "g.json").read_text()) == {"version": 1, "nodes": [{"a": 1}, {"a": 2}, {"a": 3}], "edges": [], "file_hashes": {"x": 2**64 - 1}}
