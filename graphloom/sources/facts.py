"""Parsing as a table function: files in, one row of facts for each file out."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ASSIGNMENTS, CALLS, HERITAGE, IMPORTS, NODES
from .scan import content_hash

KINDS = ("nodes", "imports", "calls", "heritage", "assignments")
PARSED = T.StructType(
    [T.StructField(n, k) for n, k in (("relative_path", T.StringType()), ("language", T.StringType()), ("hash", T.LongType()), ("facts", T.LongType()), ("error", T.StringType()))]
    + [T.StructField(n, T.ArrayType(s)) for n, s in zip(KINDS, (NODES, IMPORTS, CALLS, HERITAGE, ASSIGNMENTS), strict=True)]
)


def parse(files: DataFrame, registry: Callable | None = None) -> DataFrame:
    """relative_path, language, hash (null where `files` has none), facts (a hash of all facts), error, and the five kinds of facts.

    A file that can't be parsed has an error and no facts. registry: makes the parsers, in each worker.
    """

    def run(batches):
        import pyarrow as pa

        if registry is None:
            from .parsers import default_registry as make
        else:
            make = registry
        parsers = make()
        for b in batches:
            rows = []
            for path, data, language, hash_ in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                row = {"relative_path": path, "language": language, "hash": hash_, "error": None} | {k: [] for k in KINDS}
                try:
                    f = parsers.parse(path, data or b"")
                    row |= {k: getattr(f, k) for k in KINDS}
                except Exception as e:  # noqa: BLE001  one bad file doesn't end a job
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                row["facts"] = content_hash(repr([row[k] for k in KINDS]).encode())
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(PARSED)
    have = set(files.columns)
    more = [F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (("language", "string"), ("hash", "long"))]
    return files.select("relative_path", "content", *more).mapInArrow(run, PARSED)


def exploded(parsed: DataFrame) -> dict[str, DataFrame]:
    """The kinds of facts as tables; `ordinal` is a fact's place in its file, for what the last of several decides."""
    out = {}
    for name in KINDS:
        rows = parsed.select("relative_path", F.posexplode(name).alias("ordinal", "r"))
        out[name] = rows.select("r.*") if name == "nodes" else rows.select("relative_path", "ordinal", "r.*")
    return out
