"""The queries of the text operators, each over its whole table with production parameters, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, licenses, pii, quality, quality_rules, secrets_scan, shard, simhash, sql, toxicity
from .common import fold_of, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the score of each view."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "content_score", "metadata_score"
    )


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard.shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets_scan.BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets_scan.joined(base), 256).alias("base_sha256"), secrets_scan.joined(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = [*pii.BASE_KINDS, *(k for k in pii.CRF_KINDS if k not in pii.BASE_KINDS)]
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *map(n, pii.BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"], x["missing"], x["more"])), ",").alias("notices"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_quality, op2_bpe, op3_simhash, op4_decontamination, op5_sharding, op6_secrets, op7_pii, op8_licenses, op9_quality_rules, op10_toxicity]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


# Words, windows and marks as the contract of op4 says. Positions are counted within a document row.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(k) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT rid, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM d, ms, unnest(generate_series(1, len(w) - m + 1)) AS t(k) WHERE len(w) >= m),
hit AS (SELECT rid, k, dw.m, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
marks AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, k, m FROM hit) h, unnest(generate_series(k, k + m - 1)) AS t(p) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN found USING (rid)
"""


def _secrets_sql() -> str:
    """The spans of each rule from its matches and the gaps between them, as the contract of op6 says.

    Where all that a rule asks for is a run of some length, the run's length is in the pattern: the rows
    are the same, and single letters of prose are no matches.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    longer = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}
    parts = []
    for k, r in enumerate(secrets_scan.RULES):
        regex = quoted(longer.get(r.kind, r.regex))
        kept = f"regexp_extract_all(t, {regex}, {r.keep_group})"
        parts.append(f"SELECT rid, {k} AS rank, '{r.kind}' AS kind, {r.keep_chars} AS least, regexp_extract_all(t, {regex}) AS found, {kept} AS kept, regexp_split_to_array(t, {regex}) AS gaps FROM d WHERE regexp_matches(t, {regex})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT rid, rank, kind, least, length(found[k]) AS n, length(kept[k]) AS kn, CAST(sum(length(gaps[k]) + length(found[k])) OVER (PARTITION BY rid, rank ORDER BY k) AS BIGINT) AS e FROM m, unnest(generate_series(1, len(found))) AS g(k)),
s AS (SELECT rid, rank, e - n AS b, kind || ':' || (e - n) || ':' || e AS span FROM p WHERE kn >= least),
o AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h, string_agg(span, ',' ORDER BY b, rank) FILTER (rank < {len(secrets_scan.BASE)}) AS base, string_agg(span, ',' ORDER BY b, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_simhash": sql.simhash(), "op4_decontamination": _OP4, "op5_sharding": sql.sharding(), "op6_secrets": _secrets_sql()}
