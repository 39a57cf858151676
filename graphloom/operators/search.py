"""Ranked full-text search over names and paths: postings, BM25, phrases, and a small query language."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions.text import basename, tokens
from ..schema import is_symbol
from ..staging import staged
from .graph import substring_search

K1, B = 1.2, 0.75
FIELDS = ("name", "file_path", "file_name")


@dataclass(frozen=True)
class Index:
    """postings: field, token, node_id, tf, positions; lengths: field, node_id, length; stats: field, n, average; nodes: what hits show."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    nodes: DataFrame


def fields_of(nodes: DataFrame) -> DataFrame:
    """node_id, field, text of the symbols' indexed fields."""
    rows = nodes.filter(is_symbol(F.col("label"))).select(F.col("id").alias("node_id"), F.col("name"), F.col("file_path"), basename(F.col("file_path")).alias("file_name"))
    return rows.select("node_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in FIELDS])).alias("f")).select("node_id", "f.field", "f.text")


def build(nodes: DataFrame) -> Index:
    """The index of a graph's symbols; tables that may be written, or used as they are."""
    return build_over(fields_of(nodes), nodes)


def build_over(fields: DataFrame, nodes: DataFrame) -> Index:
    """fields: node_id, field, text."""
    # a written table: texts are cut once for postings, lengths and averages
    found = fields.select("node_id", "field", tokens(F.col("text")).alias("t"))
    cut = staged(found.withColumn("length", F.size("t").cast("long")), "tokens")
    lengths = cut.select("field", "node_id", "length")
    postings = cut.select("field", "node_id", F.posexplode("t").alias("position", "token")).groupBy("field", "token", "node_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    return Index(postings, lengths, stats, nodes)


@dataclass(frozen=True)
class Clause:
    tokens: tuple[str, ...]  # several: a phrase
    field: str | None = None
    must: bool = False
    must_not: bool = False


def parse(query: str) -> list[Clause]:
    """Words, "phrases", field:word, +must, -not, AND and OR; a word of several tokens is a phrase."""
    if query.count('"') % 2:
        raise SearchError("a quotation mark has no other")
    out: list[Clause] = []
    both = False
    for sign, field, phrase, word in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))', query):
        if not sign and not field and word in ("AND", "OR"):
            if not out:
                raise SearchError(f"{word} has nothing before it")
            if word == "AND":
                last = out.pop()
                out.append(Clause(last.tokens, last.field, not last.must_not, last.must_not))
                both = True
            continue
        if field and field not in FIELDS:
            raise SearchError(f"{field} is no field")
        found = tuple(t.lower() for t in re.findall(r"[^\W_]+", phrase or word) if len(t.encode()) < 40)
        if found:
            out.append(Clause(found, field or None, sign == "+" or (both and sign != "-"), sign == "-"))
        both = False
    return out


def _scored(index: Index, hits: DataFrame, df: DataFrame, on: list[str], weight: Column | None = None) -> DataFrame:
    """node_id, score. hits: field, node_id, tf and what df is counted by."""
    rows = hits.join(df, on).join(index.lengths, ["field", "node_id"]).join(index.stats, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return rows.groupBy("node_id").agg(F.sum(score if weight is None else score * weight).alias("score"))


def word_matches(index: Index, words: list[str]) -> DataFrame:
    """node_id, score of what has any of the words in any field: all words in one pass. A word that is asked for twice counts twice."""
    own = index.postings.filter(F.col("token").isin(*set(words)))
    df = own.groupBy("field", "token").agg(F.count("*").alias("df"))
    times = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, words.count(w))])
    return _scored(index, own.select("field", "token", "node_id", "tf"), df, ["field", "token"], times[F.col("token")])


def matches(index: Index, clause: Clause) -> DataFrame:
    """node_id, score of what has the clause's tokens, in a row if there are several; summed over the fields."""
    own = index.postings.filter(F.col("field").isin(*((clause.field,) if clause.field else FIELDS)) & F.col("token").isin(*clause.tokens))
    if len(clause.tokens) > 1:
        starts = None
        for k, t in enumerate(clause.tokens):
            part = own.filter(F.col("token") == t).select("field", "node_id", F.explode("positions").alias("p")).select("field", "node_id", (F.col("p") - k).alias("p"))
            starts = part if starts is None else starts.join(part, ["field", "node_id", "p"])
        hits = starts.groupBy("field", "node_id").agg(F.count("*").alias("tf"))
        return _scored(index, hits, hits.groupBy("field").agg(F.count("*").alias("df")), ["field"])
    df = own.groupBy("field", "token").agg(F.count("*").alias("df"))
    return _scored(index, own.select("field", "token", "node_id", "tf"), df, ["field", "token"])


def search(index: Index, query: str, limit: int = 10) -> DataFrame:
    """node_id, name, label, file_path, line, score, is_exported: the best `limit` by score, then id."""
    clauses = parse(query)
    wanted = [c for c in clauses if not c.must_not]
    spark = index.postings.sparkSession
    if not wanted:
        hits = spark.createDataFrame([], "node_id string, score double")
    else:
        words = [c.tokens[0] for c in wanted if len(c.tokens) == 1 and not c.field]
        parts = [matches(index, c) for c in wanted if len(c.tokens) > 1 or c.field] + ([word_matches(index, words)] if words else [])
        hits = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("node_id").agg(F.sum("score").alias("score"))
    for c in clauses:
        if c.must or c.must_not:
            hits = hits.join(matches(index, c).select("node_id"), "node_id", "left_anti" if c.must_not else "left_semi")
    top = hits.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node_id").limit(limit)
    shown = index.nodes.select(F.col("id").alias("node_id"), "name", "label", "file_path", F.col("start_line").alias("line"), "is_exported")
    return top.join(shown, "node_id").select("node_id", "name", "label", "file_path", "line", "score", "is_exported").orderBy(F.desc("score"), "node_id")


def query(nodes: DataFrame, index: Index, text: str, limit: int = 10, lenient: bool = True) -> DataFrame:
    """BM25, or names that contain the text when there is no hit (with `lenient` also when the query can't be read)."""
    try:
        found = search(index, text, limit)
        if not found.isEmpty():
            return found
    except SearchError:
        if not lenient:
            raise
    plain = substring_search(nodes, text, limit)
    return plain.select(F.col("id").alias("node_id"), "name", "label", "file_path", F.col("start_line").alias("line"), F.lit(0.0).alias("score"), "is_exported").orderBy("node_id")
