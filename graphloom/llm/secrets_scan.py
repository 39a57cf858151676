"""Secrets by regular expressions behind a trigram index, in DataFrame expressions only.

From each rule's regex a Boolean query over trigrams is derived: what every match must
contain. The index is a table of postings (trigram, key of a row) of the trigrams that some rule asks for. Postings are
merged by key into masks, on which each rule's query is an AND and OR of bits; the keys that pass are the rule's
candidates. Candidates are joined to the texts (by the candidates' measured size Spark broadcasts them or deals out both sides) and
searched with the regex; rules whose query is empty search every row, without the index.

Positions: the parts between matches (split by the same regex) and the matches alternate, so a
running sum of their lengths in code points gives each match's start. Sums are made in two steps, so
that a text with very many matches costs little more than these.

Defined results: null texts count as empty; rows come back one for one; other columns are ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, staged


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # Java's and Python's syntax; ASCII case folding by (?i)
    keep_group: int = 0  # a match counts if this group has `keep_chars` characters
    keep_chars: int = 0


# The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

# --- Boolean trigram queries -------------------------------------------------------------

ANY = ("and",)  # true of every text

#: The most strings that a part of a regex is spelled out into, and letters that a class is.
SPELL, CLASS = 64, 6


def _and(*parts):
    flat = [q for p in parts for q in (p[1:] if p[0] == "and" else (p,))]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*parts):
    if any(p == ANY for p in parts):
        return ANY
    flat = list(dict.fromkeys(q for p in parts for q in (p[1:] if p[0] == "or" else (p,))))
    # what asks for more than another alternative adds nothing
    flat = [q for q in flat if not any(o is not q and _demands(o) < _demands(q) for o in flat)]
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _demands(query) -> set:
    return set(query[1:]) if query[0] == "and" else {query}


def _of_strings(strings: set[str]):
    """What holds if one of the strings occurs."""
    return _or(*[_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else ANY


def trigram_query(regex: str, fold: bool = True):
    """A query ("tri", t) | ("and", ...) | ("or", ...) that every text with a match satisfies; ANY if nothing is mandatory.

    Trigrams are in lower case if `fold`: the index is built over lower-cased text.
    """
    from re import _constants as c
    from re import _parser

    tree = _parser.parse(regex)

    def letters(op, arg) -> set[str] | None:
        if op is c.LITERAL:
            found = {chr(arg)}
        elif op is c.IN and len(arg) <= CLASS and all(o is c.LITERAL for o, _ in arg):
            found = {chr(a) for _, a in arg}
        else:
            return None
        return {x.lower() for x in found} if fold else found

    def walk(nodes):
        """(the query of closed parts, the strings of a sequence that can be spelled out or None)"""
        query, run = ANY, {""}

        def close():
            nonlocal query, run
            query, run = _and(query, _of_strings(run)), {""}

        for op, arg in nodes:
            one = letters(op, arg)
            if one is None and op is c.SUBPATTERN:
                sub, spelled = walk(arg[-1])
                query, one = _and(query, sub), spelled
            elif one is None and op is c.BRANCH:
                each = [walk(x) for x in arg[1]]
                if all(s is not None for _, s in each) and all(q == ANY for q, _ in each):
                    one = set().union(*[s for _, s in each])
                else:
                    query = _and(query, _or(*[_and(q, _of_strings(s or set())) for q, s in each]))
            elif one is None and op in (c.MAX_REPEAT, c.MIN_REPEAT, getattr(c, "POSSESSIVE_REPEAT", None)):
                low, high, sub = arg
                q, spelled = walk(sub)
                if high == 1 and spelled is not None and q == ANY:
                    one = spelled | {""} if low == 0 else spelled
                elif low:
                    query = _and(query, q, _of_strings(spelled or set()))
            elif op is c.AT:
                continue
            if one is None:
                close()
                continue
            longer = {a + b for a in run for b in one}
            if len(longer) > SPELL:
                close()
                longer = set(one)
                if len(longer) > SPELL:
                    longer = {""}
            run = longer
        if query == ANY:
            return ANY, run
        return _and(query, _of_strings(run)), None

    def whole(nodes):
        q, spelled = walk(nodes)
        return _and(q, _of_strings(spelled)) if spelled is not None else q

    return whole(tree)


def trigrams(query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(q) for q in query[1:]], set())


class Plan:
    """The rules with their queries, and each trigram's place in a mask of words of 60 bits."""

    WORD = 60

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.regex) for r in rules]
        self.place = {t: i for i, t in enumerate(sorted(set().union(*[trigrams(q) for q in self.queries], set())))}
        self.words = -(-max(1, len(self.place)) // self.WORD)

    def masks(self, trigram: Column) -> list[Column]:
        """For each word, the bits of the trigrams that a group of postings has: an aggregate."""
        at = F.create_map(*[F.lit(x) for t, i in (self.place or {"": 0}).items() for x in (t, i)])[trigram]
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(self.WORD)))
        zero = F.lit(0).cast("bigint")
        return [F.bit_or(F.when(F.floor(at / self.WORD) == w, bit).otherwise(zero)).alias(f"m{w}") for w in range(self.words)]

    def passes(self, query, masks: list[Column]) -> Column:
        """Whether the trigrams in the masks satisfy a query."""
        if query[0] == "tri":
            return self.passes(("and", query), masks)
        parts = [self.passes(q, masks) for q in query[1:] if q[0] != "tri"]
        if query[0] == "or":
            parts += [self.passes(("and", q), masks) for q in query[1:] if q[0] == "tri"]
            return reduce(lambda a, b: a | b, parts)
        wanted: dict[int, int] = {}
        for q in query[1:]:
            if q[0] == "tri":
                i = self.place[q[1]]
                wanted[i // self.WORD] = wanted.get(i // self.WORD, 0) | 1 << (i % self.WORD)
        parts += [masks[w].bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint") for w, m in sorted(wanted.items())]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (nulls empty), key: rows with one key have, all but surely, one id and text, and where not, a row is verified in vain."""
    src = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return src.withColumn("key", F.xxhash64("doc_id", "text"))


def index(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """trigram, key: the postings of the trigrams that the rules ask for."""
    rows = _keyed(docs, id_col, text_col).select("key", F.lower("text").alias("lowered"))
    has = [F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in plan.place]
    return rows.select(F.explode(F.array_compact(F.array(*has))).alias("trigram"), "key") if has else rows.select(F.lit("").alias("trigram"), "key").limit(0)


def candidates(postings: DataFrame, plan: Plan) -> DataFrame:
    """key, rules: a bit for each rule whose query the key's postings satisfy; keys without any are left out.

    Postings are merged by key, with partial masks before the shuffle, so no posting list is in one place.
    """
    met = postings.groupBy("key").agg(*plan.masks(F.col("trigram")))
    masks = [F.col(f"m{w}") for w in range(plan.words)]
    zero = F.lit(0).cast("bigint")
    rules = [F.when(plan.passes(q, masks), F.lit(1 << k).cast("bigint")).otherwise(zero) for k, q in enumerate(plan.queries) if q != ANY]
    return met.select("key", reduce(lambda a, b: a.bitwiseOR(b), rules, zero).alias("rules")).filter("rules <> 0")


def searched(rule: Rule) -> str:
    """The regex that is searched with. Where a match counts by its length alone, and ends in a run of one class, the least
    length of the run is in the regex: a shorter run has no longer one in it, so the matches that count are the same."""
    head = re.fullmatch(r"(\w*)(\[[^\]]*\])\+", rule.regex)
    if head and rule.keep_chars > len(head[1]) and not rule.keep_group:
        return f"{head[1]}{head[2]}{{{rule.keep_chars - len(head[1])},}}"
    return rule.regex


#: Lengths that are summed up in one go; sums of such runs are then added, so that no step copies all that is before it.
RUN = 256


def _with_ends(rows: DataFrame, lengths: dict[str, str]) -> DataFrame:
    """For each column of lengths (name -> new name) an array of running sums."""
    at = lambda total, out: F.struct(total.alias("total"), out.alias("out"))
    none = F.array().cast("array<int>")

    def runs(c):
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int"))), lambda k: F.slice(c, k * RUN + 1, RUN))
        return F.transform(cut, lambda r: F.aggregate(r, at(F.lit(0), none), lambda acc, x: at(acc["total"] + x, F.concat(acc["out"], F.array(acc["total"] + x)))))

    rows = rows.withColumns({f"{new}_runs": runs(old) for old, new in lengths.items()})
    before = lambda c: F.aggregate(c, at(F.lit(0), none), lambda acc, r: at(acc["total"] + r["total"], F.concat(acc["out"], F.array(acc["total"]))))["out"]
    rows = rows.withColumns({f"{new}_before": before(f"{new}_runs") for new in lengths.values()})
    joined = lambda new: F.flatten(F.zip_with(f"{new}_runs", f"{new}_before", lambda r, b: F.transform(r["out"], lambda x: x + b)))
    return rows.withColumns({new: joined(new) for new in lengths.values()}).drop(*[f"{new}_{x}" for new in lengths.values() for x in ("runs", "before")])


def _named(spans: Column, rank: int, rule: Rule) -> Column:
    """The spans that count, as they are returned."""
    good = F.filter(spans, lambda s: s["kept"] >= rule.keep_chars)
    return F.transform(good, lambda s: F.struct((s["end"] - s["len"]).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<start, rank, end, kind>> by start, then rule. A rule is searched for in its candidates; one without a query in every row."""
    plan = Plan(rules)
    found = staged(candidates(staged(index(docs, plan, id_col, text_col), "postings"), plan), "candidates")
    rows = _keyed(docs, id_col, text_col).join(found, "key", "left").drop("key")
    text, size = F.col("text"), lambda c: F.transform(c, lambda x: F.char_length(x))
    numbers = range(len(rules))
    tests = [F.rlike(text, F.lit(searched(r))) if q == ANY else F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k).cast("bigint")) != 0 for k, (r, q) in enumerate(zip(rules, plan.queries, strict=True))]
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"found{k}": F.when(tests[k], F.regexp_extract_all(text, F.lit(searched(r)), F.lit(0))).otherwise(none) for k, r in enumerate(rules)})
    # the parts between matches and the matches alternate; what is asked of is that there is a match
    some = lambda k, c: F.when(F.size(f"found{k}") > 0, c).otherwise(F.array().cast("array<int>"))
    lengths = {f"len{k}": size(F.col(f"found{k}")) for k in numbers}
    gaps = {f"gap{k}": some(k, size(F.split(text, searched(r), -1))) for k, r in enumerate(rules)}
    kept = {f"kept{k}": some(k, size(F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.keep_group)))) for k, r in enumerate(rules) if r.keep_group}
    rows = rows.withColumns(lengths | gaps | kept).drop("text", "rules", *[f"found{k}" for k in numbers])
    rows = rows.withColumns({f"step{k}": F.zip_with(F.slice(f"gap{k}", 1, F.size(f"len{k}")), f"len{k}", lambda g, n: g + n) for k in numbers})
    rows = _with_ends(rows, {f"step{k}": f"end{k}" for k in numbers})
    each = []
    for k, r in enumerate(rules):
        spans = F.arrays_zip(F.col(f"end{k}").alias("end"), F.col(f"len{k}").alias("len"), F.col(f"kept{k}" if r.keep_group else f"len{k}").alias("kept"))
        each.append(_named(spans, k, r))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
