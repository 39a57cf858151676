"""Benchmark passages in documents by Wu-Manber search over words.

Each window of consecutive item words is a pattern; an item with fewer words than a window is
one pattern of its own length. For each length there is a searcher: a shift table by blocks of
two words says how far the next possible end of a pattern lies, a block that may end a pattern
leads to the bucket of the patterns with that suffix and the block that they begin with, and words are compared
one by one. Clean text is read about once in every nine words.

Words are numbers and the tables sorted arrays, some 45 bytes for each benchmark word; they are built once in a
Python worker. A benchmark whose tables would be over `table_bytes` is searched in several passes over the
documents, each with a part of the items and with what the passes before it found, so that a worker
holds the tables of one part.

Defined results: null texts have no words; an item without words has no window; items with a null
id match, but aren't named; repeated items count once. Rows come back one for one; other
columns are ignored. An empty benchmark hits nothing.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, session_of, small_batches, staged, token

WINDOW = 10
#: Letters to lower case, other ASCII but digits to spaces; bytes of other characters stay.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of tables for a byte of benchmark text, by measurement; with it a pass's share of the items is chosen.
TABLE_FACTOR = 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Searcher:
    """Patterns of one length: windows of the items' numbered words."""

    def __init__(self, length: int, items: list, owners: list[int]):
        import numpy as np

        self.length, self.block = length, min(2, length)
        self.furthest = length - self.block + 1
        sizes = np.array([len(x) for x in items], np.int64)
        words = np.concatenate(items)
        first = np.cumsum(sizes) - sizes
        place = (np.arange(len(words)) - np.repeat(first, sizes)).astype(np.int32)  # of a word in its item
        every = words.astype(np.int64) if self.block == 1 else words[:-1].astype(np.int64) << 32 | words[1:]
        # a block's distance to the nearest end of a pattern: none from the length-th word on
        ends = np.flatnonzero(place >= self.block - 1)
        away = np.maximum(0, length - 1 - place[ends])
        keys, to = np.unique(every[ends - self.block + 1], return_inverse=True)
        shifts = np.full(len(keys), self.furthest, np.int8 if length < 128 else np.int32)
        np.minimum.at(shifts, to, away.astype(shifts.dtype))
        # buckets: windows by their last block, then their first
        starts = np.flatnonzero(place + length <= np.repeat(sizes, sizes))
        suffix, prefix = every[starts + length - self.block], every[starts]
        by = np.lexsort((prefix, suffix))
        # views that hand out plain numbers, for binary search
        view = lambda x: memoryview(np.ascontiguousarray(x))
        self.words, self.keys, self.shifts, self.suffix, self.prefix = memoryview(words), view(keys), view(shifts), view(suffix[by]), view(prefix[by])
        self.starts, self.owner = view(starts[by].astype(np.int32)), view(np.repeat(np.array(owners, np.int32), sizes)[starts[by]])

    def search(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of each occurrence in a text's words; number: the items' words."""
        n, length, b, far, keys, shifts, get = len(words), self.length, self.block, self.furthest, self.keys, self.shifts, number.get
        at, last = length, len(keys)  # at: the end, exclusive, of the window that is looked at
        while at <= n:
            end = get(words[at - 1])
            if end is not None and b == 2:
                before = get(words[at - 2])
                end = None if before is None else before << 32 | end
            if end is None or (k := bisect_left(keys, end)) == last or keys[k] != end:
                at += far
                continue
            if shifts[k]:
                at += shifts[k]
                continue
            start = at - length
            window = [get(w, -1) for w in words[start:at]]
            first = window[0] << 32 | window[1] if b == 2 else window[0]
            low, high = bisect_left(self.suffix, end), bisect_right(self.suffix, end)
            x, y = bisect_left(self.prefix, first, low, high), bisect_right(self.prefix, first, low, high)
            hit = [k for k in range(x, y) if self.words[self.starts[k] : self.starts[k] + length].tolist() == window]
            if hit:
                yield start, [self.owner[k] for k in hit]
            at += 1


class Patterns:
    """All searchers of some items. items: (id or None, text)."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import numpy as np

        self.number: dict[bytes, int] = {}
        self.names: list = []
        lengths: dict[int, tuple[list, list]] = {}
        give, seen = self.number.setdefault, set()
        for name, text in items:
            own = np.array([give(w, len(self.number)) for w in words_of(text)], np.int32)
            if not len(own) or (name, text) in seen:
                continue
            seen.add((name, text))
            self.names.append(name)
            texts, owners = lengths.setdefault(min(window, len(own)), ([], []))
            texts.append(own)
            owners.append(len(self.names) - 1)
        self.by_length = {n: Searcher(n, *lengths[n]) for n in sorted(lengths)}

    def mark(self, words: list[bytes], hit: bytearray, found: set) -> None:
        """Mark hit words; add the ids of items that occur (None for those without)."""
        for size, s in self.by_length.items():
            ones = b"\x01" * size
            for start, owners in s.search(words, self.number):
                hit[start : start + size] = ones
                found.update(self.names[o] for o in owners)

    def any(self, words: list[bytes]) -> bool:
        return any(next(s.search(words, self.number), None) is not None for s in self.by_length.values())


def _patterns(shared, window: int) -> Patterns:
    key, rows = shared.value
    return kept(("patterns", key, window), lambda: Patterns(rows, window))


def passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", table_bytes: int = 512 << 20) -> list:
    """Broadcasts of the items, a pass's each: their text is measured first, and each has about table_bytes / TABLE_FACTOR of it
    (one long item may be more)."""
    spark = session_of(benchmark)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * TABLE_FACTOR // table_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast((token(), [(r[0], r[1]) for r in part.collect()])))
    return out


_MARKS = "items array<string>, spans array<struct<first:int,last:int>>"


def _marked(docs: DataFrame, shared, window: int, with_text: bool) -> DataFrame:
    """docs: doc_id, text, n_words, items, spans; the last two with what these items add, and without the text after the last pass."""
    out = docs.schema if with_text else docs.drop("text").schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _patterns(shared, window)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            counts, items, spans = [], [], []
            for text, before, marks in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                words = words_of(text)
                hit, found = bytearray(len(words)), set(before)
                for m in marks:
                    hit[m["first"] : m["last"] + 1] = b"\x01" * (m["last"] + 1 - m["first"])
                own.mark(words, hit, found)
                counts.append(len(words))
                items.append(sorted(i for i in found if i is not None))
                spans.append(runs(hit))
            texts = [b.column(1)] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(0), *texts, pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], names)

    names = out.names
    return docs.mapInArrow(run, out)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, table_bytes: int = 512 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string> (sorted), spans array<struct<first, last>> (runs of hit words)."""
    small_batches(session_of(docs))
    nothing = [F.expr(f"cast(array() as {kind})").alias(name) for name, kind in (x.split(" ", 1) for x in _MARKS.split(", "))]
    now = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), *nothing)
    parts = passes(benchmark, table_bytes=table_bytes)
    for k, shared in enumerate(parts):
        now = _marked(now, shared, window, k + 1 < len(parts))
        if k + 1 < len(parts):
            now = staged(now, "marked")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return now.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def runs(hit: bytearray) -> list[dict]:
    """Runs of marked words, first and last."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append({"first": at, "last": end - 1})
        at = hit.find(1, end)
    return out


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = 512 << 20) -> DataFrame:
    """The documents, with all their columns, in which no window occurs. Several passes are filters in a row, with a table between."""
    small_batches(session_of(docs))
    where = docs.columns.index("text")

    def cleaned(now: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            own = _patterns(shared, window)
            for b in batches:
                yield b.filter(pa.array([not own.any(words_of(t)) for t in b.column(where).to_pylist()], pa.bool_()))

        return now.mapInArrow(run, now.schema)

    parts = passes(benchmark, table_bytes=table_bytes)
    for k, shared in enumerate(parts):
        docs = cleaned(docs, shared)
        if k + 1 < len(parts):
            docs = staged(docs, "clean")
    return docs
