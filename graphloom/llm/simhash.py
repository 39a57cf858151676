"""Near duplicates by SimHash, found with BK-trees.

Fingerprints within `radius` bits of each other are linked; a component is what links
reach. Every two fingerprints within the radius agree on at least `m` of `radius + m`
blocks of bits, so for each choice of m blocks the distinct fingerprints are dealt out
by the bits in them (a shard), and each shard is searched with a BK-tree: a child
hangs below its parent by its Hamming distance to it, and a search follows only the
edges within the radius of its own distance. m grows with the number of distinct
fingerprints, so that a shard holds a few of them at any size; each m finds all links.

The trees are built where their shard is, not broadcast: all trees together grow with the
corpus. A search skips subtrees whose members are all in its own component already, so a
dense group costs about its size, and a shard emits one link for each member at most. A
shard over `shard_rows` is dealt out by further bits; what is still over it is cut into blocks, and each pair of blocks becomes a task.

`near_duplicates` links 64-bit fingerprints over shingles of four words within 4 bits. `deduplicated` takes documents of a
similarity of 0.8 or more over five words: these differ in ten bits of 64 on average, too many for blocks to agree on, so it
takes fingerprints of 256 bits, a shard is what shares the least hashes of its shingles in a band, and the shingles of what the trees
find are compared in the end.

Components come from rounds of large and small stars over written tables.

Defined results: null and empty texts (and texts of white space) have fingerprint zero and
are linked like any others. Repeated rows come back repeated. Null ids count as larger than any
id; a component of null ids only has component_id null. Empty tables give empty tables;
other columns are ignored.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import alone, discard, id_and_text, session_of, small_batches, staged

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED, SHINGLE, RADIUS, BITS = 42, 4, 4, 64
#: Rows that one tree is built of. A shard with more is dealt out further, and then cut into pairs of blocks.
SHARD_ROWS, SHARD_BYTES = 4096, 64 << 20
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    import numpy as np
    import xxhash

    own = (text or "").encode().translate(LOWER).split()
    if not own:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(own) < words:
        return hashed(b" ".join(own), SEED)
    line = b" ".join(own)
    starts = [0]
    at = 0
    for w in own:
        at += len(w) + 1
        starts.append(at)
    n = len(own) - words + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, SLICE):
        stop = min(n, k + SLICE)
        h = np.fromiter((hashed(line[a : b - 1], SEED) for a, b in zip(starts[k:stop], starts[k + words : stop + words], strict=True)), dtype=">u8", count=stop - k)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


# --- similarity of shingles ------------------------------------------------------------------

WIDE_WORDS, WIDE_BITS, WIDE_RADIUS, BANDS, BAND_ROWS = 5, 256, 46, 12, 5


def mixed(h):
    """An array of 64-bit numbers, each mixed into another (two multiplications and shifts)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _factors():
    """An odd number for each row of each band."""
    import numpy as np

    return mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(SEED * 2 + 1)) | np.uint64(1)


def wide(text: str | None, words: int = WIDE_WORDS) -> tuple[bytes, list[int], bytes]:
    """A fingerprint of 256 bits over the distinct shingles, the numbers of the bands' shards, and the shingles (32 bits each, sorted).

    A band's number is made of the least of the shingles' hashes under `BAND_ROWS` orders, so texts meet in a
    band's shard with the probability similarity ** BAND_ROWS.
    """
    import numpy as np
    import xxhash

    own = (text or "").encode().translate(LOWER).split()
    if not own:
        return bytes(WIDE_BITS // 8), [0] * BANDS, b""
    hashed = xxhash.xxh64_intdigest
    line = b" ".join(own)
    ends, at = [], -1
    for w in own:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    h = np.unique(np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)) if len(own) >= words else [hashed(line, SEED)], np.uint64))
    counts = np.zeros(WIDE_BITS, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), SLICE):
        part = h[k : k + SLICE]
        lanes = np.stack([part, *(mixed(part ^ np.uint64(x)) for x in range(1, WIDE_BITS // 64))], axis=1)
        counts += np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
        np.minimum(least, (part[:, None] * _factors()[None, :]).min(axis=0), out=least)
    bands = [hashed(b.tobytes(), SEED) for b in least.reshape(BANDS, BAND_ROWS)]
    return np.packbits(counts * 2 > len(h)).tobytes(), [x - (1 << 64) if x >> 63 else x for x in bands], np.unique(h.astype(np.uint32)).tobytes()


# --- fingerprints of documents -----------------------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed), one row for each input row."""
    small_batches(session_of(docs))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        alone()
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, fp bigint")


class BKTree:
    """Fingerprints by Hamming distance, with the components of what was added so far."""

    def __init__(self, radius: int, similarity: float = 0.0):
        self.radius, self.similarity = radius, similarity
        self.sets: list = []  # of shingles, where a link needs a similarity beside the distance
        self.fp: list[int] = []
        self.edges: list[dict[int, int]] = []
        self.root: list[int] = []  # union-find over nodes
        self.same: list[int] = []  # a node of the one component that the whole subtree is in, -1 if there are several

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def near(self, fp: int) -> list[int]:
        """All nodes within the radius: the plain search."""
        found, stack = [], [0] if self.fp else []
        while stack:
            x = stack.pop()
            d = (self.fp[x] ^ fp).bit_count()
            if d <= self.radius:
                found.append(x)
            stack += [y for e, y in self.edges[x].items() if abs(e - d) <= self.radius]
        return found

    def similar(self, x: int, y: int) -> bool:
        """Whether the sets' intersection is `similarity` of their union, or more."""
        import numpy as np

        a, b = self.sets[x], self.sets[y]
        if min(len(a), len(b)) < self.similarity * max(len(a), len(b)):
            return False
        same = len(np.intersect1d(a, b, assume_unique=True))
        return same >= self.similarity * (len(a) + len(b) - same)

    def add(self, fp: int, shingles=None) -> int:
        """Add a fingerprint and join it with every component that it is within the radius of (and similar to)."""
        if shingles is not None:
            self.sets.append(shingles)
        me, radius, fps, edges, same, root = len(self.fp), self.radius, self.fp, self.edges, self.same, self.root
        fps.append(fp)
        edges.append({})
        root.append(me)
        same.append(me)
        if not me:
            return me
        stack = [0]
        while stack:
            x = stack.pop()
            s = same[x]
            if s >= 0 and self.find(s) == self.find(me):
                continue
            d = (fps[x] ^ fp).bit_count()
            if d <= radius and (not self.sets or self.similar(x, me)):
                a, b = self.find(x), self.find(me)
                if a != b:
                    root[max(a, b)] = min(a, b)
                if s >= 0:
                    continue  # the subtree is in that component as a whole
            for e, y in edges[x].items():
                if -radius <= e - d <= radius:
                    stack.append(y)
        mine, x = self.find(me), 0
        while True:
            if same[x] >= 0 and self.find(same[x]) != mine:
                same[x] = -1
            d = (fps[x] ^ fp).bit_count()
            y = edges[x].get(d)
            if y is None:
                edges[x][d] = me
                return me
            x = y


def blocks(parts: int) -> list[tuple[int, int]]:
    """The 64 bits in `parts` blocks: (shift, width)."""
    cuts = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shard_keys(fp: Column, m: int, radius: int) -> Column:
    """An array of (choice, bits in the chosen blocks)."""
    cut = blocks(radius + m)
    keys = []
    for i, chosen in enumerate(combinations(cut, m)):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("bigint")).alias("bits")))
    return F.array(*keys)


def choose_m(distinct: int, radius: int = RADIUS, fill: int = 64) -> int:
    """The least m whose shards hold about `fill` fingerprints or fewer, were they spread evenly; 4 at most (70 choices)."""
    return next((m for m in (1, 2, 3) if distinct <= fill << (BITS * m // (radius + m))), 4)


def large_shards(dealt: DataFrame, shard_rows: int) -> DataFrame:
    """choice, bits, parts: how many times a shard is over its size, in rows or in bytes of sets; those that are."""
    parts = F.count("*") / shard_rows
    if "shingles" in dealt.columns:
        parts = F.greatest(parts, F.sum(F.octet_length("shingles")) / SHARD_BYTES)
    return staged(dealt.groupBy("choice", "bits").agg(F.ceil(parts).cast("int").alias("parts")).filter("parts > 1"), "large-shards")


def by_bits(nodes: DataFrame, m: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """node, choice, bits: every two fingerprints within the radius share a shard.

    Fingerprints of a shard over `shard_rows` agree in its blocks, so they differ in the other bits only: these are
    cut into blocks once more, and the shard is dealt out by choices of them. What is then in a shard
    agrees on 48 bits, if m is 4, and is 65,536 fingerprints at most.
    """
    dealt = nodes.select("node", F.explode(shard_keys(F.col("node.fp"), m, radius)).alias("k")).select("node", "k.choice", "k.bits")
    large = large_shards(dealt, shard_rows)
    if large.isEmpty():
        return dealt
    finer = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in masks]) for masks in finer_masks(m, radius)])
    hot = dealt.join(large.select("choice", "bits"), ["choice", "bits"], "left_semi").select("node", "choice", F.posexplode(F.element_at(finer, F.col("choice") + 1)).alias("sub", "mask"))
    hot = hot.select("node", (F.col("choice") * 1000 + 1000 + F.col("sub")).alias("choice"), F.col("node.fp").bitwiseAND(F.col("mask")).alias("bits"))
    return dealt.join(large.select("choice", "bits"), ["choice", "bits"], "left_anti").select("node", "choice", "bits").unionByName(hot)


def finer_masks(m: int, radius: int, finer_m: int = 4) -> list[list[int]]:
    """For each choice of m blocks, the masks of the shards that a hot one is dealt out to: its blocks
    and finer_m of radius + finer_m parts of the other bits."""
    out = []
    for chosen in combinations(blocks(radius + m), m):
        fixed = sum(((1 << w) - 1) << s for s, w in chosen)
        free = [k for k in range(BITS) if not fixed >> k & 1]
        parts = radius + finer_m
        cuts = [len(free) * k // parts for k in range(parts + 1)]
        own = [sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [fixed | sum(c) for c in combinations(own, finer_m)]
        out.append([x - (1 << 64) if x >> 63 else x for x in masks])
    return out


def by_bands(nodes: DataFrame) -> DataFrame:
    """node, choice, bits from the column keys: a shard for each band and its number."""
    return nodes.select("node", F.posexplode("keys").alias("choice", "bits"))


def links(dealt: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, similarity: float = 0.8) -> DataFrame:
    """Links a, b (structs as in `dealt`) that connect exactly what is within the radius in some shard; at most one for each node and shard.

    dealt: node struct<nil boolean, id, fp bigint or binary>, fp distinct; choice, bits name a shard. With a column `shingles`
    a link also needs a similarity of `similarity` between these sets.
    """
    nodes = dealt
    more = ["shingles"] if "shingles" in dealt.columns else []
    large = large_shards(dealt, shard_rows)
    if large.isEmpty():
        pieces = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        n = F.coalesce(F.col("parts"), F.lit(1))
        mine = F.pmod(F.xxhash64("node.fp"), n).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
        pieces = dealt.join(large, ["choice", "bits"], "left").withColumn("n", n).withColumn("mine", mine).select("node", "choice", "bits", *more, F.explode(pair).alias("p")).select("node", "choice", "bits", *more, "p.i", "p.j")
    key = ["choice", "bits", "i", "j"]
    laid = pieces.select(*key, F.col("node.nil").alias("nil"), F.col("node.id").alias("id"), F.col("node.fp").alias("fp"), *more).repartition(*key).sortWithinPartitions(*key)
    id_type, fp_type = (nodes.schema["node"].dataType[c].dataType.simpleString() for c in ("id", "fp"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rows: list[tuple] = []
        now, kind, wide_kind = None, None, None
        out: dict[str, list] = {f"{s}_{c}": [] for s in "ab" for c in ("nil", "id", "fp")}

        def flush() -> None:
            if len(rows) < 2:
                return
            tree = BKTree(radius, similarity)
            for r in rows:
                own = np.frombuffer(r[3], np.uint32) if more else None
                tree.add(int.from_bytes(r[2], "big") if isinstance(r[2], bytes) else r[2] & 0xFFFFFFFFFFFFFFFF, own)
            for x, r in enumerate(rows):
                if (top := tree.find(x)) != x:
                    for s, row in (("a", r), ("b", rows[top])):
                        for c, v in zip(("nil", "id", "fp"), row[:3], strict=True):
                            out[f"{s}_{c}"].append(v)

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(v, kind if c.endswith("id") else pa.bool_() if c.endswith("nil") else wide_kind) for c, v in out.items()], list(out))
            for v in out.values():
                v.clear()
            return batch

        for b in batches:
            kind, wide_kind = b.schema.field("id").type, b.schema.field("fp").type
            cols = [b.column(i).to_pylist() for i in range(7 + len(more))]
            for choice, bits, i, j, *row in zip(*cols, strict=True):
                if (choice, bits, i, j) != now:
                    flush()
                    now = (choice, bits, i, j)
                    rows.clear()
                rows.append(row)
            if len(out["a_fp"]) >= 1 << 14:
                yield made()
        flush()
        if out["a_fp"]:
            yield made()

    ends = laid.mapInArrow(run, ", ".join(f"{s}_nil boolean, {s}_id {id_type}, {s}_fp {fp_type}" for s in "ab"))
    node = lambda s: F.struct(F.col(f"{s}_nil").alias("nil"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_fp").alias("fp"))
    return ends.select(node("a").alias("a"), node("b").alias("b"))


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows v, root: each node that has a link, but for the roots, with the smallest node that it is connected to.

    A large star joins a node's larger neighbours to the smallest in reach, a small star its
    smaller ones; rounds of both end in one star for each component. Each round is a written table.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v != root").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        # A hub's edges are keyed by the hub; with its smallest neighbour in a written table, a join
        # of two plain shuffles remains, whose hot partition Spark splits.
        floors = staged(now.groupBy("v").agg(F.min("root").alias("m")), "least")
        least = floors.withColumnRenamed("v", "root")
        large = now.join(least, "root", "left").select("v", F.coalesce("m", "root").alias("root")).distinct()
        floor = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(floor, "v")
        moved = small.select(F.col("root").alias("v"), F.col("m").alias("root")).unionByName(floor.select("v", F.col("m").alias("root")))
        before, now = now, staged(moved.filter("v != root").distinct(), "stars")
        discard(before, floors)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            return now
        state = seen
    raise RuntimeError("the components did not settle")


def _nodes(fps: DataFrame, *more) -> DataFrame:
    """A node for each distinct fingerprint, with its smallest id."""
    return staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), *more).select(F.struct(F.col("id").isNull().alias("nil"), F.col("id"), F.col("fp")).alias("node"), *[c for c in ("keys",) if more]), "fingerprints")


def _settled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """fp, component_id, root_fp for each node. found: as of stars()."""
    to = found.select(F.col("v.fp").alias("fp"), F.col("root.id").alias("to"), F.col("root.fp").alias("to_fp"))
    linked = F.col("to_fp").isNotNull()
    return nodes.select("node.fp", "node.id").join(to, "fp", "left").select("fp", F.when(linked, F.col("to")).otherwise(F.col("id")).alias("component_id"), F.coalesce("to_fp", "fp").alias("root_fp"))


def components(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, component_id, root_fp: for each distinct fingerprint the smallest id that links reach, and that one's fingerprint. fps: doc_id, fp."""
    nodes = _nodes(fps)
    return _settled(nodes, stars(links(by_bits(nodes, choose_m(nodes.count(), radius), radius, shard_rows), radius, shard_rows)))


def similar_components(fps: DataFrame, radius: int = WIDE_RADIUS, similarity: float = 0.8, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The same for wide fingerprints whose sets of shingles are similar. fps: doc_id, fp, keys, shingles.

    First without the sets: what fingerprints in the bands' shards link. Then each component of this
    is a shard, with the sets, and only similar texts are linked. All pairs of a component are candidates, whatever its
    size: one that is too large is cut into pairs of blocks (links()). Comparing sets costs more than comparing
    fingerprints, so these shards are an eighth as large.
    """
    nodes = _nodes(fps, F.min("keys").alias("keys"))
    coarse = stars(links(by_bands(nodes), radius, shard_rows))
    member = coarse.select(F.col("v.fp").alias("fp"), F.xxhash64("root.fp").alias("home")).unionByName(coarse.select(F.col("root.fp").alias("fp"), F.xxhash64("root.fp").alias("home")).distinct())
    own = staged(nodes.select("node", F.col("node.fp").alias("fp")).join(member, "fp"), "members")
    same = (fps["fp"] == own["fp"]) & fps["doc_id"].eqNullSafe(own["node.id"])
    sets = fps.join(own, same).groupBy(own["fp"].alias("fp")).agg(F.min(fps["shingles"]).alias("shingles"))
    laid = staged(own.join(sets, "fp").select("node", "home", "shingles"), "members-shingles")
    dealt = laid.select("node", F.lit(-1).alias("choice"), F.col("home").alias("bits"), "shingles")
    return _settled(nodes, stars(links(dealt, radius, max(2, shard_rows // 8), similarity)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each input row."""
    fps = staged(fingerprints(docs, id_col, text_col, words), "simhash")
    # a written table: a join of two plain shuffles can be split where one fingerprint is hot
    return fps.join(staged(components(fps, radius), "components"), "fp").select("doc_id", "fp", "component_id")


def with_sketches(docs: DataFrame, fp: str, keys: str, shingles: str, words: int = WIDE_WORDS) -> DataFrame:
    """The documents with all their columns, their wide fingerprints, the numbers of their bands, and their shingles."""
    small_batches(session_of(docs))
    where = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        alone()
        for b in batches:
            own = [wide(t, words) for t in b.column(where).to_pylist()]
            cols = [pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, fp, keys, shingles])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, BinaryType()), StructField(keys, ArrayType(LongType())), StructField(shingles, BinaryType())]))


def deduplicated(docs: DataFrame, words: int = WIDE_WORDS, similarity: float = 0.8, radius: int = WIDE_RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents with one row of each component: that with the smallest doc_id (any one of rows that repeat it with its fingerprint).

    Two texts are linked if the similarity (Jaccard) of their sets of five-word shingles is 0.8 or more. Candidates are those whose
    fingerprints of 256 bits over the shingles differ in at most 46 bits (0.8 makes 39 on average, with a deviation of 6), in what the shards of
    the bands connect, where texts of 0.8 meet with probability 0.99, those of 0.9 but for one in 10,000. Texts
    with one and the same fingerprint are linked in any case.

    Rows are told apart by id and fingerprint, since ids may be null or repeat under texts of other components.
    """
    name, keys, sets = "_fingerprint", "_bands", "_shingles"
    while {name, keys, sets} & set(docs.columns):
        name, keys, sets = name + "_", keys + "_", sets + "_"
    laid = staged(with_sketches(docs, name, keys, sets, words), "sketched")
    fps = laid.select("doc_id", F.col(name).alias("fp"), F.col(keys).alias("keys"), F.col(sets).alias("shingles"))
    roots = staged(similar_components(fps, radius, similarity, shard_rows).filter("fp = root_fp").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_keep")), "roots")
    own = fps.join(roots, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_keep")))
    first = staged(own.groupBy("_fp", "_keep").agg(F.count("*").alias("_n")), "kept")
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    # texts are dealt out once and not sorted: the side of the ids is hashed
    same = (F.col(f"d.{name}") == F.col("k._fp")) & F.col("d.doc_id").eqNullSafe(F.col("k._keep"))
    got = laid.select(*docs.columns, name).alias("d").join(first.alias("k").hint("shuffle_hash"), same)
    once = got.filter("k._n = 1").select(*cols)
    if first.filter("_n > 1").isEmpty():
        return once
    # rows that repeat an id and a fingerprint: one of them stays
    row = F.first(F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])).alias("row")
    again = got.filter("k._n > 1").groupBy(F.col("k._fp"), F.col("k._keep")).agg(row).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(again)
