"""SQL for the oracles of op3 and op5: XXH64 in 128-bit arithmetic and CRC32 over hex digits; shingles, links and components; the partition."""
from __future__ import annotations

P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = "18446744073709551616::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_M})::UBIGINT"


def mul(a: str, b: int) -> str:
    return _mod(f"({a})::UHUGEINT * {b}::UHUGEINT")


def add(a: str, b: str) -> str:
    return _mod(f"({a})::UHUGEINT + ({b})::UHUGEINT")


def rotl(x: str, r: int) -> str:
    """x appears twice, so it should be a column."""
    return f"({_mod(f'({x})::UHUGEINT * {1 << r}::UHUGEINT')} + (({x}) >> {64 - r}))"


def _reduced(start: str, rest: str, step: str) -> str:
    """list_reduce from a start over a list of UBIGINT; step: an expression of h and l."""
    return f"list_reduce(list_prepend(({start})::UBIGINT, {rest}), lambda h, l: {step})"


def _number(hexes: str, n: int) -> str:
    """n bytes as a number, the first the least, from a text of their 2 n hex digits."""
    return "('0x' || " + " || ".join(f"substr({hexes}, {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"


def xxh64(source: str, column: str, seed: int = 42) -> str:
    """CTEs from a table of distinct texts to `hashed`: the column, h (its XXH64), and x (its bytes as hex digits)."""
    m = 1 << 64
    starts = [(seed + P1 + P2) % m, (seed + P2) % m, seed, (seed - P1) % m]
    stripe = mul(rotl(add("h", mul("l", P2)), 31), P1)
    steps = [f"x0 AS (SELECT {column}, hex(encode({column})) AS x FROM {source})"]
    # whole lanes of eight bytes, and what is left
    lanes = f"list_transform(regexp_extract_all(x, '.{{16}}'), lambda p: {_number('p', 8)})"
    steps.append(f"x1 AS (SELECT *, length(x) // 2 AS n, {lanes} AS lanes, substr(x, 16 * (length(x) // 16) + 1) AS rest FROM x0)")
    accumulators = ", ".join(f"CASE WHEN n >= 32 THEN {_reduced(f'{s}::UBIGINT', f'lanes[{j + 1}:4 * (n // 32):4]', stripe)} END AS v{j}" for j, s in enumerate(starts))
    steps.append(f"x2 AS (SELECT *, {accumulators} FROM x1)")
    merged = add(add(rotl("v0", 1), rotl("v1", 7)), add(rotl("v2", 12), rotl("v3", 18)))
    rounds = ", ".join(f"{mul(rotl(mul(f'v{j}', P2), 31), P1)} AS r{j}" for j in range(4))
    steps.append(f"x3 AS (SELECT *, {merged} AS g, {rounds} FROM x2)")
    whole = "g"
    for j in range(4):
        whole = add(mul(f"xor({whole}, r{j})", P1), str(P4))
    steps.append(f"x4 AS (SELECT *, {add(f'CASE WHEN n >= 32 THEN {whole} ELSE {(seed + P5) % m}::UBIGINT END', 'n')} AS h0 FROM x3)")
    eight = add(mul(rotl(f"xor(h, {mul(rotl(mul('l', P2), 31), P1)})", 27), P1), str(P4))
    steps.append(f"x5 AS (SELECT *, {_reduced('h0', 'lanes[4 * (n // 32) + 1:]', eight)} AS h1 FROM x4)")
    four = f"xor(h1, {mul(_number('rest', 4), P1)})"
    steps.append(f"x6 AS (SELECT *, CASE WHEN length(rest) >= 8 THEN {add(mul(rotl(four, 23), P2), str(P3))} ELSE h1 END AS h2, CASE WHEN length(rest) >= 8 THEN substr(rest, 9) ELSE rest END AS last FROM x5)")
    one = mul(rotl(f"xor(h, {mul('l', P5)})", 11), P1)
    steps.append(f"x7 AS (SELECT *, {_reduced('h2', "list_transform(regexp_extract_all(last, '..'), lambda p: ('0x' || p)::UBIGINT)", one)} AS h3 FROM x6)")
    steps.append(f"x8 AS (SELECT *, {mul('xor(h3, h3 >> 33)', P2)} AS h4 FROM x7)")
    steps.append(f"x9 AS (SELECT *, {mul('xor(h4, h4 >> 29)', P3)} AS h5 FROM x8)")
    steps.append(f"hashed AS MATERIALIZED (SELECT {column}, x, xor(h5, h5 >> 32) AS h FROM x9)")
    return ", ".join(steps)


def crc32(hexes: str) -> str:
    """The checksum of bytes given as hex digits, half a byte at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    known = "[" + ", ".join(f"{x}::UBIGINT" for x in table) + "]"
    half = lambda y: f"xor(({y}) >> 4, {known}[(({y}) & 15)::BIGINT + 1])"
    return f"xor({_reduced('4294967295', f"list_transform(regexp_extract_all({hexes}, '..'), lambda p: ('0x' || p)::UBIGINT)", half(half('xor(h, l)')))}, 4294967295::UBIGINT)::BIGINT"


def sharding(shards: int = 16) -> str:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of `documents` by the law `bytes`."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), dt AS (SELECT DISTINCT t FROM d), {xxh64('dt', 't')},
th AS MATERIALIZED (SELECT t, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS h, length(x) // 2 + 1 AS size, {crc32('x')} AS crc FROM hashed),
g AS MATERIALIZED (SELECT h, sum(size)::BIGINT AS bytes FROM d JOIN th USING (t) GROUP BY h),
-- the largest groups, while one is over an equal share of what is left, get a shard each
la AS (SELECT h, bytes, k, bytes * ({shards} - k) > left_ AND k < {shards - 1} AS over_ FROM (SELECT h, bytes, row_number() OVER w - 1 AS k, (SELECT sum(bytes) FROM g) - coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM g WINDOW w AS (ORDER BY bytes DESC, h))),
own AS MATERIALIZED (SELECT h, k FROM (SELECT h, k, bool_and(over_) OVER (ORDER BY k) AS alone FROM la) x WHERE alone),
n AS (SELECT {shards} - count(*) AS n FROM own), line AS MATERIALIZED (SELECT h, bytes, row_number() OVER (ORDER BY h) AS i FROM g WHERE h NOT IN (SELECT h FROM own)),
sizes AS MATERIALIZED (SELECT list(bytes::HUGEINT ORDER BY i) AS l, max(bytes) AS most, sum(bytes) AS total FROM line),
-- the least capacity with which a greedy walk needs no more shards: shards in the upper, bytes in the lower half of a number
bs AS (SELECT greatest(most, (total + n - 1) // n)::BIGINT AS lo, total::BIGINT AS hi FROM sizes, n UNION ALL
SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END FROM (SELECT lo, hi, mid, list_reduce(list_prepend(0::HUGEINT, l), lambda a, s: CASE WHEN a % 18446744073709551616::HUGEINT + s > mid THEN (a // 18446744073709551616::HUGEINT + 1) * 18446744073709551616::HUGEINT + s ELSE a + s END) // 18446744073709551616::HUGEINT < n AS fits FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM bs WHERE lo < hi) b, sizes, n) c),
cap AS (SELECT lo AS c FROM bs WHERE lo >= hi LIMIT 1),
walk AS (SELECT i, h, 0 AS shard, bytes AS full_ FROM line WHERE i = 1 UNION ALL SELECT l.i, l.h, CASE WHEN w.full_ + l.bytes > c THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.full_ + l.bytes > c THEN l.bytes ELSE w.full_ + l.bytes END FROM walk w JOIN line l ON l.i = w.i + 1, cap),
home AS (SELECT h, shard::INT AS shard FROM walk UNION ALL SELECT h, (n + k)::INT FROM own, n)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN th USING (t) JOIN home USING (h)
"""


def simhash(words: int = 4, radius: int = 4) -> str:
    """doc_id, fingerprint, component_id of `documents`."""
    bits = ", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(64))
    fp = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END" for k in range(64))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (SELECT rid, array_to_string(w[k:k + {words - 1}], ' ') AS s FROM d, unnest(generate_series(1, greatest(1, len(w) - {words - 1}))) AS t(k) WHERE len(w) > 0),
ds AS (SELECT DISTINCT s FROM sh), {xxh64('ds', 's')},
c AS MATERIALIZED (SELECT rid, count(*) AS n, {bits} FROM sh JOIN hashed USING (s) GROUP BY rid),
f AS MATERIALIZED (SELECT rid, doc_id, coalesce({fp}, 0::UBIGINT) AS fp FROM d LEFT JOIN c USING (rid)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM u a, u b WHERE a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {radius}),
r AS (SELECT fp AS a, fp AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN (SELECT r.a AS fp, min(least) AS component_id FROM r JOIN u ON u.fp = r.b GROUP BY r.a) USING (fp)
"""
