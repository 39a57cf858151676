"""Byte-level BPE by longest matches and backtracking.

A sequence of tokens is what the merges give exactly when every two neighbours
are compatible: merging the bytes of the two alone gives the two again. So a
piece is encoded left to right: take the longest token at the position (from one
pass of an Aho-Corasick automaton over the bytes, mapped to Latin-1), shorten it
while it doesn't suit its left neighbour, and step back when nothing suits. A
position that was stepped back from is never tried again, which keeps the work
linear. Compatibility of a pair is memoised.

Nulls and empty texts have no tokens. Rows are handled one by one, so repeated
rows come back as often as they came in; other columns are ignored.
"""
from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .common import id_and_text, kept, session_of, sha, small_batches

#: Pieces that are kept with their ids, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 200_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The merges one by one, lowest rank first (only ranks under `below`). Quadratic: for short pieces and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] >= (1 << 60) or (below is not None and best[0] >= below):
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes, the two tokens that its last merge joins. Tokens that no merges reach are left out."""
    out = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, rank)
            if len(parts) == 2:
                out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Encoder:
    """Encodes and decodes with one vocabulary; made once in each Python worker from the broadcast tables."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.halves = ranks, halves
        self.joined = {pair: rank for rank, pair in halves.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.auto = ahocorasick.Automaton()
        reached = {rank: token for token, rank in ranks.items() if len(token) == 1 or rank in halves}
        for rank, token in reached.items():
            self.auto.add_word(token.decode("latin-1"), rank)
        self.auto.make_automaton()
        whole = {token: rank for rank, token in reached.items()}
        self.shorter: dict[int, int | None] = {}
        for rank, token in reached.items():
            self.shorter[rank] = next((whole[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in whole), None)
        self.split = regex.compile(pattern).findall
        self.memo: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens alone leaves these two.

        Undo merges at the seam, the later one first, and ask each time whether the two
        tokens at the seam would have been joined before the merge that was undone.
        """
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            known = self.memo[key] = self._stable(left, right)
            if len(self.memo) > 300_000:
                self.memo.clear()
        return known

    def _stable(self, left: int, right: int) -> bool:
        undone = 1 << 60  # joins at the seam count only if their rank is under this
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < undone:
                return False
            can_left, can_right = left in self.halves, right in self.halves
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or left > right):
                # the left merge happens later: until then its right half stood at the seam
                undone, left = left, self.halves[left][1]
            else:
                # equal ranks merge from the left, so a join at the seam of the right token's own rank comes first
                undone, right = right + 1, self.halves[right][0]

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        if (rank := self.ranks.get(data)) is not None:
            return (rank,)
        n, size, shorter = len(data), self.size, self.shorter
        longest = [0] * n
        for end, rank in self.auto.iter(data.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # ends ascend, so the longest comes last
        ids: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if alive[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at == n:
                    return tuple(ids)
                token = longest[at]
            elif (less := shorter[token]) is not None:
                token = less
            else:
                alive[at] = 0
                token = ids.pop()
                at -= size[token]

    def encode(self, text: str) -> list[int]:
        found, pieces = self.split(text), self.pieces
        try:
            return list(chain.from_iterable(map(pieces.__getitem__, found)))
        except KeyError:
            pass
        own: dict[str, tuple[int, ...]] = {}
        for piece in set(found):
            if piece not in pieces:
                ids = self.piece(piece.encode())
                if len(piece) <= CACHE_CHARS and len(pieces) < CACHE_PIECES:
                    pieces[piece] = ids
                else:
                    own[piece] = ids
        out: list[int] = []
        for piece in found:
            out += pieces[piece] if piece in pieces else own[piece]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return sha(" ".join(map(self.text_of.__getitem__, ids)))


def _worker(vocabulary) -> Encoder:
    """The encoder of this Python worker, made from the broadcast vocabulary."""
    key, *tables = vocabulary.value
    return kept(("bpe", key), lambda: Encoder(*tables))


def broadcast_vocabulary(spark, path: str, pattern: str):
    """A vocabulary file is of fixed size, whatever the corpus, so its tables are broadcast."""
    ranks = load_ranks(path)
    key = sha(repr((pattern, sorted(ranks.items()))))
    return spark.sparkContext.broadcast((key, ranks, last_merges(ranks), pattern))


def lists(rows: list[array]):
    """An Arrow column of lists from arrays of 4-byte numbers."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.frombuffer(r, np.int32) for r in rows]) if len(rows) and ends[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, round_trip: whether the ids decode to the text's bytes (nulls count as empty)."""
    spark = session_of(docs)
    small_batches(spark)
    vocabulary = broadcast_vocabulary(spark, path, pattern)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(vocabulary)
        for b in batches:
            ids, same = [], []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                found = own.encode(text)
                same.append(own.decode(found) == text.encode())
                ids.append(array("i", found))  # four bytes for a token, where a list takes nine times as many
            yield pa.RecordBatch.from_arrays([b.column(0), lists(ids), pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, ids array<int>, round_trip boolean")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary: the ids of each whole text and the bytes they decode to."""
    spark = session_of(docs)
    small_batches(spark)
    vocabulary = broadcast_vocabulary(spark, path, pattern)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(vocabulary)
        for b in batches:
            ids = [array("i", own.encode(t) if t else []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), lists(ids), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text binary from doc_id, ids; null ids give null, an id outside the vocabulary fails."""
    spark = session_of(encoded)
    small_batches(spark)
    vocabulary = broadcast_vocabulary(spark, path, pattern)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else own.decode(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 without moving ids out of the Python worker."""
    spark = session_of(docs)
    small_batches(spark)
    vocabulary = broadcast_vocabulary(spark, path, pattern)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(vocabulary)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t) if t else []
                n.append(len(ids))
                a.append(own.digest(ids))
                d.append(sha(own.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = id_and_text(docs)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
