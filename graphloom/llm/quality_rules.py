"""Quality rules: word and line counts, and compression bands.

A text is rejected by the method if its zstandard ratio (bytes before by bytes after) is outside the band
for its length: too high says it repeats itself, too low that it is noise. Texts of more than a
chunk are also cut into fixed chunks, the last one ending where the text ends, and rejected if over `share` of the chunks are outside the chunk band.

Defined results: null and empty texts have no words and fail (fewer than 50 words). Rows come back
one for one; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import id_and_text, session_of, small_batches


@dataclass(frozen=True)
class Bands:
    """(up to this many bytes, least ratio, most ratio); chunk size, band and share; zstandard's level."""

    whole: tuple[tuple[float, float, float], ...] = ((512, 0.95, 3.2), (2048, 1.15, 4.0), (8192, 1.3, 5.0), (float("inf"), 1.4, 6.5))
    chunk: int = 4096
    chunk_band: tuple[float, float] = (1.2, 5.0)
    share: float = 0.34
    level: int = 3


BANDS = Bands()


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(distinct := set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        mark = bytearray(n)
        for k, w in enumerate(windows):
            if w in twice:
                mark[k : k + 3] = b"\x01\x01\x01"
        repeated = mark.count(1)
    del distinct
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


class Compressor:
    def __init__(self, bands: Bands = BANDS):
        import zstandard

        self.bands = bands
        self.squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.squeeze(data))

    def verdict(self, text: str | None) -> tuple[float | None, int, bool]:
        """The whole ratio, the number of odd chunks, whether the method keeps the text."""
        data = (text or "").encode()
        if not data:
            return None, 0, False
        whole = self.ratio(data)
        low, high = next((a, b) for most, a, b in self.bands.whole if len(data) <= most)
        size = self.bands.chunk
        pieces = [data[k : k + size] for k in range(0, len(data) - size + 1, size)] if len(data) > size else []
        if pieces and len(data) % size:
            pieces.append(data[-size:])
        least, most = self.bands.chunk_band
        odd = sum(not least <= self.ratio(p) <= most for p in pieces)
        return whole, odd, low <= whole <= high and odd <= self.bands.share * len(pieces)


def assess(docs: DataFrame, bands: Bands = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, odd_chunks."""
    small_batches(session_of(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Compressor(bands)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                c = counts(t)
                failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
                ratio, odd, good = own.verdict(t)
                rows.append((*c, failed, good and not failed, ratio, odd))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names, "base_failed", "kept", "ratio", "odd_chunks"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{x} bigint" for x in names) + ", base_failed boolean, kept boolean, ratio double, odd_chunks int")
