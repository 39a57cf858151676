"""What the text operators share: staging tables, batch size, projection of the input columns."""
from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, remove, scratch, shared_dir, staged  # noqa: F401

#: Rows and bytes in an Arrow batch. Texts may be long; a batch is what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 128, 8 << 20


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds. The setting is read when a plan starts to run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_kept: dict = {}


def kept(key: tuple, make):
    """What a Python worker keeps between batches and tasks: one thing at a time, so that workers
    that serve several operators don't pile up vocabularies and caches. What goes is given back to the system."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            _trim()
        _kept[key] = make()
    return _kept[key]


def _trim() -> None:
    """Freed memory that the C library holds; without that library's function, nothing."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def alone() -> None:
    """For an operator that keeps nothing: what others have kept goes."""
    kept(("nothing",), lambda: None)


def token() -> str:
    """A name for something broadcast, other than any before."""
    return uuid.uuid4().hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads; other columns, whatever their names, are gone."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fold_of(doc_id, folds: int = 5):
    """The column crc32(doc_id as text) mod folds; null ids have no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def crc_fold(doc_id: int, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
