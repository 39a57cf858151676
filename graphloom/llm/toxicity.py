"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is trained from confirmed toxic texts and
from texts whose labels are not looked at. With the class prior p, the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the negative part is corrected by the
prior, and where it falls under zero (overfitting) a step goes the other way.

Features of a text, each counted once: its words (runs of letters, lower case) and the first four
and five letters of longer words, hashed to `dims` places. Positives are labelled rows of the training folds, `max_positive`
at most; the unlabelled texts are documents of these folds, whether they have a label or not, `max_unlabelled`
at most (both the first by a hash of the id). Only their hashed features reach the driver. Every document is scored.

Defined results: null and empty texts get the model's intercept; without a positive label in the training folds
every score is the prior (0 without labels). Labels that are null or repeated: any 1 makes a
document positive. Of several texts with one id the greatest is trained on. Documents come back one for one; other
columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, id_and_text, kept, session_of, small_batches, token

DIMS = 1 << 20
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    dims: int = DIMS
    max_positive: int = 4_000
    max_unlabelled: int = 12_000
    least_z: float = 5.0  # standard errors between a feature's shares of positive and of unlabelled texts
    steps: int = 300
    rate: float = 0.1
    shrink: float = 0.15  # of the weights, divided by the number of positives
    prior: float | None = None  # None: the share of positives in the labelled training rows


def _words():
    import regex

    return regex.compile(r"\p{L}+").findall


class Hasher:
    """Words to places; what a word hashes to is kept."""

    KEEP = 100_000

    def __init__(self, dims: int):
        import xxhash

        self.dims, self.find, self.hash = dims, _words(), xxhash.xxh32_intdigest
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, word: str) -> tuple[int, ...]:
        names = [word] + [f"^{word[:k]}" for k in (4, 5) if len(word) > k]
        return tuple(self.hash(x) % self.dims for x in names)

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        known = self.known
        for w in set(self.find((text or "").lower())):
            got = known.get(w)
            if got is None:
                got = self.places(w)
                if len(known) < self.KEEP and len(w) <= 24:
                    known[w] = got
            out.update(got)
        return sorted(out)


@dataclass
class Model:
    """Weights of the places that count, an intercept, and the score of a text without features."""

    dims: int
    places: object  # int64 array, sorted
    weights: object
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.places.tolist(), self.weights.tolist(), strict=True))


def train(positive: list, unlabelled: list, prior: float, settings: Settings = Settings()) -> Model:
    """Full-batch Adam on the non-negative risk; logistic loss."""
    import numpy as np

    empty = np.zeros(0)
    if not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(settings.dims, empty.astype(np.int64), empty, float(np.log(p / (1 - p))))
    count = [np.bincount(np.concatenate([np.asarray(x, np.int32) for x in s]), minlength=settings.dims) for s in (positive, unlabelled)]
    n_p, n_u = len(positive), len(unlabelled)
    pool = (count[0] + count[1]) / (n_p + n_u)
    error = np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n_p + 1 / n_u))
    z = np.abs(count[0] / n_p - count[1] / n_u) / error
    use = np.flatnonzero((count[0] + count[1] > 1) & (z >= settings.least_z))
    slot = np.full(settings.dims, -1, np.int32)
    slot[use] = np.arange(len(use), dtype=np.int32)

    def sparse(rows):
        cols = [slot[np.asarray(r, np.int32)] for r in rows]
        cols = [c[c >= 0] for c in cols]
        sizes = np.array([len(c) for c in cols])
        return np.concatenate(cols) if cols else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)

    sets = [sparse(positive), sparse(unlabelled)]
    shrink = settings.shrink / n_p
    w, b = np.zeros(len(use)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # steps go to and fro where the risk's negative part is corrected, so the last third's mean is the model
    mean_w, mean_b, last = np.zeros_like(w), 0.0, settings.steps - settings.steps // 3
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, settings.steps + 1):
        score = [b + np.bincount(r, w[c], n) for c, r, n in sets]
        as_negative = [np.logaddexp(0, s) for s in score]
        low = as_negative[1].mean() - prior * as_negative[0].mean()
        s_p, s_u = sigmoid(score[0]), sigmoid(score[1])
        if low >= 0:
            g_p, g_u = prior * (s_p - 1) - prior * s_p, s_u
        else:
            g_p, g_u = prior * s_p, -s_u
        (cp, rp, n_p), (cu, ru, n_u) = sets
        g = np.bincount(cp, (g_p / n_p)[rp], len(use)) + np.bincount(cu, (g_u / n_u)[ru], len(use)) + shrink * w
        gb = g_p.mean() + g_u.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= settings.rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= settings.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
        if step > last:
            mean_w += w / (settings.steps - last)
            mean_b += b / (settings.steps - last)
    keep = np.abs(mean_w) > 1e-4
    return Model(settings.dims, use[keep], mean_w[keep], float(mean_b))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list, list, float]:
    """Hashed features of the sampled positive and unlabelled texts, and the class prior; only training folds."""
    small_batches(session_of(docs))
    known = labels.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic")).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold_of(F.col("doc_id"), FOLDS) != 0)
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("long"))).first()
    prior = settings.prior if settings.prior is not None else (toxic or 0) / n if n else 0.0
    order = [F.xxhash64("doc_id"), "doc_id"]
    positive = known.filter("toxic > 0").orderBy(*order).limit(settings.max_positive).select("doc_id", F.lit(1).alias("kind"))
    ids = id_and_text(docs).select("doc_id").filter(fold_of(F.col("doc_id"), FOLDS) != 0)
    anything = ids.distinct().orderBy(*order).limit(settings.max_unlabelled).select("doc_id", F.lit(0).alias("kind"))
    chosen = [(r[0], r[1]) for r in positive.unionByName(anything).collect()]  # bounded by the two settings
    if not chosen:
        return [], [], prior
    kinds: dict = {}
    for doc, kind in chosen:
        kinds.setdefault(doc, []).append(kind)
    told = session_of(docs).createDataFrame([(d,) for d in kinds], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    wanted = id_and_text(docs).join(F.broadcast(told), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    dims = settings.dims

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = kept(("hasher", dims), lambda: Hasher(dims))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.of(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "places"])

    # as arrays of 4-byte numbers: lists of Python's would take ten times the driver's memory
    rows = wanted.mapInArrow(run, f"doc_id {wanted.schema[0].dataType.simpleString()}, places array<int>").toArrow()
    places = [x.values.to_numpy() for x in rows.column("places")]
    parts: tuple[list, list] = ([], [])
    for doc, own in sorted(zip(rows.column("doc_id").to_pylist(), places, strict=True), key=lambda r: r[0]):
        for kind in kinds[doc]:
            parts[1 - kind].append(own)
    return parts[0], parts[1], prior


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return train(*training_rows(docs, labels, settings), settings)


class Scorer:
    def __init__(self, model: list):
        dims, self.weights, self.bias = model
        self.hasher = Hasher(dims)

    def __call__(self, text: str | None) -> float:
        from math import exp

        get = self.weights.get
        z = self.bias + sum(get(x, 0.0) for x in self.hasher.of(text))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def _worker(shared) -> Scorer:
    key, *model = shared.value
    return kept(("toxicity", key), lambda: Scorer(model))


def broadcast_model(spark, model: Model):
    """At most one weight for each of `dims` places, whatever the corpus."""
    return spark.sparkContext.broadcast((token(), model.dims, model.table(), model.bias))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row."""
    small_batches(session_of(docs))
    shared = broadcast_model(session_of(docs), model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, score double")


def not_toxic(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score under `at`."""
    small_batches(session_of(docs))
    shared, where = broadcast_model(session_of(docs), model), docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _worker(shared)
        for b in batches:
            yield b.filter(pa.array([own(t) < at for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
