"""Quality by co-training of a content view and a metadata view.

One logistic classifier sees statistics of the text, another the page's metadata only (language, source, the
recorded length). Each starts from the same labelled seed. In each round, each marks the texts of a pool without labels
that it is surest of, and gives them with these labels to the other. At the end both are calibrated (Platt) on labelled rows
that neither was trained on, and a logistic combination of the calibrated views scores every document.

Seed and calibration rows are labelled rows of the training folds, `max_labelled` at most; the pool is documents of these folds
without a label, `max_pool` at most (all the first by a hash of the id). Only their statistics reach the driver.

Defined results: null and empty texts have statistics of zero; unknown languages and sources weigh nothing.
Without labels of both kinds every score is the share of good ones (0.5 without labels); too few calibration rows, or of
one kind, leave calibration to the seed. Repeated labels: the highest counts. Of several rows with one id the greatest is trained on.
Documents come back one for one; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, session_of, small_batches

FOLDS = 5


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 8_000
    max_pool: int = 8_000
    seed_share: float = 0.6  # the other labelled rows calibrate
    rounds: int = 5
    least_fresh: int = 40  # calibration rows, at least
    each: int = 200  # texts of each label that a view passes on in a round, at most
    sure: float = 0.95
    steps: int = 300
    rate: float = 0.05
    shrink: float = 1e-3


CONTENT = ("words", "word_len", "distinct", "symbols", "bars", "capitals", "shouts", "digits", "stops", "longest", "repeats", "lines", "same_next")
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"


def statistics(text: str | None) -> list[float]:
    """Content features, of no unit: logarithms and shares."""
    from math import log1p

    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(CONTENT)
    size = len(data)
    lower = [w.lower() for w in words]
    upper = sum(w.isupper() for w in words)
    share = lambda cut: (size - len(data.translate(None, cut))) / size
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        log1p(n), log1p(size / n), len(counts) / n, share(_SYMBOLS), data.count(b"|") / n, upper / n, data.count(b"!") / n, share(b"0123456789"),
        (data.count(b".") + data.count(b"?")) / n, log1p(max(map(len, words))), max(counts.values()) / n, 1 - len(set(lines)) / len(lines), sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n,
    ]


@dataclass
class View:
    """Standardised inputs, their squares, and logistic weights; slope and offset calibrate the logit."""

    mean: object
    scale: object
    weights: object
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x):
        return self.raw(x) * self.slope + self.offset

    def raw(self, x):
        return expand((x - self.mean) / self.scale) @ self.weights + self.bias


def expand(z):
    import numpy as np

    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z - 1], axis=1)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x, y, settings: Settings, shrink: float | None = None):
    """Weights and intercept by full-batch Adam."""
    import numpy as np

    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, settings.steps + 1):
        e = sigmoid(x @ w + b) - y
        g = np.append(x.T @ e / len(y) + (settings.shrink if shrink is None else shrink) * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = settings.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w, float(b)


def fit_view(x, y, settings: Settings) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    w, b = logistic(expand((x - mean) / scale), y, settings)
    return View(mean, scale, w, b)


@dataclass
class Model:
    langs: list[str]
    sources: list[str]
    views: list[View]
    mix: object  # weights of the two calibrated logits
    bias: float

    def score(self, content, meta):
        z = self.mix[0] * self.views[0].logit(content) + self.mix[1] * self.views[1].logit(meta) + self.bias if self.views else content[:, 0] * 0 + self.bias
        return sigmoid(z)


def metadata(rows: list[tuple], langs: list[str], sources: list[str]):
    """One row for each (lang, source, n_chars)."""
    import numpy as np

    out = np.zeros((len(rows), len(langs) + len(sources) + 1))
    at_l, at_s = {x: k for k, x in enumerate(langs)}, {x: len(langs) + k for k, x in enumerate(sources)}
    for k, (lang, source, n) in enumerate(rows):
        if lang in at_l:
            out[k, at_l[lang]] = 1
        if source in at_s:
            out[k, at_s[source]] = 1
        out[k, -1] = np.log1p(max(0, n or 0))
    return out


def cotrain(content, meta_rows: list[tuple], y, settings: Settings = Settings(), most_names: int = 64) -> Model:
    """content: array of statistics; meta_rows: (lang, source, n_chars); y: 0, 1, or None for rows of the pool.

    Of the labelled rows, in their order, the first `seed_share` are the seed.
    """
    import numpy as np

    told_rows = [k for k, v in enumerate(y) if v is not None]
    rest = [k for k, v in enumerate(y) if v is None]
    content, meta_rows = [content[k] for k in told_rows + rest], [meta_rows[k] for k in told_rows + rest]
    n_told, y = len(told_rows), np.array([y[k] for k in told_rows], float)
    n_seed = max(2, int(n_told * settings.seed_share))
    if n_told < 4 or len(set(y[:n_seed])) < 2:
        p = float(np.clip(y.mean() if n_told else 0.5, 0.01, 0.99))
        return Model([], [], [], None, float(np.log(p / (1 - p))))

    def common(k):
        seen: dict[str, int] = {}
        for r in meta_rows:
            if r[k] is not None:
                seen[r[k]] = seen.get(r[k], 0) + 1
        return sorted(sorted(seen), key=lambda x: -seen[x])[:most_names]

    langs, sources = common(0), common(1)
    inputs = [np.asarray(content, float), metadata(meta_rows, langs, sources)]
    base = float(y[:n_seed].mean())
    # what each view learns from: the seed, and what the other has passed on
    rows = [list(range(n_seed)), list(range(n_seed))]
    told = [list(y[:n_seed]), list(y[:n_seed])]
    pool = [set(range(n_told, len(content))) for _ in (0, 1)]  # what each view may still be given
    views = []
    for _ in range(settings.rounds):
        views = [fit_view(inputs[v][rows[v]], np.array(told[v]), settings) for v in (0, 1)]
        passed = 0
        for v in (0, 1):
            other = 1 - v
            open_rows = np.array(sorted(pool[other]), int)
            if not len(open_rows):
                continue
            p = sigmoid(views[v].raw(inputs[v][open_rows]))
            for label, sureness, n in ((1, p, settings.each * base), (0, 1 - p, settings.each * (1 - base))):
                best = np.argsort(-sureness, kind="stable")[: max(1, round(n))]
                for k in best[sureness[best] >= settings.sure]:
                    r = int(open_rows[k])
                    if r in pool[other]:
                        pool[other].remove(r)
                        rows[other].append(r)
                        told[other].append(float(label))
                        passed += 1
        if not passed:
            break
    views = [fit_view(inputs[v][rows[v]], np.array(told[v]), settings) for v in (0, 1)]
    fresh = slice(n_seed, n_told) if n_told - n_seed >= settings.least_fresh and len(set(y[n_seed:])) > 1 else slice(0, n_seed)
    for v in (0, 1):
        slope, offset = logistic(views[v].raw(inputs[v][fresh])[:, None] / 4, y[fresh], settings)
        views[v].slope, views[v].offset = float(slope[0]) / 4, offset
    both = np.stack([views[v].logit(inputs[v][fresh]) for v in (0, 1)], axis=1)
    mix, bias = logistic(np.clip(both, -8, 8) / 4, y[fresh], settings)
    return Model(langs, sources, views, mix / 4, bias)


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    text_or_null = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    n = F.col("n_chars").cast("long") if "n_chars" in have else F.char_length("text").cast("long")
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), text_or_null("lang").alias("lang"), text_or_null("source").alias("source"), n.alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list, list, list]:
    """Statistics, metadata and labels (None in the pool) of the sampled rows, in the order of the ids' hashes."""
    small_batches(session_of(docs))
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    in_folds = fold_of(F.col("doc_id"), FOLDS) != 0
    sample = known.filter(in_folds).orderBy(*order).limit(settings.max_labelled).collect()
    if not sample:
        return [], [], []
    own = _columns(docs)
    unlabelled = own.select("doc_id").filter(in_folds).distinct().join(known, "doc_id", "left_anti").orderBy(*order).limit(settings.max_pool).collect()
    chosen = [(r[0], int(r[1] > 0)) for r in sample] + [(r[0], None) for r in unlabelled]  # bounded by the two settings
    wanted = session_of(docs).createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int")
    row = F.max(F.struct("text", "lang", "source", "n_chars")).alias("r")
    rows = own.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(row).select("doc_id", "r.*", "quality")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            stats = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), b.column(5), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "lang", "source", "n_chars", "quality", "stats"])

    got = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, n_chars bigint, quality int, stats array<double>").orderBy(*order).collect()
    return [r["stats"] for r in got], [(r["lang"], r["source"], r["n_chars"]) for r in got], [r["quality"] for r in got]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return cotrain(*training_rows(docs, labels, settings), settings)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (share of good), content_score, metadata_score for each row."""
    small_batches(session_of(docs))
    shared = session_of(docs).sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            content = np.array([statistics(t) for t in b.column(1).to_pylist()])
            meta = metadata(list(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)), own.langs, own.sources)
            each = [sigmoid(v.logit(x)) for v, x in zip(own.views, (content, meta), strict=True)] if own.views else [own.score(content, meta)] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in (own.score(content, meta), *each))], ["doc_id", "score", "content_score", "metadata_score"])

    src = _columns(docs)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, content_score double, metadata_score double")
