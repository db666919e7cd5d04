"""Quality classifier: Bradley-Terry ranking of documents, learned from preference pairs.

A document labelled 1 is preferred to one labelled 0. The model is a weight vector w; the chance that x is preferred to y
is the logistic function of w (f(x) - f(y)). Scores are then placed so that the chosen quantile of the labelled scores,
the share of rejected ones, lies at the cut 0.7. The weights are fitted on a bounded sample; that quantile and the spread
of scores are those of all labelled documents.

Null text counts as empty and gets a score like any text. Null labels and labelled ids without a document are ignored; of
contradicting labels of one id 1 counts.
Repeated rows get equal scores. An empty table gives no rows. If only one class is labelled, all documents score the
cut itself and are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans.shared import written

#: At most so many labelled documents are fitted, those with the smallest hash of their id (24 bytes each for the join,
#: some 400 bytes each of features on the driver).
FIT_ROWS = 20_000
#: Preference pairs drawn from them for one fit, and its quadratic penalty.
PAIRS, L2, SEED = 120_000, 1e-3, 7
CUT = 0.7
#: Ranks that the quantile of all labelled documents tells apart.
RANK_STEPS = 100_000

MARKS = b"!?|$%#&*.,;:@/<>{}=_-'\""


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters, repetition of words and lines, how well the text compresses. Whole texts."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split("\n")
    nw = max(1, len(words))
    out = [hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[32], hist[10], hist[128:].sum()]
    out += [hist[c] for c in MARKS]
    out += [
        np.log1p(n) / 10,
        len(text) / nw / 20,
        len(set(words)) / nw,
        len(set(zip(words, words[1:], words[2:]))) / max(1, nw - 2),
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 5,
        len(zlib.compress(raw, 1)) / n,
        sum(w.isupper() for w in words) / nw,
        min(1.0, nw / 20),
    ]
    x = np.asarray(out, float)
    return np.concatenate([x, np.log1p(50 * np.clip(x, 0, None))])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float = 0.0
    spread: float = 1.0
    cut: float = field(default=CUT)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.placed(self.raw(x))

    def placed(self, raw: np.ndarray) -> np.ndarray:
        z = (raw - self.at) / self.spread + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = L2, seed: int = SEED, cut: float = CUT) -> Model:
    """Newton steps on the logistic loss of feature differences over drawn (preferred, other) pairs."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(up) or not len(down):
        return Model(mean, scale, np.zeros(x.shape[1]), cut=cut)
    draw, z = np.random.default_rng(seed), np.clip((x - mean) / scale, -6, 6)
    d = z[draw.choice(up, pairs)] - z[draw.choice(down, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (p - 1) / pairs + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile at the share of rejected labels, half way between its two neighbours
    rank, ordered = len(down), np.sort(s)
    at = (ordered[rank - 1] + ordered[min(rank, len(s) - 1)]) / 2
    return Model(mean, scale, w, float(at), float(max(s.std() / 2, 1e-6)), cut)


def marks(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id, y: one label of each labelled id."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return marked.groupBy("id").agg(F.max("y").alias("y"))


def labelled_features(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled documents, on the driver."""
    few = marks(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or "").tolist() for t in texts], pa.list_(pa.float64()))

    # broadcast: fit_rows rows of two numbers at most
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    # of rows that repeat an id the one of the least content hash, so that a fit can be repeated
    one = some.groupBy("id").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select("id", "y", vectors("text").alias("x")).orderBy("id").collect()
    width = len(features(""))
    return np.array([r.x for r in rows], float).reshape(-1, width), np.array([r.y for r in rows], int)


def valued(docs: DataFrame, model: Model, text_col: str, **columns: Column) -> DataFrame:
    """The given columns and ``raw``, what the weights make of each text, before scores are placed; written."""

    @F.arrow_udf("double")
    def raw(texts: pa.Array) -> pa.Array:
        return pa.array(in_parts(model.raw, texts), pa.float64())

    return written(docs.select(*[c.alias(k) for k, c in columns.items()], raw(F.col(text_col)).alias("raw")), "quality")


def cut_at(model: Model, values: DataFrame, marked: DataFrame) -> Model:
    """The model with its cut at the quantile of the rejected share; values: (id, raw), marked: (id, y).

    The quantile over all labelled documents is a mergeable sketch, exact up to ``RANK_STEPS`` rows and within one in
    ``RANK_STEPS`` of the ranks beyond.
    """
    known = values.select("id", "raw").join(marked, "id").select("raw", "y")
    n, rejected, spread = known.agg(F.count("*"), F.sum(1 - F.col("y")), F.stddev_pop("raw")).first()
    if not n or not 0 < rejected < n:
        return model
    # half way between the highest of the rejected share and the lowest above it
    low, high = known.agg(F.percentile_approx("raw", F.array(F.lit((rejected - 0.5) / n), F.lit((rejected + 0.5) / n)), RANK_STEPS)).first()[0]
    return replace(model, at=(low + high) / 2, spread=max(spread / 2, 1e-6))


def ranked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kw) -> tuple[Model, DataFrame]:
    """The model, and (id, raw) of every document."""
    model = fit(*labelled_features(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **kw))
    values = valued(docs, model, text_col, id=F.col(id_col))
    return cut_at(model, values, marks(labels, id_col, label_col)), values


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kw) -> DataFrame:
    """The documents that score at least the cut of a model fitted on the labels, unchanged.

    Rows are written once with their raw values, so that features are made once; the cut, which looks at all labelled
    documents, is known after that and filters what was written.
    """
    model = fit(*labelled_features(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **kw))
    rows = valued(docs, model, text_col, id=F.col(id_col), row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    model = cut_at(model, rows, marks(labels, id_col, label_col))
    return rows.where(placed(model, F.col("raw")) >= model.cut).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def train(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    return ranked(docs, labels, **kw)[0]


def in_parts(of: Callable[[np.ndarray], np.ndarray], texts: pa.Array) -> np.ndarray:
    """A function of features for all texts, a few hundred at a time."""
    out = np.empty(len(texts))
    for at in range(0, len(texts), 256):
        part = texts.slice(at, 256)
        out[at : at + len(part)] = of(np.stack([features(t.as_py() or "") for t in part]))
    pa.default_memory_pool().release_unused()  # the next batch may be another stage's, in a worker that stays
    return out


def placed(model: Model, raw: Column) -> Column:
    """Scores from raw values."""

    @F.arrow_udf("double")
    def scores(values: pa.Array) -> pa.Array:
        return pa.array(model.placed(values.to_numpy(zero_copy_only=False)), pa.float64())

    return scores(raw)


def score_column(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of every whole text; a column, so a filter on it keeps all others. No shuffle."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(in_parts(model.score, texts), pa.float64())

    return scored(text)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score at least the model's cut, unchanged."""
    return docs.where(score_column(model, F.col(text_col)) >= model.cut)
