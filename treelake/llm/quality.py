"""Quality: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, sample_labels

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP, _SYMBOL = [ord(c) for c in ".,;:?'\"-()"], [ord(c) for c in "#$%&*|<>{}[]\\^_~=+/@"]
STATS = 16
#: Most labelled rows of either class that a model is fitted on, chosen by a hash of their id.
MAX_PER_CLASS = 50_000


def statistics(text: str | None) -> np.ndarray:
    """STATS transformed statistics of a whole text; an empty text has a defined vector."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, k = max(1, len(raw)), max(1, len(words))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    single = sum(1 for w in words if len(w) == 1)
    lines = int(c[10]) + 1
    ratio = lambda x: np.arcsin(np.sqrt(min(1.0, x)))
    return np.array([
        np.log1p(len(words)),
        np.log1p(n / k),
        ratio(distinct / k**0.9),
        ratio(again / k),
        ratio(single / k),
        ratio(c[_LETTER].sum() / n),
        ratio(c[_UPPER].sum() / n),
        ratio(c[_STOP].sum() / n),
        ratio(c[_SYMBOL].sum() / n),
        ratio(c[33] / n),
        ratio(c[48:58].sum() / n),
        ratio(c[124] / n),
        ratio(c[32] / n),
        np.log1p(len(words) / lines),
        np.log1p(c[46] / lines),
        np.log1p(max(map(len, words), default=0)),
    ])


@dataclass
class QdaModel:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor of the shrunk covariance, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        dens = [self.prior[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) - 0.5 * self.logdet[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -40, 40)))


def fit_qda(count: np.ndarray, mean: np.ndarray, square: np.ndarray, *, own: float = 0.8, ridge: float = 0.005) -> QdaModel:
    """From per-class counts, means and sums of squares about the means.  Covariance of a class: (1 - own) * its own +
    own * the pooled one, the whole shrunk by ``ridge`` towards its diagonal and floored; a class without rows gets the
    pooled figures."""
    mean, every = mean.copy(), max(1.0, count.sum())
    pooled, middle = square.sum(axis=0) / every, (mean * count[:, None]).sum(axis=0) / every
    inverse, logdet = [], []
    for k in (0, 1):
        if count[k] == 0:
            mean[k] = middle
        cov = square[k] / count[k] if count[k] >= 2 else pooled
        s = (1 - own) * cov + own * pooled
        s = (1 - ridge) * s + np.diag(ridge * np.diag(s) + 1e-5)
        low = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    prior = np.log((count + 1) / (count.sum() + 2))
    return QdaModel(prior, mean, np.array(inverse), np.array(logdet))


def moments(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and sums of squares about the means of the classes 0 and 1, of rows in memory."""
    count = np.array([(label == k).sum() for k in (0, 1)], float)
    mean = np.array([x[label == k].mean(axis=0) if count[k] else np.zeros(x.shape[1]) for k in (0, 1)])
    return count, mean, np.array([(x[label == k] - mean[k]).T @ (x[label == k] - mean[k]) for k in (0, 1)])


def cross_validate(x: np.ndarray, label: np.ndarray, grid: list[dict], folds: int = 4) -> list[tuple[float, float, dict]]:
    """(log loss, error rate, parameters) of every choice of ``grid``, best first, from training rows alone; every
    folds-th row in turn is left out.  This is how the defaults of ``fit_qda`` were chosen."""
    out, fold = [], np.arange(len(x)) % folds
    for args in grid:
        s = np.empty(len(x))
        for k in range(folds):
            s[fold == k] = fit_qda(*moments(x[fold != k], label[fold != k]), **args).score(x[fold == k])
        out.append((float(-np.log(np.maximum(np.where(label == 1, s, 1 - s), 1e-17)).mean()), float(((s >= 0.5) != label).mean()), args))
    return sorted(out, key=lambda r: r[:2])


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"label": f["label"], "x": [statistics(t).tobytes() for t in f["text"]]})


def _matrix(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float64).reshape(-1, STATS)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for y, g in f.groupby("label"):
            yield pd.DataFrame({"label": [y], "n": [len(g)], "v": [_matrix(g["x"]).sum(axis=0)]})


def _squares(mean: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for y, g in f.groupby("label"):
                x = _matrix(g["x"]) - mean[y]
                yield pd.DataFrame({"label": [y], "n": [len(g)], "v": [(x.T @ x).ravel()]})

    return run


def train_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", fold: str = "crc32(cast(id as string)) % 3 <> 1", max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> QdaModel:
    """Class moments of the labelled documents of the fold, ``max_per_class`` of either class at most, whose ids are broadcast.

    Two passes over their staged statistics, means first and then squares about them; only sums (a few hundred numbers
    a task) leave a task.
    """
    count, mean, square = np.zeros(2), np.zeros((2, STATS)), np.zeros((2, STATS, STATS))
    with Scope() as scope:
        ids = scope.stage(sample_labels(labels, label_col, fold, max_per_class).select("id", "label"), "train_ids")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
        rows = scope.stage(rows.mapInPandas(_extract, "label int, x binary"), "statistics")

        def total(parts, k: int) -> list:
            return rows.mapInPandas(parts, "label int, n long, v array<double>").groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)]).collect()

        for r in total(_sums, STATS):
            count[r["label"]], mean[r["label"]] = r["n"], np.array(r[2:]) / r["n"]
        for r in total(_squares(mean), STATS * STATS):
            square[r["label"]] = np.array(r[2:]).reshape(STATS, STATS)
    return fit_qda(count, mean, square)


def add_quality(docs: DataFrame, model: QdaModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` from whole texts; null and empty texts are scored as empty.  A column of that name is replaced."""
    cols = [c for c in docs.columns if c != "quality_score"]

    def run(frames):
        for f in frames:
            x = np.array([statistics(t) for t in f[text_col]]).reshape(-1, STATS)
            yield f.assign(quality_score=model.score(x))

    return docs.select(*cols).mapInPandas(run, docs.select(*cols).schema.add("quality_score", "double"))
