"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, sample_labels

#: Hash dimensions (a power of two).
DIM = 1 << 20
#: Most labelled rows of either class that a model is fitted on, chosen by a hash of their id.
MAX_PER_CLASS = 4000
#: Labelled documents of more distinct features are no training rows (they are scored like any other), which bounds
#: the bytes of the one task that fits: 2 * MAX_PER_CLASS * MAX_FEATURES * 4.
MAX_FEATURES = 16_384

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: words, word pairs, and pairs with one word skipped."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not found:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(crc32, found), np.uint64, len(found))
    one = h * _A
    parts = [one, one[:-1] * _B + h[1:] + np.uint64(1), one[:-2] * _B + h[2:] * _A + np.uint64(2)]
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(31)
    mixed *= _B
    return np.unique((mixed >> np.uint64(44)).astype(np.uint32) & np.uint32(DIM - 1))


@dataclass
class FtrlModel:
    """Sparse weights; the bias is a coordinate of its own, without penalty."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(DIM, np.float32)
        w[self.index] = self.weight
        return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ftrl(rows: list[tuple[int, np.ndarray]], *, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.5, epochs: int = 8) -> FtrlModel:
    """FTRL-proximal with rate alpha / (beta + sqrt(sum of squared gradients)) per coordinate, rows in the given order."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    zb = nb = 0.0
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for y, x in rows:
            w = weights(z[x], n[x])
            b = -zb / ((beta + nb**0.5) / alpha)
            g = float(sigmoid(w.sum() + b)) - y
            if abs(g) < 1e-9:
                continue
            g2 = g * g
            root = np.sqrt(n[x])
            z[x] += g - (np.sqrt(n[x] + g2) - root) / alpha * w
            n[x] += g2
            zb += g - ((nb + g2) ** 0.5 - nb**0.5) / alpha * b
            nb += g2
    w = weights(z, n)
    at = np.flatnonzero(w)
    return FtrlModel(at.astype(np.uint32), w[at].astype(np.float32), -zb / ((beta + nb**0.5) / alpha))


def cross_validate(rows: list[tuple[int, np.ndarray]], grid: list[dict], folds: int = 4) -> list[tuple[float, float, dict]]:
    """(log loss, error rate, parameters) of every choice of ``grid``, best first, from training rows alone.

    Every folds-th row in turn is left out and judged by a model fitted on the others.  This is how the defaults of
    ``fit_ftrl`` were chosen; the rows that a query holds out have no part in it.
    """
    out = []
    for args in grid:
        loss = wrong = 0.0
        for k in range(folds):
            m = fit_ftrl([r for i, r in enumerate(rows) if i % folds != k], **args)
            w = m.dense().astype(np.float64)
            for y, x in rows[k::folds]:
                s = float(sigmoid(w[x].sum() + m.bias))
                loss -= np.log(s if y else 1 - s)
                wrong += (s >= 0.5) != y
        out.append((loss / len(rows), wrong / len(rows), args))
    return sorted(out, key=lambda x: x[:2])


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"turn": f["turn"], "label": f["label"], "x": [features(t).tobytes() for t in f["text"]]})


def _train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([*frames, pd.DataFrame({"turn": [], "label": [], "x": []})])
    rows = rows.sort_values(["turn", "label", "x"], kind="stable")
    m = fit_ftrl([(int(y), np.frombuffer(x, np.uint32)) for y, x in zip(rows["label"], rows["x"])])
    yield pd.DataFrame({"i": [m.index.tobytes()], "w": [m.weight.tobytes()], "b": [m.bias]})


def train_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", fold: str = "crc32(cast(id as string)) % 5 <> 0", max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> FtrlModel:
    """Fit on at most ``max_per_class`` labelled documents of either class, in one task, in a fixed order.

    The ids (two times max_per_class at most) are broadcast; the fit sees features only.  Without labelled rows the model is empty and scores 0.5.
    """
    with Scope() as scope:
        feats = training_rows(docs, labels, label_col, fold, max_per_class, id_col, text_col, scope)
        found = feats.repartition(1).mapInPandas(_train, "i binary, w binary, b double").first()
    if found is None:
        return FtrlModel(np.empty(0, np.uint32), np.empty(0, np.float32), 0.0)
    return FtrlModel(np.frombuffer(found.i, np.uint32), np.frombuffer(found.w, np.float32), found.b)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, fold: str, max_per_class: int, id_col: str, text_col: str, scope: Scope) -> DataFrame:
    """(turn, label, x): the features of the labelled documents to train on."""
    ids = scope.stage(sample_labels(labels, label_col, fold, max_per_class), "train_ids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return rows.mapInPandas(_extract, "turn long, label int, x binary").where(F.octet_length("x") <= 4 * MAX_FEATURES)


def score_toxicity(docs: DataFrame, model: FtrlModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1): every whole text is scored; null and empty ones get the bias alone.

    A column of that name in the input is replaced.  The model is a few thousand weights, broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c != "toxicity"]

    def run(frames):
        w, b = shared.value.dense(), shared.value.bias
        for f in frames:
            s = np.array([w[features(t)].sum(dtype=np.float64) + b for t in f[text_col]])
            yield f.assign(toxicity=sigmoid(s))

    schema = docs.select(*cols).schema.add("toxicity", "double")
    return docs.select(*cols).mapInPandas(run, schema)
