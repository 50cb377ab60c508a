"""Quality classifier: Bradley-Terry ranking from preference pairs, then a quantile threshold.

A document's strength is a linear score of text statistics.  Each preference pair holds a
document labelled good and one labelled bad; the logistic loss on the difference of their
features is minimised.  The score quantile that parts the fitted sample best becomes the
threshold, which the returned score maps to ``cut``.

Null and empty texts count as texts with no words and get the score of such a text.  Rows are
scored one by one, so repeated rows, ties and extra columns change nothing; an empty table
gives no rows.  With labels of one kind only (or none), every row scores ``cut``.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut
from tidelog.llm.labelled import SAMPLE_ROWS, fold, in_slices, sample

#: Byte classes: letters in lower and upper case, digits, white space, other ASCII, beyond ASCII.
_CLASS = np.full(256, 5, np.int8)
_CLASS[:128] = 4
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r")):
    _CLASS[list(_chars)] = _n


def features(texts: list) -> np.ndarray:
    """A row of text statistics for each text."""
    out = np.zeros((len(texts), 12))
    for i, t in enumerate(texts):
        t = t or ""
        raw = t.encode("utf-8", "surrogatepass")
        count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
        words = t.split()
        n, chars, lines = len(words), max(1, len(raw)), t.split("\n")
        m = max(1, n)
        letters = max(1, count[0] + count[1])
        out[i] = (
            np.log1p(n), np.log1p(chars / m), count[1] / letters, count[2] / chars, count[4] / chars, count[5] / chars,
            np.sqrt(sum(map(eq, words, words[1:])) / m), len(set(words)) / m, np.log1p(n / len(lines)), len(set(lines)) / len(lines),
            np.sqrt((t.count("!") + t.count("|") + t.count("#") + t.count("$") + t.count("%") + t.count("&") + t.count("*")) / chars), (t.count(".") + t.count(",")) / m,
        )
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z])


def fit(x: np.ndarray, y: np.ndarray, cut_at: float, pairs: int = 40_000, seed: int = 7) -> dict:
    """A model from features and labels 0 or 1."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"flat": cut_at}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, rng = _wide(x, mean, scale), np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    both = np.vstack([d, -d[: pairs // 2]])
    w = _logistic(both, np.r_[np.ones(pairs), np.zeros(pairs // 2)], ridge=20.0)
    s = z @ w
    ranked = np.sort(s)
    quantiles = np.unique(np.clip(np.linspace(0.0, 1.0, 2001) * (len(s) - 1), 0, len(s) - 2).astype(int))
    between = (ranked[quantiles] + ranked[quantiles + 1]) / 2 if len(s) > 1 else ranked
    right = np.searchsorted(np.sort(s[bad]), between) + len(good) - np.searchsorted(np.sort(s[good]), between)
    best = np.flatnonzero(right == right.max())
    threshold = between[best[len(best) // 2]]
    slope = _logistic(np.c_[s - threshold, np.ones(len(s))], y, ridge=1.0)[0]
    return {"mean": mean, "scale": scale, "w": w, "at": threshold, "slope": float(np.clip(slope, 0.05, 20)), "cut": cut_at}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    if "flat" in model:
        return np.full(len(x), model["flat"])
    s = model["slope"] * (_wide(x, model["mean"], model["scale"]) @ model["w"] - model["at"]) + np.log(model["cut"] / (1 - model["cut"]))
    return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut_at: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.  Labels of fold ``held`` are not read."""
    texts = cut(sample(docs, labels, "quality", folds, held, rows))

    def measure(batches):
        for b in batches:
            x = in_slices(features, b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = texts.mapInArrow(measure, "x array<double>, y int").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (list(got.x.iat[i]), got.y.iat[i]))]  # any order of tasks gives one model
    model = fit(np.array(got.x.tolist(), float).reshape(len(got), 12), got.y.to_numpy(), cut_at)

    def mark(batches):
        for b in batches:
            s = apply(model, in_slices(features, b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows_in = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows_in.mapInArrow(mark, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
