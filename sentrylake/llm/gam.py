"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins and has a table with a value for each bin; chosen pairs of features have a
small grid. Tables are learnt by boosting in turns: a shallow tree on one feature at a time, fitted to the
gradient of the logistic loss, adds a little to that feature's table. A score is a sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.llm.common import bounded, inner_utf8, utf8

FEATURES = ["log_bytes", "upper", "digits", "symbols", "exclaims", "stops_per_word", "spaces", "word_bytes", "distinct", "doubled", "lines_per_word", "odd_ends",
            "short_words", "capitalised", "high_bytes", "commonest", "entropy", "longest_word"]
_UPPER, _LETTER, _DIGIT, _SYMBOL, _SPACE, _HIGH = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL[[b for b in range(33, 127) if chr(b) not in ".,;:'\"!?()-" and not chr(b).isalnum()]] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_HIGH[128:] = True
_PLAIN_END = frozenset(b".,;:'\")?-") | {b for b in range(256) if _LETTER[b] or _DIGIT[b]}


def features(text: bytes) -> list[float]:
    """One number for each of FEATURES, of the whole text. A text without bytes or words has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = hist[hist > 0] / n
    words = text.split()
    k = len(words) or 1
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [np.log1p(n), hist[_UPPER].sum() / max(hist[_LETTER].sum(), 1), hist[_DIGIT].sum() / n, hist[_SYMBOL].sum() / n, (hist[33] + hist[63]) / k, (hist[46] + hist[44]) / k,
            hist[_SPACE].sum() / n, sum(map(len, words)) / k, len(seen) / k, sum(map(bytes.__eq__, words, words[1:])) / k, hist[10] / k,
            sum(w[-1] not in _PLAIN_END for w in words) / k, sum(len(w) < 4 for w in words) / k, sum(_UPPER_SET.__contains__(w[0]) for w in words) / k, hist[_HIGH].sum() / n,
            max(seen.values(), default=0) / k, float(-(share * np.log2(share)).sum()), float(np.log1p(max(map(len, words), default=0)))]


_UPPER_SET = frozenset(range(65, 91))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """A value for each bin: a tree of the given depth over a histogram of gradients."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = np.where((left_h >= least) & (right_h >= least), _gain(left_g, left_h, ridge) + _gain(right_g, right_h, ridge), -1.0)
        at = int(np.argmax(gain))
        if gain[at] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            return np.concatenate([_tree(g[:at + 1], h[:at + 1], depth - 1, ridge, least), _tree(g[at + 1:], h[at + 1:], depth - 1, ridge, least)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quarters: (gain, value for each cell)."""
    def cut(x):
        c = x.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d
    gs, hs = cut(g), cut(h)
    gain = sum(_gain(x, y, ridge) for x, y in zip(gs, hs)) - _gain(g.sum(), h.sum(), ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty(g.shape)
    for part, (x, y) in zip((np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:]), zip(gs, hs)):
        value[part] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), value


class Additive:
    """Bin borders and tables; pairs of features have coarse borders of their own."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 120, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15,
                 ridge: float = 1.0, least: float = 2.0):
        """x: a row per example, y: 0 or 1. Without examples the score is 0.5; with one class only it is near that class."""
        m = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for j in range(m)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.arange(1, coarse) / coarse)) if len(x) else np.zeros(0) for j in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.grids: list[tuple[int, int, np.ndarray]] = []
        mean = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(mean / (1 - mean)))
        if not len(x):
            return
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        logit = np.full(len(y), self.base)

        def slopes():
            p = 1.0 / (1.0 + np.exp(-logit))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for j in range(m):
                if len(self.tables[j]) < 2:
                    continue
                g, h = slopes()
                step = rate * _tree(np.bincount(at[j], g, len(self.tables[j])), np.bincount(at[j], h, len(self.tables[j])), 2, ridge, least)
                self.tables[j] += step
                logit += step[at[j]]

        rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        g, h = slopes()
        found = []
        for i in range(m):
            for j in range(i + 1, m):
                shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                if min(shape) > 1:
                    cell = rough[i] * shape[1] + rough[j]
                    found.append((_quarters(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge)[0], i, j, shape, cell))
        found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:pairs]
        grids = [np.zeros(f[3]) for f in found]
        for _ in range(pair_rounds):
            for k, (_, i, j, shape, cell) in enumerate(found):
                g, h = slopes()
                step = rate * _quarters(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge)[1]
                grids[k] += step
                logit += step.ravel()[cell]
        self.grids = [(f[1], f[2], grid) for f, grid in zip(found, grids)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row: bins are looked up and added."""
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, grid in self.grids:
            total += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-total))


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def fit(df: DataFrame, id_col: str, text: str, labels: DataFrame, label_id: str, label: str, learn: Column, max_labels: int = 40_000) -> Additive:
    """Fit on the labelled rows for which `learn` (a condition on labels) holds: all of them up to max_labels
    (the documented bound on labelled rows), beyond it those with the smallest hash of the id.

    Labels other than 0 and 1 and null ids are left out. A document labelled more than once, and each of
    repeated documents, is an example each time."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull() & learn).select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_label").limit(max_labels)
    # At most max_labels rows of two numbers.
    rows = bounded(df).select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for batch in batches:
            x = _matrix(utf8(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    schema = T.StructType([T.StructField("id", rows.schema["_id"].dataType), T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = rows.select("_id", "_label", "text").mapInArrow(run, schema).orderBy(F.xxhash64("id"), "label", "x").limit(max_labels).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return Additive(x, got.column("label").to_numpy())


def scored(df: DataFrame, text: str, model: Additive, threshold: float = 0.3, inside: str | None = None) -> DataFrame:
    """The columns of df without `text` (with the struct column `inside`, if that has the text), with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null text counts as empty. An empty table gives an empty table. The new columns are
    called `score` and `predicted`; the input must not have columns of that name."""
    df = bounded(df)
    kept = [c for c in df.columns if inside or c != text]

    def run(batches):
        for batch in batches:
            p = model.score(_matrix(inner_utf8(batch, inside, text) if inside else utf8(batch, text)))
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names) if n in kept], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             [*kept, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_good(df: DataFrame, id_col: str, text: str, labels: DataFrame, label_id: str, label: str, learn: Column, threshold: float = 0.3) -> DataFrame:
    """df without the rows that the classifier rejects, with its columns, whatever their names."""
    model = fit(df, id_col, text, labels, label_id, label, learn)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    return scored(rows, text, model, threshold, "doc").where("predicted = 1").select("doc.*")
