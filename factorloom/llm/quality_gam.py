"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features in turn; each step fits a tree of a few leaves over one
feature's bins to the log-loss gradient and adds a small part of it to that feature's lookup table. Then the pairs with
the largest remaining gain get tables over two features' bins in the same way. A score is the sum of the table entries of
a text's bins, through the logistic function; on the executors this is bin search and addition over whole batches.

The model is fitted on a sample of labelled rows of at most `max_rows` expected rows, chosen by a hash of the id; texts are
described in one pass over all documents. Null and empty texts have all features 0 and are scored as such. Labels other
than 0 and 1 are ignored; a document that has several labels counts once for each. Without labels of both kinds each
score is the share of 1, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, remainder, table
from .features import NAMES, features


@dataclass
class Additive:
    """cuts: inner bin borders by feature; tables: a value by bin; pairs: (i, j, coarse cuts of i, of j, table)."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, i], side="right")]
        for i, j, ci, cj, values in self.pairs:
            total += values[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def borders(values: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return found[found > values.min()]


def leaf(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    return g / (h + shrink)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, shrink: float) -> np.ndarray:
    """Values by bin of a tree with so many leaves, split greedily where the gain is largest; g, h: gradient sums by bin."""
    ends = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + shrink)
    while len(ends) < leaves:
        options = [(gain(a, k) + gain(k, b) - gain(a, b), a, k, b) for a, b in ends for k in range(a + 1, b)]
        best = max(options, default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        ends.remove((best[1], best[3]))
        ends += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(g))
    for a, b in ends:
        out[a:b] = leaf(G[b] - G[a], H[b] - H[a], shrink)
    return out


def corner_tree(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    """Values over a grid of the best tree that cuts one axis once and each side of it once along the other axis."""
    best, chosen = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, a.shape[0]):
            out, total = np.zeros_like(a), 0.0
            for rows in (slice(0, k), slice(k, None)):
                ga, hb = a[rows].sum(0), b[rows].sum(0)
                values = shallow_tree(ga, hb, 2, shrink)
                out[rows] = values
                total += float((values * ga).sum())
            if total > best:
                best, chosen = total, out.T if turned else out
    return chosen


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 24, coarse: int = 6, rounds: int = 120, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.15, leaves: int = 3, shrink: float = 5.0) -> Additive:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Additive(float(np.log(share / (1 - share))), [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    model = Additive(float(np.log(share / (1 - share))))
    model.cuts = [borders(x[:, i], bins) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    logit = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, where in enumerate(at):
            g, h = slopes()
            n = len(model.tables[i])
            step = rate * shallow_tree(np.bincount(where, g, n), np.bincount(where, h, n), leaves, shrink)
            model.tables[i] += step
            logit += step[where]
    rough = [borders(x[:, i], coarse) for i in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(rough)]

    def grids(i: int, j: int):
        g, h = slopes()
        shape = len(rough[i]) + 1, len(rough[j]) + 1
        where = cell[i] * shape[1] + cell[j]
        return np.bincount(where, g, shape[0] * shape[1]).reshape(shape), np.bincount(where, h, shape[0] * shape[1]).reshape(shape), where

    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            g, h, _ = grids(i, j)
            gains.append((float((g**2 / (h + shrink)).sum()), i, j))
    chosen = [(i, j, np.zeros((len(rough[i]) + 1, len(rough[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, values in chosen:
            g, h, where = grids(i, j)
            step = rate * corner_tree(g, h, shrink)
            values += step
            logit += step.ravel()[where]
    model.pairs = [(i, j, rough[i], rough[j], values) for i, j, values in chosen]
    return model


def learn(described: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", max_rows: int = 30_000) -> Additive:
    """The model from described rows that have a label 0 or 1; described: (key, x)."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"))
    both = described.join(known, F.col(key) == F.col("_key")).select(key, "x", "_y")
    n = both.count()
    picked = both.where(F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))).select("x", "_y").toPandas()
    x = np.array(picked["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit(x, picked["_y"].to_numpy(dtype=np.float64))


def score(described: DataFrame, model: Additive, column: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def added(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy()).astype(np.float64)) if len(x) else np.empty(0))

    return described.withColumn(column, added("x"))


def op8_quality_gam(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    described = checkpointed(features(table(spark, sf_dir, "documents")))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = learn(described.where(~held_out), table(spark, sf_dir, "labels"))
    return score(described, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
