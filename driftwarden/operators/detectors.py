"""Unsupervised detectors: statistical, principal components, isolation forest; their scaling and thresholds.

All are fitted on a development table of bounded size (``development``) and applied to any number of rows. The
statistical score and all thresholds are JVM expressions; components and forest score the scaled matrix in Python, an
Arrow batch at a time, both in one pass (``score_models``) with only the wanted columns beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.columns import bounded, clip, zero
from driftwarden.operators.features import model_columns
from driftwarden.operators.fusion import largest
from driftwarden.session import ship

PERCENTILE = 0.995
DEVELOPMENT_ROWS = 15_000
SCORES = ("pca_score", "isolation_forest_score", "statistical_score")


def development(df: DataFrame, rows: int = DEVELOPMENT_ROWS) -> DataFrame:
    """The earliest ``rows`` rows: what detectors are fitted on."""
    return df.orderBy("ts", "station_id").limit(rows)


def threshold(df: DataFrame, column: str, p: float = PERCENTILE) -> float:
    """Exact percentile with linear interpolation; ``df`` is a development table, of bounded size."""
    return float(df.agg(F.percentile(column, p)).first()[0] or 0.0)


def statistical_score() -> Column:
    """The largest absolute z-score over 60 minutes, 0 where there is none."""
    return largest("roll_z_60m")


@dataclass
class Scaler:
    """Median for missing values, then zero mean and unit deviation (population; constants divide by 1)."""

    columns: list[str]
    median: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    deviation: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, dev: DataFrame) -> Scaler:
        names = model_columns(dev)
        medians = dev.agg(*(F.percentile(c, 0.5).alias(c) for c in names)).first()
        median = [float(medians[c]) if medians[c] is not None else 0.0 for c in names]
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(names, median, strict=True)]
        row = dev.agg(*(x for c, v in zip(names, filled, strict=True) for x in (F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}")))).first()
        return cls(names, median, [float(row[f"m_{c}"]) for c in names], [float(row[f"s_{c}"]) or 1.0 for c in names])

    def matrix(self, values: np.ndarray) -> np.ndarray:
        """Rows of ``columns`` (NaN: missing) as the models see them."""
        return (np.where(np.isnan(values), self.median, values) - self.mean) / self.deviation

    def expressions(self) -> list[Column]:
        return [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / s).alias(f"z_{c}") for c, m, a, s in zip(self.columns, self.median, self.mean, self.deviation, strict=True)]

    def vector(self, df: DataFrame) -> DataFrame:
        """Adds the scaled vector ``_x``."""
        from pyspark.ml.feature import VectorAssembler  # not at the top: every Python worker imports this module

        scaled = df.select("*", *self.expressions())
        names = [f"z_{c}" for c in self.columns]
        return VectorAssembler(inputCols=names, outputCol="_x").transform(scaled).drop(*names)


@dataclass
class PrincipalComponents:
    """Mean squared error of the reconstruction from the fewest components that explain more than ``kept``."""

    scaler: Scaler
    components: list[list[float]]  # a row a component
    threshold: float = 0.0

    @classmethod
    def fit(cls, dev: DataFrame, scaler: Scaler, kept: float = 0.95) -> PrincipalComponents:
        from pyspark.ml.feature import PCA

        model = PCA(k=len(scaler.columns), inputCol="_x", outputCol="_y").fit(scaler.vector(dev))
        share = np.cumsum(model.explainedVariance.toArray())
        k = min(int(np.searchsorted(share, kept, side="right")) + 1, len(share))
        out = cls(scaler, model.pc.toArray()[:, :k].T.tolist())
        out.threshold = threshold(out.score(dev), "pca_score")
        return out

    def errors(self, x: np.ndarray, at_once: int = 256) -> np.ndarray:
        """The scaled rows are centred, so the error is what the components leave of them.

        Sums go in the columns' and components' order, a block of rows at a time. A matrix product adds in an order that the machine and the
        number of rows decide, so a row's last digits would hang on its batch.
        """
        c, out = np.array(self.components)[:, :, None], np.empty(len(x))
        for s in range(0, len(x), at_once):
            part = np.ascontiguousarray(x[s : s + at_once].T)
            along = c[:, 0] * part[0]
            for j in range(1, len(part)):
                along += c[:, j] * part[j]
            again = c[0] * along[0]
            for k in range(1, len(along)):
                again += c[k] * along[k]
            left = np.square(part - again)
            out[s : s + at_once] = sum(left[1:], left[0]) / len(part)
        return out

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds ``pca_score`` to the columns ``keep`` (by default all)."""
        return score_models(df, {"pca_score": (self.scaler, self.errors)}, keep)


def score_models(df: DataFrame, models: dict[str, tuple[Scaler, Callable[[np.ndarray], np.ndarray]]], keep: list[str] | None = None) -> DataFrame:
    """Adds for each name a function of the scaled matrix; only ``keep`` and the matrices travel to Python."""
    ship(df.sparkSession)
    kept = [c for c in (keep or df.columns) if c not in models]
    scalers: list[Scaler] = []
    for scaler, _ in models.values():
        if scaler not in scalers:
            scalers.append(scaler)
    held = df.sparkSession.sparkContext.broadcast([(name, scalers.index(scaler), function) for name, (scaler, function) in models.items()])
    rows = df.select(*kept, *(F.array(*scaler.expressions()).alias(f"_x{k}") for k, scaler in enumerate(scalers)))
    count, names = len(scalers), list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = [b[f"_x{k}"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in range(count)]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *(pa.array(function(x[k])) for _, k, function in held.value)], [*kept, *names])

    return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *(T.StructField(name, T.DoubleType()) for name in models)]))


def path_normaliser(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Isolation trees over random subsamples; the score is 2^(-mean depth / expected depth)."""

    scaler: Scaler
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), cut, left child, leaf depth, fitted rows
    size: int
    threshold: float = 0.0

    @classmethod
    def fit(cls, dev: DataFrame, scaler: Scaler, trees: int = 200, size: int = 256, seed: int = 42) -> IsolationForest:
        """A tree grows in a task, from the ``size`` rows with the smallest hashes of its number and their keys.

        A row travels to about 1.4 * ``size`` * ``trees`` / rows trees: those whose hash lies below a bound that all but surely leaves enough.
        Partitioning changes nothing: the same rows give the same trees. The driver gets the trees' arrays.
        """
        n = dev.count()
        size = max(1, min(size, n))
        most = (1 << 63) - 1
        bound = min(most, int(most * (size + 6 * size**0.5 + 8) / max(n, 1)))
        hash = lambda t: F.xxhash64(F.lit(seed), t, "station_id", "ts").bitwiseAND(F.lit(most))
        rows = dev.select("station_id", "ts", F.array(*scaler.expressions()).alias("x"))
        drawn = rows.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hash(t) <= bound)).alias("tree")).withColumn("hash", hash("tree"))

        def grow(own: pd.DataFrame) -> pd.DataFrame:
            number = int(own["tree"].iloc[0])
            x = np.stack(own.sort_values(["hash", "station_id", "ts"])["x"].to_list())[:size]
            arrays = cls._tree(x, np.random.default_rng([seed, number]))
            return pd.DataFrame([[number, *(a.tolist() for a in arrays)]], columns=["tree", "feature", "cut", "left", "depth", "held"])

        grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, cut array<double>, left array<int>, depth array<double>, held array<int>").collect()
        out = cls(scaler, [tuple(np.array(a) for a in r[1:]) for r in sorted(grown)], size)
        out.threshold = threshold(out.score(dev), "isolation_forest_score")
        return out

    @staticmethod
    def _tree(x: np.ndarray, rng: np.random.Generator) -> tuple:
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        feature, cut, left, depth, held = [-1], [0.0], [0], [0.0], [len(x)]
        todo = [(0, x, 0)]
        while todo:
            node, rows, level = todo.pop()
            usable = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if level >= limit or not len(usable):
                depth[node] = level + path_normaliser(len(rows))
                continue
            low, high = rows.min(axis=0), rows.max(axis=0)
            k = int(rng.choice(usable))
            at = float(rng.uniform(low[k], high[k]))
            feature[node], cut[node], left[node] = k, at, len(feature)
            below = rows[:, k] <= at
            for part in (rows[below], rows[~below]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), cut.append(0.0), left.append(0), depth.append(float(level + 1)), held.append(len(part))
        return np.array(feature), np.array(cut), np.array(left), np.array(depth), np.array(held)

    @cached_property
    def nodes(self) -> tuple[np.ndarray, ...]:
        """All trees' nodes in one table: feature, cut, left child, depth; and the roots. A leaf is its own child."""
        first = np.cumsum([0, *(len(t[0]) for t in self.trees)]).astype(np.int32)
        feature, cut, left, depth = (np.concatenate([np.asarray(t[i]) for t in self.trees]) for i in range(4))
        own, leaf = np.arange(len(feature)), feature < 0
        shift = np.repeat(first[:-1], np.diff(first))
        return np.where(leaf, 0, feature).astype(np.int32), np.where(leaf, np.inf, cut), np.where(leaf, own, left + shift).astype(np.int32), depth, first[:-1]

    def isolation(self, x: np.ndarray, at_once: int = 256) -> np.ndarray:
        """A block of rows goes down all trees together, a level at a time; depths are summed in the trees' order."""
        total, (feature, cut, left, depth, roots) = np.zeros(len(x)), self.nodes
        for s in range(0, len(x), at_once):
            part = np.ascontiguousarray(x[s : s + at_once])
            values, row = part.ravel(), np.arange(len(part), dtype=np.int32) * part.shape[1]
            node = np.repeat(roots[:, None], len(part), axis=1)
            while True:
                below = left[node] + (values[row + feature[node]] > cut[node])
                if (below == node).all():
                    break
                node = below.astype(np.int32)
            total[s : s + at_once] = np.add.reduce(depth[node], axis=0)
        return np.exp2(-total / len(self.trees) / (path_normaliser(self.size) or 1.0))

    @cached_property
    def leaves(self) -> list[tuple[np.ndarray, ...]]:
        """All leaves by how many features their path splits on: depth, features, share of fitted rows that pass each, its bounds (low, high]."""
        found: dict[int, list] = {}
        for feature, cut, left, depth, held in self.trees:
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                k = int(feature[node])
                if k < 0:
                    found.setdefault(len(path), []).append((depth[node], *zip(*((f, *v) for f, v in path.items()))) if path else (depth[node], (), (), (), ()))
                    continue
                share, low, high = path.get(k, (1.0, -np.inf, np.inf))
                for child, lo, hi in ((int(left[node]), low, min(high, cut[node])), (int(left[node]) + 1, max(low, cut[node]), high)):
                    todo.append((child, {**path, k: (share * held[child] / held[node], lo, hi)}))
        return [tuple(np.array([leaf[i] for leaf in rows]) for i in range(5)) for _, rows in sorted(found.items())]

    def expected_depth(self) -> float:
        """Mean path length of the fitted rows, by the shares that each split sends on."""
        return float(sum((value * share.prod(axis=1)).sum() if share.size else value.sum() for value, _, share, _, _ in self.leaves)) / len(self.trees)

    def shapley(self, x: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
        """(rows, features): Shapley values of the mean path length; below 0 where a feature makes the row easier to isolate.

        What a tree gives for a known subset of features follows the row at their splits and the fitted rows' shares at all others. A leaf is
        then a product over the features of its path, and a feature's weighted sum over all subsets of the others is the integral over q of the others' product, each
        mixed q : 1 - q between the row and the share: a polynomial, so Gauss-Legendre nodes give it exactly.
        """
        out = np.zeros(x.shape)
        for value, feature, share, low, high in self.leaves:
            size = share.shape[1] if share.size else 0
            if not size:
                continue
            nodes, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
            order = np.argsort(feature.ravel(), kind="stable")
            own = feature.ravel()[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            step = max(1, at_once // feature.size)
            for s in range(0, len(x), step):
                v = x[s : s + step][:, feature]
                passes = ((v > low) & (v <= high)).astype(np.float64)
                total = np.zeros(passes.shape)
                for node, weight in zip((nodes + 1) / 2, weights / 2, strict=True):
                    mixed = node * passes + (1 - node) * share
                    total += weight * mixed.prod(axis=2, keepdims=True) / mixed
                total *= (passes - share) * value[None, :, None]
                out[s : s + step, own[first]] += np.add.reduceat(total.reshape(len(v), -1)[:, order], first, axis=1)
        return out / max(len(self.trees), 1)

    def explain(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds ``forest_shapley`` to the columns ``keep`` (by default all): an array in the order of the scaler's columns."""
        ship(df.sparkSession)
        kept = [c for c in (keep or df.columns) if c != "forest_shapley"]
        held = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select(*kept, F.array(*self.scaler.expressions()).alias("_x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = held.value.shapley(b["_x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                    ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*kept, "forest_shapley"])

        return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("forest_shapley", T.ArrayType(T.DoubleType()))]))

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds ``isolation_forest_score`` to the columns ``keep`` (by default all)."""
        return score_models(df, {"isolation_forest_score": (self.scaler, self.isolation)}, keep)


@dataclass
class ModelEvidence:
    """Robust scaling of the three scores (median, quartile distance; 0 divides by 1) and their joint evidence."""

    centre: dict[str, float]
    spread: dict[str, float]

    @classmethod
    def fit(cls, dev: DataFrame, scores: tuple[str, ...] = SCORES) -> ModelEvidence:
        quarters = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))
        row = dev.agg(*(F.percentile(zero(c), quarters).alias(c) for c in scores)).first()
        return cls({c: row[c][1] for c in scores}, {c: (row[c][2] - row[c][0]) or 1.0 for c in scores})

    def _scaled(self) -> list[Column]:
        return [(zero(c) - self.centre[c]) / self.spread[c] for c in self.centre]

    def v2_of(self, scores: dict[str, np.ndarray]) -> np.ndarray:
        """``v2`` of arrays."""
        held = [np.clip((scores[c] - self.centre[c]) / self.spread[c], 0.0, 10.0) for c in self.centre]
        return 1 - np.exp(-(sum(held) / len(held)) / 3.0)

    def v1(self) -> Column:
        xs = self._scaled()
        return bounded(F.greatest(sum(xs[1:], xs[0]) / len(xs), F.lit(0.0)), 2.0)

    def v2(self) -> Column:
        xs = [clip(x, 0.0, 10.0) for x in self._scaled()]
        return bounded(sum(xs[1:], xs[0]) / len(xs), 3.0)


def predicted(score: str | Column, limit: float) -> Column:
    """1 where strictly above the threshold."""
    return (F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(0.0)) > limit).cast("int")
