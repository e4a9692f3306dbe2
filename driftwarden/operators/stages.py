"""The detectors as stages of an ML pipeline: estimators that fit on a development table, models that add score and prediction.

A model's numbers are one parameter, as JSON, so that Spark's own writer stores it with the pipeline; nothing is pickled.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from driftwarden.operators import detectors


class Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted detector; ``state`` holds its numbers, ``name`` begins the columns that it adds."""

    state = Param(Params._dummy(), "state", "the detector's numbers as JSON", TypeConverters.toString)
    name = ""

    @classmethod
    def of(cls, **numbers) -> Fitted:
        out = cls()
        out._set(state=json.dumps(numbers))
        return out

    def numbers(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def scored(self, df: DataFrame) -> tuple[DataFrame, float]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        out, limit = self.scored(df)
        return out.withColumn(f"{self.name}_prediction", detectors.predicted(f"{self.name}_score", limit))


class StatisticalModel(Fitted):
    name = "statistical"

    def scored(self, df: DataFrame) -> tuple[DataFrame, float]:
        return df.withColumn("statistical_score", detectors.statistical_score()), self.numbers()["threshold"]


class ComponentsModel(Fitted):
    name = "pca"

    def detector(self) -> detectors.PrincipalComponents:
        held = self.numbers()
        return detectors.PrincipalComponents(detectors.Scaler(**held.pop("scaler")), **held)

    def scored(self, df: DataFrame) -> tuple[DataFrame, float]:
        own = self.detector()
        return own.score(df), own.threshold


class ForestModel(Fitted):
    name = "isolation_forest"

    def detector(self) -> detectors.IsolationForest:
        held = self.numbers()
        trees = [tuple(np.array(a) for a in tree) for tree in held.pop("trees")]
        return detectors.IsolationForest(detectors.Scaler(**held.pop("scaler")), trees, **held)

    def scored(self, df: DataFrame) -> tuple[DataFrame, float]:
        own = self.detector()
        return own.score(df), own.threshold


def model_of(detector: detectors.PrincipalComponents | detectors.IsolationForest | float) -> Fitted:
    """The model of a detector, or of the statistical threshold."""
    if isinstance(detector, detectors.PrincipalComponents):
        return ComponentsModel.of(**dataclasses.asdict(detector))
    if isinstance(detector, detectors.IsolationForest):
        plain = dataclasses.asdict(detector)
        return ForestModel.of(**plain | {"trees": [[a.tolist() for a in tree] for tree in detector.trees]})
    return StatisticalModel.of(threshold=float(detector))


class Detector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on the earliest ``rows`` rows of its input."""

    rows = Param(Params._dummy(), "rows", "rows of the development table", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rows: int = detectors.DEVELOPMENT_ROWS):
        super().__init__()
        self._setDefault(rows=detectors.DEVELOPMENT_ROWS)
        self._set(**self._input_kwargs)

    def fitted(self, dev: DataFrame) -> detectors.PrincipalComponents | detectors.IsolationForest | float:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> Fitted:
        return model_of(self.fitted(detectors.development(df, self.getOrDefault(self.rows))))


class StatisticalDetector(Detector):
    def fitted(self, dev: DataFrame) -> float:
        return detectors.threshold(dev.withColumn("statistical_score", detectors.statistical_score()), "statistical_score")


class ComponentsDetector(Detector):
    kept = Param(Params._dummy(), "kept", "share of the variance that the components explain", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, rows: int = detectors.DEVELOPMENT_ROWS, kept: float = 0.95):
        Estimator.__init__(self)
        self._setDefault(rows=detectors.DEVELOPMENT_ROWS, kept=0.95)
        self._set(**self._input_kwargs)

    def fitted(self, dev: DataFrame) -> detectors.PrincipalComponents:
        return detectors.PrincipalComponents.fit(dev, detectors.Scaler.fit(dev), self.getOrDefault(self.kept))


class ForestDetector(Detector):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "rows a tree grows from", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the samples and cuts", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rows: int = detectors.DEVELOPMENT_ROWS, trees: int = 200, size: int = 256, seed: int = 42):
        Estimator.__init__(self)
        self._setDefault(rows=detectors.DEVELOPMENT_ROWS, trees=200, size=256, seed=42)
        self._set(**self._input_kwargs)

    def fitted(self, dev: DataFrame) -> detectors.IsolationForest:
        return detectors.IsolationForest.fit(dev, detectors.Scaler.fit(dev), *(self.getOrDefault(p) for p in (self.trees, self.size, self.seed)))
