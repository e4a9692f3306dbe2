"""The offline path as one plan: clean, features, detectors, fusion, health; and the fitted artifacts."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.operators import detectors, features, fusion, health, quality
from driftwarden.schema import FEATURES
from driftwarden.session import materialize
from driftwarden.sources.tables import load_manifest, save_manifest


@dataclass
class Artifacts:
    """Everything that scoring needs, fitted on the development rows only."""

    statistical_threshold: float
    components: detectors.PrincipalComponents
    forest: detectors.IsolationForest
    evidence: detectors.ModelEvidence
    sudden_threshold: float
    persistent_threshold: float

    def models(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Scores and predictions of the three detectors, with the columns ``keep`` (by default all)."""
        scored = {"pca_score": (self.components.scaler, self.components.errors), "isolation_forest_score": (self.forest.scaler, self.forest.isolation)}
        rows = df.withColumn("statistical_score", detectors.statistical_score())
        out = detectors.score_models(rows, scored, [*keep, "statistical_score"] if keep else None)
        limits = {"statistical": self.statistical_threshold, "pca": self.components.threshold, "isolation_forest": self.forest.threshold}
        out = out.withColumns({f"{k}_prediction": detectors.predicted(f"{k}_score", v) for k, v in limits.items()})
        return out.withColumn("any_prediction", F.greatest(*(f"{k}_prediction" for k in limits)))

    def fused(self, df: DataFrame) -> DataFrame:
        out = fusion.evidence_v2(self.models(df).withColumn("model_evidence", self.evidence.v2()))
        return fusion.fuse_v2(out, self.sudden_threshold, self.persistent_threshold)

    def plain(self) -> dict:
        """All parameters as lists and numbers."""
        plain = dataclasses.asdict(self)
        plain["forest"]["trees"] = [[x.tolist() for x in tree] for tree in self.forest.trees]
        return plain

    def save(self, spark: SparkSession, path: str) -> None:
        """A manifest of all parameters; nothing is pickled."""
        save_manifest(spark, path, {"feature_column_names": list(FEATURES), "artifacts": self.plain()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifacts:
        return cls.of(load_manifest(spark, path)["artifacts"])

    @classmethod
    def of(cls, plain: dict) -> Artifacts:
        """The artifacts that ``plain`` gave."""
        plain = dict(plain)
        pca, forest = dict(plain.pop("components")), dict(plain.pop("forest"))
        components = detectors.PrincipalComponents(detectors.Scaler(**pca.pop("scaler")), **pca)
        trees = [tuple(np.array(x) for x in tree) for tree in forest.pop("trees")]
        return cls(components=components, forest=detectors.IsolationForest(detectors.Scaler(**forest.pop("scaler")), trees, **forest), evidence=detectors.ModelEvidence(**plain.pop("evidence")), **plain)


def fit(feature_table: DataFrame, rows: int = detectors.DEVELOPMENT_ROWS, trees: int = 200) -> Artifacts:
    dev = materialize(detectors.development(feature_table, rows).withColumn("statistical_score", detectors.statistical_score()), "development")
    scaler = detectors.Scaler.fit(dev)
    components, forest = detectors.PrincipalComponents.fit(dev, scaler), detectors.IsolationForest.fit(dev, scaler, trees)
    scored = materialize(forest.score(components.score(dev)), "development-scores")
    evidence = detectors.ModelEvidence.fit(scored)
    families = fusion.fuse_v2(fusion.evidence_v2(scored.withColumn("model_evidence", evidence.v2())))
    limits = families.agg(*(F.percentile(c, detectors.PERCENTILE) for c in ("sudden_event_score", "persistent_fault_score"))).first()
    return Artifacts(detectors.threshold(dev, "statistical_score"), components, forest, evidence, float(limits[0]), float(limits[1]))


def feature_table(obs: DataFrame, semantics: str = "batch") -> DataFrame:
    """Cleaned observations as features, written once because fitting and scoring both read them."""
    return materialize(features.features(quality.clean(obs), semantics), "features")


def run(obs: DataFrame, artifacts: Artifacts | None = None, rows: int = detectors.DEVELOPMENT_ROWS) -> DataFrame:
    """The health table of all observations."""
    table = feature_table(obs)
    return health.track((artifacts or fit(table, rows)).fused(table))


def describe(artifacts: Artifacts) -> str:
    """Thresholds as JSON, for a report."""
    return json.dumps({"statistical": artifacts.statistical_threshold, "pca": artifacts.components.threshold, "isolation_forest": artifacts.forest.threshold, "sudden": artifacts.sudden_threshold, "persistent": artifacts.persistent_threshold, "components": len(artifacts.components.components)}, sort_keys=True)
