"""Anomalies, clusters, predictions and feature statistics of one daily table in one run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators import anomaly, clustering, prediction, stats
from dayloom.operators.impute import impute, robust_scale
from dayloom.operators.prep import clean, select_features
from dayloom.plans.reports import modeling_recommendations
from dayloom.session import cut_lineage

logger = logging.getLogger(__name__)


@dataclass
class ModelingRun:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def scaled_features(daily: DataFrame, *, preferred: Sequence[str] | None = prediction.GENERAL_FEATURES,
                    keys: Sequence[str] = ("day",), strategy: str = "median") -> tuple[DataFrame, list[str]]:
    """Cleaned, selected, imputed and robustly scaled features with the row keys."""
    cleaned = clean(daily)
    features = select_features(cleaned, preferred, min_values=50, exclude=keys)
    if len(features) < 3:
        raise ValueError(f"need at least 3 features, found {features}")
    filled = impute(cleaned, features, strategy).na.drop(subset=features)
    return cut_lineage(robust_scale(filled, features).select(*keys, *features)), features


def detect(daily: DataFrame, *, keys: Sequence[str] = ("day",), lof_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Votes per row and rates per detector."""
    rows, features = scaled_features(daily, keys=keys)
    labels = {
        "isolation_forest": anomaly.isolation_forest(rows, keys, features),
        "local_outlier_factor": anomaly.lof(rows, keys, features, k=lof_k),
        "mahalanobis": anomaly.mahalanobis(rows, keys, features),
    }
    votes = cut_lineage(anomaly.ensemble(labels, keys))
    return votes, anomaly.detector_rates(votes, [*labels, "ensemble"])


def run_modeling(
    daily: DataFrame, *, target: str = "score", subject_cols: Sequence[str] = (), day: str = "day",
    models: Sequence[str] = tuple(prediction.MODELS), clusterers=clustering.CLUSTERERS, lof_k: int = 20,
) -> ModelingRun:
    """Every part runs even if another fails; failures are listed under ``errors``."""
    run = ModelingRun()
    keys = [*subject_cols, day]

    def part(name: str, job: Callable[[], dict[str, DataFrame]]) -> None:
        try:
            run.frames.update(job())
        except Exception as e:  # noqa: BLE001 - parts are independent by contract
            logger.warning("%s failed: %s", name, e)
            run.errors[name] = str(e)

    def anomalies() -> dict[str, DataFrame]:
        votes, rates = detect(daily, keys=keys, lof_k=lof_k)
        return {"votes": votes, "detectors": rates}

    def clusters() -> dict[str, DataFrame]:
        rows, features = scaled_features(daily, keys=keys)
        table = cut_lineage(clustering.compare_clusterers(rows, features, clusterers))
        best = table.where("best").first()["clusterer"]
        profiles = clustering.cluster_profiles(clusterers[best](rows, features), features)
        return {"clusterings": table, "cluster_profiles": profiles}

    def predictions() -> dict[str, DataFrame]:
        frame, features = prediction.general_features(daily, target, day=day, subject_cols=subject_cols)
        results, importance = prediction.train_models(
            frame, features, target, models=models, day=day, subject_cols=subject_cols, scale="robust")
        return {"models": results, "importance": importance}

    part("features", lambda: {"features": stats.feature_stats(daily)})
    part("anomalies", anomalies)
    part("clusters", clusters)
    part("predictions", predictions)
    if "features" in run.frames:
        part("recommendations", lambda: {"recommendations": modeling_recommendations(
            features=run.frames["features"], detectors=run.frames.get("detectors"),
            clusterings=run.frames.get("clusterings"), models=run.frames.get("models"))})
    return run


def best_model(results: DataFrame) -> DataFrame:
    return results.where(F.col("best"))
