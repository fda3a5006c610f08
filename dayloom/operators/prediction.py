"""Sleep-score regressors: feature table, chronological evaluation, importances.

Imputation and scaling are stages of the fitted pipeline, so they learn from
training rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions.temporal import duration_minutes
from dayloom.operators.daily import rolling_mean, subject_window
from dayloom.operators.linear import PENALTIES, expanding_models
from dayloom.operators.prep import interactions, select_features
from dayloom.operators.stats import chronological_split, expanding_folds
from dayloom.session import cut_lineage
from pyspark.sql import types as T

# Features of the general model, and those of the sleep model with its lagged ones.
GENERAL_FEATURES = (
    "hr_min", "hr_max", "rhr", "steps", "calories_total", "distance", "moderate_activity_time", "vigorous_activity_time",
    "intensity_time", "stress_avg", "resting_heart_rate", "hr_avg", "steps_avg_7d")
SLEEP_FEATURES = (
    "hr_min", "hr_max", "rhr", "hr_avg", "inactive_hr_avg", "inactive_hr_min", "inactive_hr_max",
    "steps", "moderate_activity_time", "vigorous_activity_time", "intensity_time", "distance", "calories_active",
    "yesterday_had_workout", "yesterday_activity_minutes", "yesterday_activity_calories", "yesterday_training_effect",
    "yesterday_anaerobic_te", "floors",
    "stress_avg", "bb_max", "bb_min", "steps_avg_7d")
SLEEP_LAGGED = ("rhr", "hr_avg", "steps", "stress_avg", "bb_max")


def general_features(
    daily: DataFrame, target: str = "score", *, features: Sequence[str] = GENERAL_FEATURES, day: str = "day",
    subject_cols: Sequence[str] = (), lags: bool = True, rolling: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Lags 1 and 7, means of 7 and 30 rows and interactions; numeric columns with at least 20 values."""
    out = daily
    w = subject_window(day, subject_cols)
    present = [c for c in features if c in daily.columns and isinstance(daily.schema[c].dataType, T.NumericType)]
    if lags:
        out = out.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in present for n in (1, 7)})
    if rolling:
        for c in present:
            for n in (7, 30):
                out = rolling_mean(out, c, n, f"{c}_rolling_{n}d", day=day, subject_cols=subject_cols)
    out = interactions(out)
    chosen = select_features(out, min_values=20, exclude=[target, *subject_cols], skip_time_names=True)
    if len(chosen) < 3:
        raise ValueError(f"need at least 3 numeric features, found {chosen}")
    return out.where(F.col(target).isNotNull()), chosen


def sleep_features(daily: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (),
                   target: str = "score") -> tuple[DataFrame, list[str]]:
    """The named features that exist, text durations as minutes, and lag 1 of five of them.

    The lag is the previous day with data, or the day's own value on the first
    day; it is taken before rows without target are dropped.
    """
    present = [c for c in SLEEP_FEATURES if c in daily.columns]
    text = [c for c in present if isinstance(daily.schema[c].dataType, T.StringType)]
    out = daily.withColumns({c: duration_minutes(c) for c in text}) if text else daily
    w = subject_window(day, subject_cols)
    lagged = [c for c in SLEEP_LAGGED if c in present]
    out = out.withColumns({f"{c}_lag1": F.coalesce(F.lag(c).over(w), F.col(c)) for c in lagged}) if lagged else out
    return out.where(F.col(target).isNotNull()), present + [f"{c}_lag1" for c in lagged]


def linear(target: str, *, reg: float = 0.0, l1: float = 0.0) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol=target, regParam=reg, elasticNetParam=l1,
                            standardization=False, maxIter=200, tol=1e-8)


def random_forest(target: str, *, trees: int = 100, depth: int = 10, min_rows: int = 2, seed: int = 42) -> Estimator:
    """``min_rows`` is per leaf; Spark has no limit for the rows of a node that is split."""
    return RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth,
                                 minInstancesPerNode=min_rows, seed=seed)


def gradient_boosting(target: str, *, rounds: int = 100, rate: float = 0.1, depth: int = 5, seed: int = 42) -> Estimator:
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)


ModelFactory = Callable[[str, int], Estimator]      # target, training rows

# The six models.  A ridge penalty of 1 on the sum of squares is 1/n on their mean.
MODELS: Mapping[str, ModelFactory] = {
    "linear": lambda y, n: linear(y),
    "ridge": lambda y, n: linear(y, reg=1.0 / max(n, 1), l1=0.0),
    "lasso": lambda y, n: linear(y, reg=0.1, l1=1.0),
    "elastic_net": lambda y, n: linear(y, reg=0.1, l1=0.5),
    "random_forest": lambda y, n: random_forest(y),
    "gradient_boosting": lambda y, n: gradient_boosting(y),
}
# The deeper forest and boosting of the general model.
DEEP_MODELS: Mapping[str, ModelFactory] = {
    "random_forest_deep": lambda y, n: random_forest(y, depth=20, min_rows=1),
    "gradient_boosting_deep": lambda y, n: gradient_boosting(y, depth=6),
}
ALL_MODELS: Mapping[str, ModelFactory] = {**MODELS, **DEEP_MODELS}
LINEAR_MODELS = tuple(PENALTIES)
TREE_MODELS = tuple(m for m in ALL_MODELS if m not in PENALTIES)

# Grids of the tuned models; the least size of a node that is split is left out, as Spark has no such limit.
FOREST_GRID = {"trees": (100, 200), "depth": (10, 20, 30), "min_rows": (1, 2)}     # 30 is the deepest that Spark grows
BOOSTING_GRID = {"rounds": (100, 200), "rate": (0.01, 0.1), "depth": (3, 6)}


def pipeline(features: Sequence[str], model: Estimator, *, impute: str | None = "median", scale: str = "standard") -> Pipeline:
    """Impute, assemble, scale, fit.  ``impute``: median, mean or None (rows with gaps must be gone)."""
    stages, columns = [], list(features)
    if impute:
        columns = [f"{c}__filled" for c in features]
        stages.append(Imputer(strategy=impute, inputCols=list(features), outputCols=columns, relativeError=0.0001))
    stages.append(VectorAssembler(inputCols=columns, outputCol="raw_features"))
    scaler = (RobustScaler(inputCol="raw_features", outputCol="features", withCentering=True, relativeError=0.0001)
              if scale == "robust" else StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, scaler, model])


def scores(predicted: DataFrame, target: str) -> dict[str, float]:
    """MSE, RMSE, MAE and R2 in one pass."""
    error = F.col(target) - F.col("prediction")
    row = predicted.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(target).alias("var"),
        F.count("*").alias("n")).first()
    if not row["n"]:
        return {"mse": float("nan"), "rmse": float("nan"), "mae": float("nan"), "r2": float("nan")}
    r2 = 1 - row["mse"] / row["var"] if row["var"] else (1.0 if row["mse"] == 0 else 0.0)
    return {"mse": row["mse"], "rmse": row["mse"] ** 0.5, "mae": row["mae"], "r2": r2}


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[float]:
    """Tree importances or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [abs(float(v)) for v in values.toArray()]


def usable(frame: DataFrame, features: Sequence[str], target: str, impute: str | None) -> DataFrame:
    out = frame.withColumns({c: F.col(c).cast("double") for c in [*features, target]})
    return out if impute else out.na.drop(subset=list(features))


def cross_validate(train: DataFrame, features: Sequence[str], target: str, factory: ModelFactory, *, folds: int = 5,
                   impute: str | None = "median", scale: str = "standard") -> dict[str, float]:
    """Mean and population deviation of the MSE over expanding folds of a frame that has ``fold``."""
    losses = []
    for f in range(1, folds + 1):
        past, now = train.where(F.col("fold") < f), train.where(F.col("fold") == f)
        fitted = pipeline(features, factory(target, past.count()), impute=impute, scale=scale).fit(past)
        losses.append(scores(fitted.transform(now), target)["mse"])
    return {"cv_mse": float(np.mean(losses)), "cv_std": float(np.std(losses))}


RESULT_DDL = ("model string, train_mse double, train_mae double, train_r2 double, test_mse double, test_rmse double, "
              "test_mae double, test_r2 double, cv_mse double, cv_std double")


def train_models(
    frame: DataFrame, features: Sequence[str], target: str = "score", *, models: Sequence[str] = tuple(MODELS),
    day: str = "day", subject_cols: Sequence[str] = (), folds: int = 5, impute: str | None = "median",
    scale: str = "standard",
) -> tuple[DataFrame, DataFrame]:
    """Fit on the first 80 % of each subject's days, test on the rest.

    Returns the result table, with ``best`` at the highest test R2, and the
    importance of every feature in every model.  Linear models on standardised
    features take their folds from one scan of moments (``operators/linear.py``);
    trees, and linear models on robustly scaled features, are Spark ML pipelines.
    """
    unknown = [m for m in models if m not in ALL_MODELS]
    if unknown:
        raise ValueError(f"no models {unknown}")
    split = chronological_split(usable(frame, features, target, impute), day=day, subject_cols=subject_cols)
    split = split.select(*subject_cols, day, *features, target, "is_train")
    folded = expanding_folds(split.where("is_train"), folds, day=day, subject_cols=subject_cols)
    data = cut_lineage(folded.unionByName(split.where(~F.col("is_train")).withColumn("fold", F.lit(-1))))
    by_moments = [m for m in models if m in PENALTIES] if scale == "standard" else []
    results, weights = [], []
    if by_moments:
        results, fitted = expanding_models(data, features, target, by_moments, folds=folds, impute=impute)
        weights = [(name, f, float(abs(w))) for name, model in fitted.items() for f, w in zip(features, model.standard)]
    train, test = data.where("fold >= 0"), data.where("fold < 0")
    pipelines = [m for m in models if m not in by_moments]
    n = train.count() if pipelines else 0
    for name in pipelines:
        model = pipeline(features, ALL_MODELS[name](target, n), impute=impute, scale=scale).fit(train)
        a, b = scores(model.transform(train), target), scores(model.transform(test), target)
        cv = cross_validate(train, features, target, ALL_MODELS[name], folds=folds, impute=impute, scale=scale)
        results.append((name, a["mse"], a["mae"], a["r2"], b["mse"], b["rmse"], b["mae"], b["r2"], cv["cv_mse"], cv["cv_std"]))
        weights += [(name, f, w) for f, w in zip(features, feature_importance(model, features))]
    spark = frame.sparkSession
    table = spark.createDataFrame(results, RESULT_DDL)
    best = table.agg(F.max_by("model", "test_r2")).scalar()
    return (table.withColumn("best", F.col("model") == best),
            spark.createDataFrame(weights, "model string, feature string, importance double"))


def top_features(importance: DataFrame, model: str, n: int = 20) -> DataFrame:
    return (importance.where(F.col("model") == model).orderBy(F.desc("importance"), "feature").limit(n)
            .select("feature", "importance"))


def grid_search(
    frame: DataFrame, features: Sequence[str], target: str, build: Callable[..., Estimator],
    grid: Mapping[str, Sequence], *, day: str = "day", subject_cols: Sequence[str] = (), folds: int = 3,
) -> DataFrame:
    """Cross-validated MSE of every combination on expanding folds; ``best`` marks the lowest."""
    data = cut_lineage(expanding_folds(usable(frame, features, target, "median"), folds, day=day,
                                       subject_cols=subject_cols).select(*features, target, "fold"))
    rows = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        cv = cross_validate(data, features, target, lambda y, n: build(y, **params), folds=folds)
        rows.append(({k: str(v) for k, v in params.items()}, cv["cv_mse"], cv["cv_std"]))
    table = frame.sparkSession.createDataFrame(rows, "params map<string,string>, cv_mse double, cv_std double")
    lowest = table.agg(F.min("cv_mse")).scalar()
    return table.withColumn("best", F.col("cv_mse") == lowest)


GRIDS: Mapping[str, tuple[Callable[..., Estimator], Mapping[str, Sequence]]] = {
    "random_forest": (random_forest, FOREST_GRID), "gradient_boosting": (gradient_boosting, BOOSTING_GRID)}


def tuned(frame: DataFrame, features: Sequence[str], target: str, family: str, *, grid: Mapping[str, Sequence] | None = None,
          day: str = "day", subject_cols: Sequence[str] = (), folds: int = 3) -> DataFrame:
    """``grid_search`` of a tree family over its fixed grid, or over part of it."""
    build, whole = GRIDS[family]
    return grid_search(frame, features, target, build, grid or whole, day=day, subject_cols=subject_cols, folds=folds)


def tree_nodes(model, path: str) -> DataFrame:
    """A fitted forest or boosting as rows: ``tree, node, feature, cut, left, right, prediction, gain, rows, weight``.

    The model is written to ``path`` (a folder that all executors reach) in the
    format of Spark ML and read back; leaves have feature -1.  Rows go left where
    the feature is at most ``cut``.  ``weight`` is the tree's share in the sum.
    """
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    n = "nodeData." if "nodeData" in spark.read.parquet(f"{path}/data").columns else ""
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{n}id").alias("node"), F.col(f"{n}split.featureIndex").alias("feature"),
        F.get(F.col(f"{n}split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut"), F.col(f"{n}leftChild").alias("left"), F.col(f"{n}rightChild").alias("right"),
        F.col(f"{n}prediction").alias("prediction"), F.col(f"{n}gain").alias("gain"), F.col(f"{n}rawCount").alias("rows"))
    return nodes.join(F.broadcast(weights), "tree")


def importance_of_nodes(nodes: DataFrame, features: Sequence[str], *, per_tree: bool = True) -> DataFrame:
    """``feature, importance``: gains times rows of the nodes that split by a feature, scaled to 1.

    ``per_tree`` scales each tree before, as forests do and boosting does not.
    """
    gains = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    whole = gains.groupBy("tree").agg(F.sum("g").alias("t"))
    scaled = F.when(F.col("t") > 0, F.col("g") / F.col("t")) if per_tree else F.col("g")
    share = gains.join(whole, "tree").groupBy("feature").agg(F.sum(scaled).alias("s"))
    names = nodes.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "at int, name string")
    out = names.join(share, F.col("at") == F.col("feature"), "left").select(F.col("name").alias("feature"), F.coalesce("s", F.lit(0.0)).alias("s"))
    return out.withColumn("importance", F.try_divide("s", F.sum("s").over(Window.partitionBy()))).drop("s")     # one row per feature
