"""Model fitting and scoring with Spark ML.

A fit iterates over folds, arms or seeds, a handful each; every fit and every
scoring is a Spark job over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.labels import hazard_combine
from panelyard.operators.metrics import average_precision, brier_score, expected_calibration_error

#: Trees are kept few and shallow; raise for real fits.
ROUNDS, DEPTH = 5, 3


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prepared(columns: Sequence[str]) -> list:
    """Median imputation and assembly of the feature vector."""
    return [Imputer(strategy="median", inputCols=list(columns), outputCols=[f"_f_{c}" for c in columns]), VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="features")]


def weighted(df: DataFrame, y: str = "y") -> DataFrame:
    """``_weight``: positives count as much as negatives do."""
    ratio = df.agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("_r"))
    return df.crossJoin(F.broadcast(ratio)).withColumn("_weight", F.when(F.col(y) == 1, F.col("_r")).otherwise(1.0)).drop("_r")


def boosted(columns: Sequence[str], seed: int, y: str = "y", params: dict | None = None) -> Pipeline:
    """Boosted trees; ``params`` override those of the classifier by their Spark names."""
    own = {"maxIter": ROUNDS, "maxDepth": DEPTH, "subsamplingRate": 0.85} | (params or {})
    return Pipeline(stages=[*prepared(columns), GBTClassifier(labelCol=y, weightCol="_weight", seed=seed, **own)])


def probability(scored: DataFrame, name: str = "p") -> DataFrame:
    """The probability of class 1 as a column, helper columns gone."""
    out = scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "_weight")
    return out.select(*(c for c in out.columns if not c.startswith("_f_")))


def seed_ensemble(train: DataFrame, columns: Sequence[str], seeds: Sequence[int], y: str = "y", params: dict | None = None) -> list[PipelineModel]:
    """Boosted trees that differ by seed."""
    rows = weighted(train, y)
    return [boosted(columns, s, y, params).fit(rows) for s in seeds]


def ensemble_score(models: Sequence[PipelineModel], df: DataFrame, name: str = "p") -> DataFrame:
    """Mean probability of the models."""
    for k, m in enumerate(models):
        df = probability(m.transform(df), f"_p{k}")
    mean = sum((F.col(f"_p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return df.withColumn(name, mean).drop(*(f"_p{k}" for k in range(len(models))))


def feature_importance(models: Sequence[PipelineModel], columns: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, gain) summed over the models, the largest first."""
    total = [sum(float(m.stages[-1].featureImportances[i]) for m in models) for i in range(len(columns))]
    return like.sparkSession.createDataFrame(list(zip(columns, total, strict=True)), "feature string, gain double").orderBy(F.desc("gain"), "feature")


def oof_predictions(df: DataFrame, columns: Sequence[str], folds: Sequence[int], seeds: Sequence[int] = (1,), year: str = "yr", fit: Callable | None = None) -> DataFrame:
    """Rows of each fold year scored by a model of all earlier years, with ``fold``."""
    fit = fit or seed_ensemble
    parts = []
    for fold in folds:
        models = fit(df.where(F.col(year) < fold), columns, seeds)
        parts.append(ensemble_score(models, df.where(F.col(year) == fold)).withColumn("fold", F.lit(fold)))
    return stack(parts)


def isotonic_calibration(oof: DataFrame, rows: DataFrame, low: float = 0.001, high: float = 0.999, y: str = "y", p: str = "p") -> DataFrame:
    """``q``: isotonic fit of the label on out-of-fold scores, within bounds, flat outside."""
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="_iso").fit(oof.select(p, F.col(y).cast("double").alias(y)))
    return model.transform(rows).withColumn("q", F.least(F.greatest("_iso", F.lit(low)), F.lit(high))).drop("_iso")


def calibration_report(df: DataFrame, before: str = "p", after: str = "q", y: str = "y") -> DataFrame:
    """Calibration error, Brier score, average precision and n of two score columns."""
    def report(c: str) -> DataFrame:
        one = df.withColumn("_one", F.lit(1))
        return (
            expected_calibration_error(df, 15, y, c).crossJoin(brier_score(df, (), y, c)).crossJoin(average_precision(one, ["_one"], y, c).select("ap"))
            .crossJoin(df.agg(F.count("*").alias("n"))).withColumn("score", F.lit(c))
        )

    return report(before).unionByName(report(after))


def blend(train: DataFrame, rows: DataFrame, columns: Sequence[str], weight: float = 0.5, seed: int = 1) -> DataFrame:
    """``p``: a classifier, and a regressor of the log peak brought to probabilities by an isotonic bridge, mixed by weight."""
    classified = probability(boosted(columns, seed).fit(weighted(train)).transform(rows), "_pc")
    regressor = Pipeline(stages=[*prepared(columns), GBTRegressor(labelCol="log_peak", maxIter=ROUNDS, maxDepth=DEPTH, seed=seed, predictionCol="_peak")]).fit(train.where("log_peak is not null"))
    clean = lambda df: df.select(*(c for c in df.columns if c != "features" and not c.startswith("_f_")))
    bridge = IsotonicRegression(featuresCol="_peak", labelCol="y", predictionCol="_pr").fit(clean(regressor.transform(train)).withColumn("y", F.col("y").cast("double")))
    both = bridge.transform(clean(regressor.transform(classified)))
    bridged = F.least(F.greatest("_pr", F.lit(1e-4)), F.lit(1 - 1e-4))
    return both.withColumn("p", weight * F.col("_pc") + (1 - weight) * bridged).drop("_pc", "_peak", "_pr")


def screening_models(train: DataFrame, rows: DataFrame, columns: Sequence[str], seed: int = 1) -> DataFrame:
    """(.., model, p) of a logistic, a boosted and a small neural model."""
    scale = [*prepared(columns), StandardScaler(inputCol="features", outputCol="_f_scaled", withMean=True)]
    models = {
        "logistic": Pipeline(stages=[*scale, LogisticRegression(featuresCol="_f_scaled", labelCol="y", maxIter=20, regParam=0.01)]),
        "boosted": boosted(columns, seed),
        "network": Pipeline(stages=[*scale, MultilayerPerceptronClassifier(featuresCol="_f_scaled", labelCol="y", layers=[len(columns), 6, 2], maxIter=20, seed=seed)]),
    }
    return stack([probability(m.fit(weighted(train)).transform(rows)).withColumn("model", F.lit(name)) for name, m in models.items()])


def sigmoid_calibration(train: DataFrame, rows: DataFrame, least: int = 8, y: str = "y", p: str = "p") -> DataFrame:
    """``q``: Platt scaling of the logit, or the score itself if the smaller class has too few rows."""
    few = train.agg(F.least(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).alias("n")).first()["n"]
    if few < least:
        return rows.withColumn("q", F.col(p))
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda df: df.withColumn("_logit", F.log(clipped / (1 - clipped)))
    model = Pipeline(stages=[VectorAssembler(inputCols=["_logit"], outputCol="features"), LogisticRegression(labelCol=y, maxIter=25)]).fit(logit(train))
    return probability(model.transform(logit(rows)), "q").drop("_logit")


def tweedie_regression(train: DataFrame, rows: DataFrame, columns: Sequence[str], target: str, power: float = 1.3) -> DataFrame:
    """``predicted``: Tweedie regression with a log link."""
    model = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=target, maxIter=10, regParam=1.0, predictionCol="predicted")
    scale = StandardScaler(inputCol="features", outputCol="_f_scaled", withMean=True)
    fitted = Pipeline(stages=[*prepared(columns), scale, model.setFeaturesCol("_f_scaled")]).fit(train.where(F.col(target).isNotNull()))
    out = fitted.transform(rows)
    return out.select(*(c for c in out.columns if c != "features" and not c.startswith("_f_")))


def hazard_model(train: DataFrame, rows: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int = 1) -> DataFrame:
    """Weekly hazards fitted with the week ahead as a feature, combined to one risk for each key."""
    model = boosted([*columns, "k"], seed, "hazard_y").fit(weighted(train, "hazard_y"))
    return hazard_combine(probability(model.transform(rows)), list(keys))


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], baseline: str, seed: int = 1) -> DataFrame:
    """(group, y, p) for models on groups of features, and the baseline score itself."""
    parts = [test.select(F.lit("persistence").alias("group"), "y", F.col(baseline).cast("double").alias("p"))]
    for name, columns in groups.items():
        scored = probability(boosted(columns, seed).fit(weighted(train)).transform(test))
        parts.append(scored.select(F.lit(name).alias("group"), "y", "p"))
    return stack(parts)


def transfer_eval(source: DataFrame, local: DataFrame, target: DataFrame, columns: Sequence[str], baseline: str, seed: int = 1) -> DataFrame:
    """(arm, y, p) on the target rows: baseline, a model of the source population, one of local rows."""
    parts = [target.select(F.lit("persistence").alias("arm"), "y", F.col(baseline).cast("double").alias("p"))]
    for name, rows in (("zero_shot", source), ("local", local)):
        parts.append(probability(boosted(columns, seed).fit(weighted(rows)).transform(target)).select(F.lit(name).alias("arm"), "y", "p"))
    return stack(parts)


@dataclass(frozen=True)
class Arm:
    """A candidate: its features, parameters that override those of the classifier, and seeds of its ensemble."""

    columns: Sequence[str]
    params: dict = field(default_factory=dict)
    seeds: Sequence[int] = (1,)


def candidate_search(df: DataFrame, arms: dict[str, Arm | Sequence[str]], folds: Sequence[int], keep: Sequence[str], baseline: str, year: str = "yr") -> DataFrame:
    """(arm, fold, keep.., y, p): out-of-fold scores of each arm, the baseline as an arm of its own.

    Arms may differ by features, by parameters or by both; a bare list of columns has the default parameters.
    """
    parts = []
    for name, arm in arms.items():
        arm = arm if isinstance(arm, Arm) else Arm(arm)
        fit = lambda train, columns, seeds, params=arm.params: seed_ensemble(train, columns, seeds, params=params)
        parts.append(oof_predictions(df, arm.columns, folds, arm.seeds, year, fit).select(F.lit(name).alias("arm"), "fold", *keep, "y", "p"))
    base = df.where(F.col(year).isin(list(folds))).select(F.lit("baseline").alias("arm"), F.col(year).cast("int").alias("fold"), *keep, "y", F.col(baseline).cast("double").alias("p"))
    return stack([*parts, base])


def arm_table(long: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(arm, fold, ap, gain over the baseline arm of the fold); fold -1 holds all folds pooled."""
    pooled = long.withColumn("fold", F.explode(F.array("fold", F.lit(-1))))
    ap = average_precision(pooled, ["arm", "fold"])
    base = ap.where(F.col("arm") == baseline).select("fold", F.col("ap").alias("_base"))
    # a row for each fold
    return ap.join(F.broadcast(base), "fold", "left").select("arm", "fold", "ap", (F.col("ap") - F.col("_base")).alias("gain"))


def with_risk(df: DataFrame, models: Sequence[PipelineModel], name: str, where: Column | None = None) -> DataFrame:
    """A model's risk as a column; null on rows that the model is not asked about."""
    scored = ensemble_score(models, df, name)
    return scored if where is None else scored.withColumn(name, F.when(where, F.col(name)))
