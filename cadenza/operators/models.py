"""Fitted models: feature pipelines, classifiers with balanced weights, fusion and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import number
from ..storage import stored
from .sampling import balanced_weights

#: Rows of a class that one task orders.
SLICE_ROWS = 200_000


def numeric_features(df: DataFrame, known: Sequence[str], prefix: str = "w2v_") -> list[str]:
    """PR-18, PR-19: the known numeric columns that the frame has, and all with a prefix."""
    return [c for c in known if c in df.columns] + [c for c in df.columns if c.startswith(prefix)]


def classifier(kind: str, seed: int = 42, layers: Sequence[int] = ()):
    """ML-09, ML-21, ML-61: logistic regression, random forest, boosted trees, or a perceptron; extremely randomised trees (ML-19) are in ``trees``."""
    common = {"featuresCol": "features", "labelCol": "_label"}
    if kind == "logistic":
        return LogisticRegression(**common, weightCol="_weight", maxIter=100, regParam=1e-3, elasticNetParam=0.0)
    if kind == "forest":
        return RandomForestClassifier(**common, weightCol="_weight", numTrees=100, maxDepth=10, minInstancesPerNode=10, seed=seed)
    if kind == "boosted":
        return GBTClassifier(**common, weightCol="_weight", maxIter=30, maxDepth=4, seed=seed)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(**common, layers=list(layers), maxIter=100, seed=seed)
    raise ValueError(f"unknown classifier {kind!r}")


def preprocessor(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """ML-01, ML-08, ML-18, ML-63: median imputation and scaling, one-hot categories with unknown ones as nothing."""
    filled, coded, hot = [f"_f_{c}" for c in numeric], [f"_i_{c}" for c in categorical], [f"_h_{c}" for c in categorical]
    stages: list = []
    if numeric:
        stages += [
            Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_numeric"),
            StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True),
        ]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep"), OneHotEncoder(inputCols=coded, outputCols=hot)]
    return [*stages, VectorAssembler(inputCols=["_scaled"] * bool(numeric) + hot, outputCol="features")]


def prepared(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """ML-58: missing numeric columns as null, missing categories as '', all cast."""
    values = {c: number(c) if c in df.columns else F.lit(None).cast("double") for c in numeric}
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in categorical}
    return df.withColumns({**values, **texts})


def fit(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic") -> PipelineModel:
    """ML-09, ML-18, ML-21, ML-23, ML-29, ML-32, ML-64: a balanced classifier on prepared columns."""
    rows = balanced_weights(prepared(df, numeric, categorical).withColumn("_label", F.col(label).cast("double")).where("_label IS NOT NULL"), "_label")
    return Pipeline(stages=[*preprocessor(numeric, categorical), classifier(kind)]).fit(rows.withColumnRenamed("weight", "_weight"))


def scored(model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), name: str = "score", of: int = 1) -> DataFrame:
    """ML-34, ML-52, ML-55..59, ML-62, ML-67: the probability of a class for every row."""
    kept = df.columns
    out = model.transform(prepared(df, numeric, categorical))
    return out.select(*[F.col(c) for c in kept if c != name], vector_to_array("probability")[of].alias(name))


def coefficients(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """ML-65: coefficients of a logistic regression, the largest first."""
    values = model.stages[-1].coefficients.toArray().tolist()
    return sorted(zip(names, values), key=lambda x: -abs(x[1]))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """ML-36: df with a column fold: the folds of a class differ by one row at most.

    Rows of a class are ordered by md5 of 'seed:key', then key. They are cut into slices by the hash, as many that a slice has about ``slice_rows`` rows;
    a row's rank is its place in its slice and the rows of the slices before. So no task orders a whole class. Null labels are a class of their own;
    null keys are the key ''; rows of one key take neighbouring ranks.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("_slices"))
    hashed = df.withColumns({"_h": digest, "_p": place, "_y": F.col(label)})
    dealt = hashed.join(sizes, F.col("_y").eqNullSafe(F.col("_l"))).withColumn("_s", F.floor(F.col("_p") * F.col("_slices"))).drop("_l", "_p", "_slices")
    counts = dealt.groupBy(F.col("_y").alias("_l"), F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per slice
    inner = F.row_number().over(Window.partitionBy("_y", "_s").orderBy("_h", key))
    ranked = dealt.withColumn("_r", inner).join(before.drop("_n"), F.col("_y").eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t")))
    return ranked.withColumn("fold", ((F.col("_r") + F.col("_before") - 1) % folds).cast("int")).drop("_h", "_y", "_s", "_r", "_l", "_t", "_before")


def out_of_fold(df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), folds: int = 5, seed: int = 42) -> DataFrame:
    """ML-36: each row scored by a model that was fitted on the other folds, whose classes are spread evenly.

    There are as many folds as the least class has rows, ``folds`` at most; a class of one row leaves one model over all rows.
    """
    least = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0  # one row
    folds = min(folds, least)
    if folds < 2:
        return scored(fit(df, label, numeric, categorical), df, numeric, categorical)
    marked = stored(stratified_folds(df, key, label, folds, seed).withColumnRenamed("fold", "_fold"), "folds")
    parts = None
    for k in range(folds):
        model = fit(marked.where(F.col("_fold") != k), label, numeric, categorical)
        part = scored(model, marked.where(F.col("_fold") == k), numeric, categorical)
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("_fold")


def calibrated(df: DataFrame, model: PipelineModel | None, numeric: Sequence[str]) -> DataFrame:
    """ML-35: the calibrator's probability, or 0.5 and calibration_available false without one."""
    if model is None:
        return df.withColumns({"manual_calibrated_error_probability": F.lit(0.5), "calibration_available": F.lit(False)})
    return scored(model, df, numeric, name="manual_calibrated_error_probability").withColumn("calibration_available", F.lit(True))


def majority(df: DataFrame, label: str) -> Column:
    """ML-53: the most frequent label as a constant; ties go to the greater."""
    best = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(label)).first()
    return F.lit(best[label] if best else None)
