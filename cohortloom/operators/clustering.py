"""K-means customer clusters with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features"
CLUSTER = "clusters"


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def without_values(sample: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that no row of the sample has a value of, so that they have no mean to be imputed by."""
    counts = sample.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    return [c for c in columns if not counts[c]]


def feature_pipeline(scaled: Sequence[str], plain: Sequence[str] = (), weights: Mapping[str, float] | None = None) -> Pipeline:
    """Mean-impute and standardise ``scaled``, keep ``plain`` as it is, then weight features.

    Plain features are flags and counts whose nulls were filled before.
    """
    weights = weights or {}
    imputed = [f"_imputed_{c}" for c in scaled]
    factors = [float(weights.get(c, 1.0)) for c in [*scaled, *plain]]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=list(scaled), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
        VectorAssembler(inputCols=["_scaled", *plain], outputCol="_assembled"),
        ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol="_assembled", outputCol=FEATURES),
    ])


def vector_pipeline(column: str) -> Pipeline:
    """Standardise an array column of any length; all arrays of a table have the same length."""
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol=FEATURES)])


def kmeans(k: int, seed: int) -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol=CLUSTER)


def fit_clusters(df: DataFrame, pipeline: Pipeline, k: int, seed: int) -> PipelineModel:
    return Pipeline(stages=[*pipeline.getStages(), kmeans(k, seed)]).fit(df)


def assign_clusters(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Score every row in one pass and keep only the cluster next to the input columns."""
    return model.transform(df).select(*df.columns, CLUSTER)


def inertia_of_one(vectors: DataFrame) -> float:
    """Sum of squared distances to the common mean, which is k-means with k = 1."""
    stats = vectors.select(Summarizer.metrics("variance", "count").summary(F.col(FEATURES)).alias("s")).first()["s"]
    return float(sum(stats["variance"])) * max(int(stats["count"]) - 1, 0)


def centres(model: PipelineModel) -> list[list[float]]:
    """The centre of each cluster, by number."""
    return [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]


def scaling(model: PipelineModel, scaled: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, mean, sd) that a fitted ``feature_pipeline`` standardises by."""
    fitted = next(s for s in model.stages if isinstance(s, StandardScalerModel))
    rows = [(c, float(m), float(d)) for c, m, d in zip(scaled, fitted.mean, fitted.std, strict=True)]
    return spark.createDataFrame(rows, "feature string, mean double, sd double")


def inertia_by_feature(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, inertia): what each feature adds to the sum of squared distances to the common mean."""
    stats = vectors.select(Summarizer.metrics("variance", "count").summary(F.col(FEATURES)).alias("s")).first()["s"]
    spread = [float(v) * max(int(stats["count"]) - 1, 0) for v in stats["variance"]]
    return vectors.sparkSession.createDataFrame(list(zip(names, spread, strict=True)), "feature string, inertia double")


def misplaced(scored: DataFrame, middle: Sequence[Sequence[float]], tolerance: float = 1e-9) -> Column:
    """Whether a row of ``scored`` (vector and cluster) is nearer to another of the few centres than to its own."""
    place = vector_to_array(F.col(FEATURES))
    far = F.array(*[
        F.aggregate(F.zip_with(place, F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x) for c in middle
    ])
    return F.transform(F.array(far), lambda d: F.get(d, F.col(CLUSTER)) > F.array_min(d) * (1 + tolerance) + tolerance)[0]


def elbow_table(df: DataFrame, pipeline: Pipeline, most: int, seed: int) -> DataFrame:
    """Inertia for k = 1 .. most; the vectors are prepared once and kept for all fits."""
    vectors = pipeline.fit(df).transform(df).select(FEATURES).persist()
    rows = [(1, inertia_of_one(vectors))]
    for k in range(2, most + 1):
        rows.append((k, float(kmeans(k, seed).fit(vectors).summary.trainingCost)))
    vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
