"""Frame classifiers on MLlib: principal components, logistic regression and a projection of mean vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.operators.metrics import mean_vectors


def fit_pca(frames: DataFrame, variance: float = 0.95, vector: str = "vector") -> tuple[StandardScalerModel, PCAModel, int]:
    """A centring, the components, and how many of them keep ``variance``: the fewest whose shares reach it."""
    rows = frames.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    size = frames.select(F.max(F.size(vector))).first()[0]
    centre = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows)
    model = PCA(k=size, inputCol="__c", outputCol="__p").fit(centre.transform(rows))
    total, k = 0.0, 0
    for share in model.explainedVariance.toArray():
        if total >= variance:
            break
        total, k = total + float(share), k + 1
    return centre, model, k


def reduce_frames(frames: DataFrame, fitted: tuple[StandardScalerModel, PCAModel, int], vector: str = "vector") -> DataFrame:
    """``vector`` replaced by its first components, centred."""
    centre, model, k = fitted
    rows = frames.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    out = model.transform(centre.transform(rows)).withColumn(vector, F.slice(vector_to_array("__p"), 1, k))
    return out.drop("__v", "__c", "__p")


def fit_logreg(frames: DataFrame, vector: str = "vector", label: str = "phone", regularization: float = 0.01, rounds: int = 50) -> tuple[list[str], LogisticRegressionModel]:
    """Phones in the order of their ids (alphabetical) and a multinomial logistic regression."""
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(frames)
    rows = index.transform(frames).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="__v", labelCol="__y", regParam=regularization, maxIter=rounds, family="multinomial").fit(rows)
    return list(index.labels), model


def classify_frames(frames: DataFrame, fitted: tuple[list[str], LogisticRegressionModel], vector: str = "vector") -> DataFrame:
    """``probs`` (in the order of the fitted phones) and ``predicted``, the phone of the highest."""
    labels, model = fitted
    rows = model.setProbabilityCol("__q").transform(frames.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))))
    out = rows.withColumn("probs", vector_to_array("__q"))
    names = F.array(*map(F.lit, labels))
    best = F.array_position("probs", F.array_max("probs")) - 1
    return out.withColumn("predicted", F.get(names, best.cast("int"))).drop("__v", "__q", "rawPrediction", "prediction")


def project_2d(frames: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """``label, x, y``: the mean vectors of labels on their first two principal components (signs so that the first label is not negative)."""
    means = mean_vectors(frames, label, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda v: v["mean"]).alias(vector))
    centre, model, _ = fit_pca(means, 1.0, vector)
    out = reduce_frames(means, (centre, model, 2), vector).select(label, F.get(vector, F.lit(0)).alias("x"), F.get(vector, F.lit(1)).alias("y"))
    first = out.groupBy().agg(F.min_by("x", label).alias("fx"), F.min_by("y", label).alias("fy"))  # one row
    sign = lambda c: F.when(c < 0, -1.0).otherwise(1.0)
    return out.join(F.broadcast(first), F.lit(True), "inner").select(label, (F.col("x") * sign(F.col("fx"))).alias("x"), (F.col("y") * sign(F.col("fy"))).alias("y"))
