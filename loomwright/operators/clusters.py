"""Clusters of vectors: reduction, k-means, comparison of settings, statistics of assignments."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import corpus as C

SEED, CLUSTERS, COMPONENTS = 42, 6, 20


def combined(a: Column, b: Column) -> Column:
    """Both vectors at unit length, one after the other."""
    return F.concat(C.unit(a), C.unit(b))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors (an array of arrays) whose mask is not 0; zeros where all are masked."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def one_encoder(df: DataFrame, column: str = "image_encoder") -> DataFrame:
    """``df``; vectors of more than one encoder are an error."""
    if df.select(column).distinct().limit(2).count() > 1:
        raise ValueError("vectors come from more than one encoder")
    return df


def reduced(df: DataFrame, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, PCAModel, list[float]]:
    """(``df`` with reduced, the model, shares of the variance) of the principal components of centred vectors."""
    size = df.select(F.size(vector)).first()[0]
    ready = df.withColumn("_vector", array_to_vector(F.col(vector)))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_vector", outputCol="_centred").fit(ready)
    model = PCA(k=min(components, size), inputCol="_centred", outputCol="_reduced").fit(centre.transform(ready))
    out = model.transform(centre.transform(ready)).withColumn("reduced", vector_to_array("_reduced")).drop("_vector", "_centred", "_reduced")
    return out, model, model.explainedVariance.toArray().tolist()


def k_means(df: DataFrame, vector: str, k: int = CLUSTERS, seed: int = SEED) -> tuple[DataFrame, KMeansModel]:
    """(``df`` with cluster, the model, which ``assigned`` uses for other tables and streams)."""
    ready = df.withColumn("_vector", array_to_vector(F.col(vector)))
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster").fit(ready)
    return assigned(df, vector, model), model


def assigned(df: DataFrame, vector: str, model: KMeansModel) -> DataFrame:
    return model.transform(df.withColumn("_vector", array_to_vector(F.col(vector)))).drop("_vector")


def silhouette(df: DataFrame, vector: str, cluster: str = "cluster") -> float | None:
    """Of rows that are no noise; None with fewer than two clusters."""
    rows = df.where(F.col(cluster) >= 0).withColumn("_vector", array_to_vector(F.col(vector)))
    if rows.select(cluster).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="_vector", predictionCol=cluster).evaluate(rows)


def compared(df: DataFrame, vector: str, components: list[int], clusters: list[int]) -> DataFrame:
    """components, clusters, silhouette, noise of every setting, best first."""
    rows = []
    for n in components:
        small, *_ = reduced(df, vector, n)
        for k in clusters:
            found, _ = k_means(small, "reduced", k)
            rows.append((n, k, silhouette(found, "reduced"), 0.0))
    table = df.sparkSession.createDataFrame(rows, "components int, clusters int, silhouette double, noise double")
    return ranked_settings(table)


def ranked_settings(table: DataFrame) -> DataFrame:
    """Settings with a silhouette, by silhouette and then by least noise."""
    return table.dropna(subset=["silhouette"]).orderBy(F.desc("silhouette"), "noise")


def cluster_statistics(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """clusters, noise_rows, noise_share."""
    noise = F.col(cluster) < 0
    return df.agg(F.count_distinct(F.when(~noise, F.col(cluster))).alias("clusters"), F.count_if(noise).alias("noise_rows"), F.avg(noise.cast("double")).alias("noise_share"))


def exemplars(df: DataFrame, cluster: str, probability: str, id_: str, n: int = 20) -> DataFrame:
    """The rows of each cluster with the highest membership; noise has none."""
    return C.per_class(df.where(F.col(cluster) >= 0), cluster, n, F.desc(probability), F.col(id_))
