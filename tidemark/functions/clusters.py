"""Clusters of members by their features: robust scaling, k-means, and a composite of quantiles where k-means can't say anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.names import spare
from tidemark.operators.quantiles import quantiles, with_quantiles

CLIP = 8.0


def robust_scaled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with <column>_z: distance from the median in interquartile ranges, at most CLIP either way; 0 for null, and where there is no range."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    # one row: an array of quartiles a column
    stats = quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]).agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("q"))
    (held,) = spare(rows, "_quartiles")
    out = rows.crossJoin(F.broadcast(stats.withColumnRenamed("q", held)))
    for c in columns:
        q = F.try_element_at(F.col(held), F.lit(c))
        z = (F.col(c) - q[1]) / F.nullif(q[2] - q[0], F.lit(0.0))
        out = out.withColumn(f"{c}_z", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.coalesce(z, F.lit(0.0)))))
    return out.drop(held)


def composite(rows: DataFrame, columns: Sequence[str], k: int, name: str = "cluster") -> DataFrame:
    """rows (scaled) with the quantile bin 0 to k - 1 of the mean of their scaled features: clusters without an iteration."""
    score = sum((F.col(f"{c}_z") for c in columns), F.lit(0.0)) / len(columns)
    x = rows.withColumn("score", score)
    (cuts,) = spare(x, "_q")
    return with_quantiles(x, [], "score", [i / k for i in range(1, k)], cuts).withColumn(name, F.size(F.filter(cuts, lambda q: q < F.col("score")))).drop(cuts)


def k_means(rows: DataFrame, columns: Sequence[str], k: int, seed: int = 7, name: str = "cluster") -> DataFrame:
    """rows (scaled) with their k-means cluster; clusters are numbered by their centres' sums, so that a rerun gives the same numbers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[f"{c}_z" for c in columns], outputCol="_v").transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=50).fit(x)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: (float(model.clusterCenters()[i].sum()), i))
    number = F.create_map(*[F.lit(v) for i, c in enumerate(order) for v in (c, i)])
    return model.transform(x).withColumn(name, number[F.col("_c")]).drop("_v", "_c")
