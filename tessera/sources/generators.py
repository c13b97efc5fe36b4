"""Deterministic generators: diagonal clusters in two dimensions, and range workloads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import Box
from tessera.functions.schema import ROW_ID

# Fixed values: (clusters, points in each, spacing, step) of the two data sets.
SMALL, LARGE = (3, 20, 50.0, 1.0), (10, 1000, 1000.0, 0.5)


def clusters(spark: SparkSession, count: int, size: int, spacing: float, step: float) -> DataFrame:
    """(row_id, cluster, x, y): cluster c starts at (c * spacing, c * spacing), its points lie `step` apart."""
    if count < 1 or size < 1:
        raise ValueError("a cluster and a point at least")
    at = (F.floor(F.col("id") / size) * spacing + (F.col("id") % size) * step).cast("float")
    return spark.range(count * size).select(F.col("id").alias(ROW_ID), F.floor(F.col("id") / size).alias("cluster"), at.alias("x"), at.alias("y"))


def workloads(large: bool) -> list[tuple[str, Box]]:
    """Named range queries: one for each cluster, none, all, and one across clusters."""
    square = lambda a, b: Box((a, a), (b, b))
    if not large:
        own = [(f"cluster_range_{i:03d}", square(50 * i, 50 * i + 5)) for i in range(3)]
        return [*own, ("empty_far_range", square(200, 220)), ("full_dataset_range", square(-10, 130)), ("cluster_boundary_range", square(18, 52))]
    own = [(f"large_cluster_range_{i:03d}", square(1000 * i, 1000 * i + 25)) for i in range(10)]
    return [*own, ("large_empty_far_range", square(20000, 21000)), ("large_full_dataset_range", square(-100, 10000)), ("large_cross_cluster_boundary", square(490, 1025))]
