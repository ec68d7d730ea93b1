"""Choosing among runs and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_run(scores: DataFrame, *by: str) -> DataFrame:
    """The run of highest score, the first of ties."""
    best = F.max(F.struct("score", (-F.col("run")).alias("r"))).alias("b")
    return scores.groupBy(*by).agg(best).select(*by, (-F.col("b.r")).alias("run"), F.col("b.score").alias("score"))


def upper_median(scores: DataFrame, *by: str) -> DataFrame:
    """The element at n / 2 of the sorted scores; a group is a run's folds."""
    rows = scores.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("score")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return rows.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*by, "score")
