"""Rows delivered several times: the latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, *ties: Column) -> DataFrame:
    """One row per keys: the latest by ``at``, rows without a time last, ties by ``ties``. Null keys form a group."""
    order = W.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *ties)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def latest_fields(df: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """One row per keys with, of each field, its latest value that isn't null: layers over one another. Aggregated before
    the shuffle, so a hot key costs one row per task."""
    picked = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(F.col(at), F.col(f)))).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*picked)
