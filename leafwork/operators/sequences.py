"""Running values over long sequences, runs and gaps.

A group may hold a third of all rows, so running values are taken in blocks of the order column: within a block by a
window, between blocks by a window over one row per block. The order column is a whole number, unique within the group;
null keys form a group, rows with a null order are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.session import cut

BLOCK = 4096


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return df.filter(F.col(order).isNotNull()).withColumn("__b", F.floor(F.col(order) / BLOCK))


def _join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys and block, null keys equal."""
    renamed = other.withColumnsRenamed({k: f"__o_{k}" for k in [*keys, "__b"]})
    on = None
    for k in [*keys, "__b"]:
        c = F.col(k).eqNullSafe(F.col(f"__o_{k}"))
        on = c if on is None else on & c
    return df.join(renamed, on, "left").drop(*[f"__o_{k}" for k in [*keys, "__b"]])


def last_known(df: DataFrame, keys: list[str], order: str, value: str, to: str, back: bool = False, strictly: bool = False) -> DataFrame:
    """df with ``to``, the nearest value that isn't null at or before the row (``back``: at or after it; ``strictly``: not
    its own): an as-of value."""
    df = _blocked(df, order)
    by = F.col(order).desc() if back else F.col(order)
    inner = W.partitionBy(*keys, "__b").orderBy(by).rowsBetween(W.unboundedPreceding, -1 if strictly else 0)
    pick = F.min_by if back else F.max_by
    blocks = df.groupBy(*keys, "__b").agg(pick(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("__v"))
    outer = W.partitionBy(*keys).orderBy(F.col("__b").desc() if back else F.col("__b")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__v", F.last("__v", ignorenulls=True).over(outer))
    return _join(df, blocks, keys).withColumn(to, F.coalesce(F.last(value, ignorenulls=True).over(inner), "__v")).drop("__b", "__v")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, to: str) -> DataFrame:
    """df with ``to``, the sum of the values up to the row, nulls as 0."""
    df = _blocked(df, order)
    inner = W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    blocks = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    outer = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__s", F.sum("__s").over(outer))
    return _join(df, blocks, keys).withColumn(to, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.coalesce("__s", F.lit(0))).drop("__b", "__s")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, to: str) -> DataFrame:
    """df with ``to``, the greatest value before the row; null at the start."""
    df = _blocked(df, order)
    inner = W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "__b").agg(F.max(value).alias("__m"))
    outer = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__m", F.max("__m").over(outer))
    return _join(df, blocks, keys).withColumn(to, F.greatest(F.max(value).over(inner), "__m")).drop("__b", "__m")


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, first, last: maximal runs of consecutive whole numbers; repeats count once. A run's ends are the numbers whose
    neighbour is missing, so no group is sorted as a whole."""
    at = cut(df.select(*keys, F.col(number).cast("bigint").alias("n")).filter("n IS NOT NULL").distinct())
    shifted = lambda d: at.select(*keys, (F.col("n") + d).alias("n"))
    starts = at.join(shifted(1), [*keys, "n"], "left_anti").withColumn("s", F.lit(1))
    marked = at.join(starts, [*keys, "n"], "left").withColumn("s", F.when(F.col("s") == 1, F.col("n")))
    return last_known(marked, keys, "n", "s", "first").groupBy(*keys, "first").agg(F.max("n").alias("last"))


def missing(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, first, last: maximal gaps between the consecutive numbers of a group."""
    r = runs(df, keys, number)
    # one row per run: a group of many gaps is sorted by runs only
    after = F.lead("first").over(W.partitionBy(*keys).orderBy("first"))
    return r.withColumn("after", after).filter("after IS NOT NULL").select(*keys, (F.col("last") + 1).alias("first"), (F.col("after") - 1).alias("last"))


def parse_ranges(df: DataFrame, column: str) -> DataFrame:
    """df with one row per number of a text like "1-11,93-97"; malformed parts and ranges that run backwards give none."""
    part = F.explode(F.split(F.regexp_replace(column, r"\s", ""), ","))
    df = df.select("*", part.alias("__p")).filter(F.col("__p").rlike(r"^[0-9]{1,9}(-[0-9]{1,9})?$"))
    a = F.split("__p", "-")[0].cast("int")
    b = F.coalesce(F.get(F.split("__p", "-"), F.lit(1)).cast("int"), a)
    return df.filter(a <= b).select("*", F.explode(F.sequence(a, b)).alias("number")).drop("__p")
