"""Interval, nearest, as-of and best-match joins. Spark has no native ones: both sides meet by blocks of the ordered value,
so every join is an equi-join with a filter, and no side is paired whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import geometry as G


def band(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, within: int) -> DataFrame:
    """Pairs of equal keys whose whole numbers ``a`` (left) and ``b`` (right) differ by at most ``within``. Columns other
    than the keys must have different names; null keys and numbers join nothing."""
    size = max(1, within)
    x = left.withColumn("__b", F.floor(F.col(a) / size))
    y = right.withColumn("__b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col(b) / size) + d)))
    return x.join(y, [*keys, "__b"]).filter(F.abs(F.col(a) - F.col(b)) <= within).drop("__b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], row: str, a: str, b: str, within: int, take: str) -> DataFrame:
    """left with ``take`` of the right row nearest by number within the band; ties go to the smaller number, then the
    smaller value. ``row`` identifies a left row."""
    pairs = band(left.select(*keys, row, a), right.select(*keys, b, take), keys, a, b, within)
    best = pairs.groupBy(row).agg(F.min_by(take, F.struct(F.abs(F.col(a) - F.col(b)).alias("d"), F.col(b), F.col(take))).alias(take))
    return left.join(best, row, "left")


def between(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str, high: str, block: int) -> DataFrame:
    """Pairs of equal keys whose whole number ``value`` lies in [low, high]. A range is met in each block that it covers."""
    x = points.withColumn("__b", F.floor(F.col(value) / block))
    y = ranges.filter(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / block), F.floor(F.col(high) / block))))
    return x.join(y, [*keys, "__b"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("__b")


def rows_of(lines: DataFrame, page: list[str], line: str, box: str, share: float = 0.5) -> DataFrame:
    """Pairs (line_a < line_b) of one page whose boxes overlap vertically by more than ``share`` of the lower one: pieces of
    one printed row. Pairs of a page only, which is bounded."""
    a = lines.select(*page, F.col(line).alias("line_a"), F.col(box).alias("box_a"))
    b = lines.select(*page, F.col(line).alias("line_b"), F.col(box).alias("box_b"))
    # lines of a page meet by strips as high as a line
    strip = lambda c: F.explode(F.sequence(F.floor(G.corner(F.col(c), 1) / 64), F.floor(G.corner(F.col(c), 3) / 64)))
    pairs = a.filter(F.size("box_a") >= 4).withColumn("s", strip("box_a")).join(b.filter(F.size("box_b") >= 4).withColumn("s", strip("box_b")), [*page, "s"])
    return pairs.filter((F.col("line_a") < F.col("line_b")) & G.same_row(F.col("box_a"), F.col("box_b"), share)).select(*page, "line_a", "line_b").distinct()


def lines_in_regions(lines: DataFrame, regions: DataFrame, page: list[str], line: str, box: str, region: str, region_box: str, margin: int = 5) -> DataFrame:
    """page, line, region: the lines whose centre lies in a region's box, widened by ``margin``."""
    x = (G.corner(F.col(box), 0) + G.corner(F.col(box), 2)) / 2
    y = (G.corner(F.col(box), 1) + G.corner(F.col(box), 3)) / 2
    return lines.select(*page, line, x.alias("__x"), y.alias("__y")).join(regions.select(*page, region, region_box), page).filter(G.inside(F.col("__x"), F.col("__y"), F.col(region_box), margin)).select(*page, line, region)


def matched_boxes(stored: DataFrame, now: DataFrame, page: list[str], same: float = 0.6, moved: float = 0.5) -> DataFrame:
    """page, i, row_no, how: stored lines (i, old_box) found among today's (row_no, box): at the same row where the boxes
    agree by ``same``, else, in the order of i, at the best row that agrees by ``moved`` and isn't taken (ties: the upper), else
    lost (null row). Only the candidates of a page meet in one group."""
    both = stored.join(now, page)
    agree = G.iou(F.col("old_box"), F.col("box"))
    at_home = both.filter(F.col("i") == F.col("row_no")).filter(agree >= same).select(*page, "i", "row_no")
    left = stored.join(at_home.select(*page, "i"), [*page, "i"], "left_anti")
    free = now.join(at_home.select(*page, "row_no"), [*page, "row_no"], "left_anti")
    cands = left.join(free, page).withColumn("agree", agree).filter(F.col("agree") >= moved).select(*page, "i", "row_no", "agree")

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for i, ways in pdf.sort_values(["i", "agree", "row_no"], ascending=[True, False, True]).groupby("i", sort=True):
            row = next((r for r in ways.row_no if r not in taken), None)
            if row is not None:
                taken.add(row)
                out.append(ways[ways.row_no == row].iloc[:1])
        return pd.concat(out)[[*page, "i", "row_no"]]

    types = dict(cands.dtypes)
    given = cands.groupBy(*page).applyInPandas(give, ", ".join(f"{c} {types[c]}" for c in (*page, "i", "row_no")))
    found = at_home.withColumn("how", F.lit("same")).unionByName(given.withColumn("how", F.lit("moved")))
    return stored.select(*page, "i").join(found, [*page, "i"], "left").withColumn("how", F.coalesce("how", F.lit("lost")))


def set_similarity(left: DataFrame, right: DataFrame, keys: list[str], a: str, a_set: str, b: str, b_set: str) -> DataFrame:
    """keys, a, best: for each left set the greatest Jaccard similarity to a right set that shares an element, 0 without
    one. Sets meet by their elements, through an inverted index of the right ones."""
    x = left.select(*keys, a, F.size(a_set).alias("__n"), F.explode(a_set).alias("__e"))
    y = right.select(*keys, b, F.size(b_set).alias("__m"), F.explode(b_set).alias("__e"))
    common = x.join(y, [*keys, "__e"]).groupBy(*keys, a, b, "__n", "__m").agg(F.count("*").alias("__k"))
    best = common.groupBy(*keys, a).agg(F.max(F.col("__k") / (F.col("__n") + F.col("__m") - F.col("__k"))).alias("best"))
    return left.select(*keys, a).join(best, [*keys, a], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def layered(*layers: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and fields, each field from the first layer in which it isn't null: a person over a labeller over the rules."""
    every = None
    for rank, layer in enumerate(layers):
        one = layer.select(*keys, *fields).withColumn("__rank", F.lit(rank))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__rank"))).alias(f) for f in fields])


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def multiset_recall(expected: DataFrame, got: DataFrame, keys: list[str], word: str) -> DataFrame:
    """keys, n, found, recall: words of ``expected`` found again in ``got``, each as often as it stands there."""
    a = expected.groupBy(*keys, word).agg(F.count("*").alias("n"))
    b = got.groupBy(*keys, word).agg(F.count("*").alias("m"))
    each = a.join(b, [*keys, word], "left").withColumn("k", F.least("n", F.coalesce("m", F.lit(0))))
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("found")).withColumn("recall", F.col("found") / F.col("n"))


