"""Boxes of a detector before they are read: which are dropped, which are read as blocks, how pages are scaled, what of the
neighbours a crop leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.operators.lines import PAGE, middle_of

#: Least width and height of a box; what makes a box a block; least height of a line to be read well.
LEAST_W, LEAST_H, BLOCK_TIMES, LINE_HEIGHT, SMALL_TEXT = 8, 6, 1.8, 48, 14
#: Widths between which a detector sees pages.
MIN_WIDTH, MAX_WIDTH = 1600, 2000
#: Margin of a crop in pixels, and as a share of the page's middle line height.
PAD, PAD_SHARE = 8, 0.35


def box_kinds(lines: DataFrame) -> DataFrame:
    """line_id, kind: dropped (too small), block (far higher than the page's middle line) or line."""
    at = lines.withColumn("mid", F.median("h").over(W.partitionBy(*PAGE)))
    small = (F.col("x1") - F.col("x0") < LEAST_W) | (F.col("h") < LEAST_H)
    return at.select("line_id", F.when(small, "dropped").when((F.col("h") > BLOCK_TIMES * F.col("mid")) & (F.col("h") > 2 * LINE_HEIGHT // 3), "block").otherwise("line").alias("kind"))


def small_text(lines: DataFrame) -> DataFrame:
    """book_id, page_no, height, small: the upper middle height of a page's lines, and whether it is too small to be read well."""
    return middle_of(lines, PAGE, "h", "height").withColumn("small", F.col("height") < SMALL_TEXT)


def scale(width: Column) -> Column:
    """Factor by which a page of this width is scaled before detection; 1 for empty pages."""
    return F.when((width > 0) & (width < MIN_WIDTH), MIN_WIDTH / width).when(width > MAX_WIDTH, MAX_WIDTH / width).otherwise(F.lit(1.0))


def crops(lines: DataFrame) -> DataFrame:
    """Placed lines with cx0, cy0, cx1, cy1: the box grown by the larger of PAD and a share of the page's middle line height, half
    of it (two at least) upwards and downwards, within the page."""
    mid = F.median("h").over(W.partitionBy(*PAGE))
    px = F.greatest(F.lit(PAD), F.bround(PAD_SHARE * mid)).cast("int")
    at = lines.withColumn("px", px).withColumn("py", F.greatest(F.lit(2), F.floor(F.col("px") / 2)).cast("int"))
    return at.withColumns({"cx0": F.greatest(F.lit(0), F.col("x0") - F.col("px")), "cy0": F.greatest(F.lit(0), F.col("y0") - F.col("py")), "cx1": F.least("page_w", F.col("x1") + F.col("px")), "cy1": F.least("page_h", F.col("y1") + F.col("py"))}).drop("px", "py")


def neighbours_in_crops(lines: DataFrame) -> DataFrame:
    """line_id, other, u0, v0, u1, v1: the parts of other lines' boxes within a line's crop, up to the line's own box: above or
    below it by the other's middle, else beside it. Lines of a page meet by strips of its height."""
    at = crops(lines)
    strip = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor(F.col(b) / 64)))
    own = at.select(*PAGE, "line_id", "x0", "y0", "x1", "y1", "cx0", "cy0", "cx1", "cy1", strip("cy0", "cy1").alias("s"))
    other = at.select(*PAGE, F.col("line_id").alias("other"), F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"), strip("y0", "y1").alias("s"))
    both = own.join(other, [*PAGE, "s"]).filter("line_id <> other").drop("s").distinct()
    u0, v0, u1, v1 = F.greatest("a0", "cx0"), F.greatest("b0", "cy0"), F.least("a1", "cx1"), F.least("b1", "cy1")
    both = both.withColumns({"u0": u0, "v0": v0, "u1": u1, "v1": v1}).filter("u1 > u0 AND v1 > v0")
    my, mx = (F.col("b0") + F.col("b1")) / 2, (F.col("a0") + F.col("a1")) / 2
    side = F.when(my < F.col("y0"), "above").when(my > F.col("y1"), "below").when(mx < F.col("x0"), "left").otherwise("right")
    both = both.withColumn("side", side)
    cut = lambda c, where, of, by: F.when(F.col("side") == where, of(F.col(c), F.col(by))).otherwise(F.col(c)).alias(c)
    got = both.select("line_id", "other", cut("u0", "right", F.greatest, "x1"), cut("v0", "below", F.greatest, "y1"), cut("u1", "left", F.least, "x0"), cut("v1", "above", F.least, "y0"))
    return got.filter("u1 > u0 AND v1 > v0")


def note_number_crops(lines: DataFrame) -> DataFrame:
    """line_id, u0, v0, u1, v1: where a note's lost number may stand: at the start of a line of small type in the lower part of
    the page that begins with no number, or with one of one or two digits (then around that word). Lines are placed."""
    long = lines.filter("length(text) >= 6")
    at = long.join(middle_of(long, PAGE, "h", "mid"), PAGE).filter((F.col("h") <= 0.95 * F.col("mid")) & (F.col("y0") >= 0.4 * F.col("page_h")))
    # Fixed value: what a line's leading number looks like.
    lead = F.regexp_extract(F.trim("text"), r"^[(\[«]?([0-9۰-۹]{1,4}|\*{1,3})", 1)
    at = at.withColumn("lead", lead).filter(~F.startswith("lead", F.lit("*")) & (F.length("lead") < 3))
    word = F.when((F.col("lead") != "") & (F.size("words") > 0), F.col("words")[0]["bbox"])
    latin = (F.regexp_count("text", F.lit("[A-Za-z]")) >= 3) & (F.regexp_count("text", F.lit("[A-Za-z]")) >= F.regexp_count("text", F.lit("[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]")))
    h = F.col("h")
    inner = F.when(latin, F.coalesce(word[2] + 0.2 * h, F.col("x0") + 0.8 * h)).otherwise(F.coalesce(word[0] - 0.2 * h, F.col("x1") - 0.8 * h))
    left, right = F.when(latin, F.col("x0") - 1.2 * h).otherwise(inner), F.when(latin, inner).otherwise(F.col("x1") + 1.2 * h)
    whole = lambda c: c.cast("int")  # noqa: E731  towards zero
    got = at.select("line_id", F.greatest(F.lit(0), whole(left)).alias("u0"), F.greatest(F.lit(0), whole(F.col("y0") - 0.35 * h)).alias("v0"), F.least("page_w", whole(right)).alias("u1"), F.least("page_h", whole(F.col("y1") + 0.2 * h)).alias("v1"))
    return got.filter("u1 - u0 > 4 AND v1 - v0 > 4")
