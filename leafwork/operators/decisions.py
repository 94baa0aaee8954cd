"""What was decided about each row of a page, collected from layers of which the first that speaks wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the layers.
LAYERS = ("structure", "header", "pagenum", "contents", "other", "noise")


def collected(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """book_id, page_no, row_no, layer, role of every row: of what ``decided`` (book_id, page_no, row_no, layer, role) says about it,
    the first layer's; what nothing took is noise. Within a layer the least role wins."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    best = decided.filter(F.col("layer").isin(*LAYERS)).groupBy("book_id", "page_no", "row_no").agg(F.min(F.struct(rank.alias("rank"), "layer", "role")).alias("x"))
    at = rows.select("book_id", "page_no", "row_no").distinct().join(best, ["book_id", "page_no", "row_no"], "left")
    return at.select("book_id", "page_no", "row_no", F.coalesce("x.layer", F.lit("noise")).alias("layer"), F.coalesce("x.role", F.lit("noise")).alias("role"))


def of_layouts(layouts: DataFrame) -> DataFrame:
    """The header's and the footer's row of each page as decisions."""
    side = lambda c, layer, role: F.struct(F.col(f"{c}.row_no").alias("row_no"), F.lit(layer).alias("layer"), F.lit(role).alias("role"))
    return layouts.select("book_id", "page_no", F.inline(F.array(side("header", "header", "header"), side("footer", "pagenum", "pagenum")))).filter("row_no IS NOT NULL")


def page_kinds(layouts: DataFrame, labels: DataFrame, contents: DataFrame, openings: DataFrame) -> DataFrame:
    """book_id, page_no, type: a page's kind: a label's, else contents, else figure or blank, else by what opens on it, else text.
    ``labels``: book_id, page_no, label; ``contents``: book_id, page_no; ``openings``: book_id, page_no, opens."""
    at = layouts.select("book_id", "page_no", "kind").join(labels, ["book_id", "page_no"], "left").join(contents.select("book_id", "page_no", F.lit(True).alias("listed")), ["book_id", "page_no"], "left").join(openings, ["book_id", "page_no"], "left")
    opened = F.when(F.col("opens") == "part", "part").when(F.col("opens") == "front", "other").when(F.col("opens").isNotNull(), "opening")
    return at.select("book_id", "page_no", F.coalesce(F.nullif("label", F.lit("")), F.when(F.col("listed"), F.lit("contents")), F.when(F.col("kind").isin("figure", "blank"), F.col("kind")), opened, F.lit("text")).alias("type"))
