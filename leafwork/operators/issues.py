"""What a person should look at first: how sure a line is, and a book's open issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSURE, CHECK = 0.5, 0.2


def edge(p: Column) -> Column:
    """How far a probability is from deciding: 0 at 0 and 1, 1 at one half."""
    return 1 - F.abs(2 * p - 1)


def level(doubt: Column) -> Column:
    return F.when(doubt >= UNSURE, "unsure").when(doubt >= CHECK, "check").when(doubt.isNotNull(), "sure")


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def text_doubt(weakest: Column) -> Column:
    """Doubt of a line's text by the confidence of its weakest word (0 to 100)."""
    return F.round(clip01((97 - weakest) / 25), 3)


def role_doubt(p_note: Column, p_heading: Column, p_role: Column, differs: Column) -> Column:
    """Doubt of a line's role by the models' probabilities; null where there is none. ``differs``: the models read the line
    otherwise than it was decided."""
    parts = [edge(p_note), edge(p_heading), 0.6 * clip01((0.99 - p_role) / 0.49), F.when(differs, 0.5)]
    # greatest() leaves nulls out
    return F.round(F.greatest(*parts), 3)


def line_doubts(lines: DataFrame) -> DataFrame:
    """line_id, book_id, page_no, weakest, doubt, level of each line by its words, else its own confidence; null where
    neither is known."""
    confs = F.filter(F.transform("words", lambda w: w["conf"]), lambda c: c.isNotNull())
    weak = F.coalesce(F.array_min(confs), F.col("conf"))
    return lines.select("line_id", "book_id", "page_no", weak.alias("weakest")).withColumn("doubt", text_doubt(F.col("weakest"))).withColumn("level", level(F.col("doubt")))


def weak_pages(lines: DataFrame, least: int = 5, share: float = 0.3, weak: float = 0.3) -> DataFrame:
    """book_id, page_no, n, n_weak, doubt: pages of at least ``least`` lines of which ``share`` are in doubt."""
    d = line_doubts(lines)
    at = d.groupBy("book_id", "page_no").agg(F.count("*").alias("n"), F.count_if(F.col("doubt") >= weak).alias("n_weak"))
    return at.filter((F.col("n") >= least) & (F.col("n_weak") >= share * F.col("n"))).withColumn("doubt", F.round(F.least(F.lit(0.95), 0.4 + F.col("n_weak") / F.col("n") / 2), 3))


def issues(lines: DataFrame, gaps: DataFrame, scans: DataFrame) -> DataFrame:
    """id, kind, book_id, page_no, row, doubt of all issues: lines in doubt, weak pages, gaps in a book's page numbers
    (``gaps``: book_id, first, last) and pages left out as second scans (``scans``: book_id, page_no)."""
    t = line_doubts(lines).filter("doubt >= 0.3")
    parts = [
        t.select(F.concat_ws(":", F.lit("text"), "line_id").alias("id"), F.lit("text").alias("kind"), "book_id", "page_no", F.col("line_id").alias("row"), "doubt"),
        weak_pages(lines).select(F.concat_ws(":", F.lit("page"), "book_id", "page_no").alias("id"), F.lit("page").alias("kind"), "book_id", "page_no", F.lit(None).cast("bigint").alias("row"), "doubt"),
        gaps.select(F.concat_ws(":", F.lit("gap"), "book_id", "first").alias("id"), F.lit("gap").alias("kind"), "book_id", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("bigint").alias("row"), F.lit(0.7).alias("doubt")),
        scans.select(F.concat_ws(":", F.lit("left"), "book_id", "page_no").alias("id"), F.lit("left").alias("kind"), "book_id", "page_no", F.lit(None).cast("bigint").alias("row"), F.lit(0.85).alias("doubt")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_issues(found: DataFrame) -> DataFrame:
    """Issues in the order of work: least sure first, then by page and row, those without a place first."""
    return found.orderBy(F.col("doubt").desc(), F.coalesce("page_no", F.lit(0)), F.coalesce("row", F.lit(-1)), "id")


def book_summary(lines: DataFrame) -> DataFrame:
    """book_id, n_pages, n_lines, unsure, check, worst: lines by level of doubt and the greatest doubt."""
    d = line_doubts(lines)
    return d.groupBy("book_id").agg(F.count_distinct("page_no").alias("n_pages"), F.count("*").alias("n_lines"), F.count_if(F.col("level") == "unsure").alias("unsure"), F.count_if(F.col("level") == "check").alias("check"), F.max("doubt").alias("worst"))
