"""Corrections that people make: layers over the decided lines, a log with undo, edits of all lines of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.functions import text as X

FIELDS = ["r", "l", "n", "p", "m", "a", "t", "x"]


def current_edits(log: DataFrame) -> DataFrame:
    """page, row, field, value: the last value set of each field of each line, by ``seq``; a null value takes the edit
    back. Edits of other fields than a line's are left out."""
    known = log.filter(F.col("field").isin(FIELDS))
    last = known.groupBy("page", "row", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return last.select("page", "row", "field", F.col("v.value").alias("value")).filter("value IS NOT NULL")


def overlaid(decided: DataFrame, log: DataFrame) -> DataFrame:
    """page, row, fields (map) and h (names set by hand, sorted): decided fields with the edits on top. Edits of lines that
    aren't there any more are left out."""
    edits = current_edits(log).groupBy("page", "row").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("mine"))
    none = F.create_map().cast("map<string,string>")
    at = decided.join(edits, ["page", "row"], "left").withColumn("mine", F.coalesce("mine", none)).withColumn("fields", F.coalesce("fields", none))
    kept = F.map_filter("fields", lambda k, _: ~F.map_contains_key("mine", k))
    return at.select("page", "row", F.map_concat(kept, "mine").alias("fields"), F.array_sort(F.map_keys("mine")).alias("h"))


def undone(log: DataFrame, steps: int) -> DataFrame:
    """The log without its last ``steps`` changes; edits of one change share their seq. Only distinct seqs are ranked."""
    last = log.select("seq").distinct().orderBy(F.col("seq").desc()).limit(steps)
    return log.join(last, "seq", "left_anti")


def kept_history(log: DataFrame, most: int = 300) -> DataFrame:
    """The last ``most`` changes of each book's log."""
    place = F.dense_rank().over(W.partitionBy("book_id").orderBy(F.col("seq").desc()))
    return log.withColumn("__k", place).filter(F.col("__k") <= most).drop("__k")


def bulk_groups(lines: DataFrame, least: int = 2) -> DataFrame:
    """book_id, key, n_lines, n_pages: texts, digits and blanks aside, of at least ``least`` lines of a book: what an edit of
    one may be made to all."""
    at = lines.select("book_id", "page_no", X.edit_key(F.col("text")).alias("key")).filter("key <> ''")
    return at.groupBy("book_id", "key").agg(F.count("*").alias("n_lines"), F.count_distinct("page_no").alias("n_pages")).filter(F.col("n_lines") >= least)


