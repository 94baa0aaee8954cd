"""Jobs and their files: names that are safe, lists, the queue, which pages a book's data is asked from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds of pages that hold a book's bibliographic data; blanks other than the plain one, and controls.
META_KINDS = ("cover", "title", "imprint")
UNPRINTED = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
NAME_LENGTH = 150


def safe_name(name: Column) -> Column:
    """A file name: the last part of a path without what isn't printed, blanks around and leading dots; "file" for an empty one."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^\\/]*)$", 1)
    bare = F.regexp_replace(F.trim(F.regexp_replace(last, UNPRINTED, "")), r"^\.+", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(NAME_LENGTH)), F.lit("")), F.lit("file"))


def labels_folder(model: Column) -> Column:
    """The folder of a labeller's answers, named by its model with characters a path can't hold replaced."""
    return F.concat(F.lit("labels-"), F.regexp_replace(model, r"[^\p{L}\p{N}_.\-]+", "-"))


def job_list(events: DataFrame) -> DataFrame:
    """job_id, book_id, first_at, last_at, turn (in the queue, first sent first run) and place (in the list, newest first). One
    row per job is ranked, whatever the number of its events; ties by job_id."""
    jobs = events.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.max("book_id").alias("book_id"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    turn = F.row_number().over(W.partitionBy("day").orderBy("first_at", "job_id"))
    place = F.row_number().over(W.partitionBy("day").orderBy(F.col("first_at").desc(), "job_id"))
    # ranked within a day, so that no task holds all jobs; the days' counts are added
    at = jobs.withColumn("day", F.to_date("first_at")).withColumn("turn", turn).withColumn("place", place)
    days = at.groupBy("day").agg(F.count("*").alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("after", F.coalesce(F.sum("n").over(W.orderBy(F.col("day").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = at.join(days.drop("n"), at["day"].eqNullSafe(days["day"])).drop(days["day"])
    return at.select("job_id", "book_id", "first_at", "last_at", (F.col("turn") + F.col("before")).alias("turn"), (F.col("place") + F.col("after")).alias("place"))


def meta_pages(pages: DataFrame, kinds: tuple[str, ...] = META_KINDS, first: int = 12, last: int = 4, most: int = 4, else_first: int = 3) -> DataFrame:
    """book_id, page_no: the pages a book's data is asked from: those of the given kinds among the first and last pages, at most
    ``most``, else the first ones."""
    w = W.partitionBy("book_id")
    at = pages.withColumn("k", F.row_number().over(w.orderBy("page_no"))).withColumn("n", F.count("*").over(w))
    at = at.withColumn("typed", F.coalesce(F.col("kind").isin(*kinds), F.lit(False)) & ((F.col("k") <= first) | (F.col("k") > F.col("n") - last)))
    at = at.withColumn("t", F.sum(F.col("typed").cast("int")).over(w.orderBy("page_no"))).withColumn("any", F.max("typed").over(w))
    return at.filter(F.when(F.col("any"), F.col("typed") & (F.col("t") <= most)).otherwise(F.col("k") <= else_first)).select("book_id", "page_no")


def job_id(at: Column, key: Column) -> Column:
    """A job's id: when it was made, to the second, and four letters of a hash."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.left(F.md5(key), F.lit(4)))
