"""Rows of one book whose texts look the same in print but differ in their characters (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.looks import one_form
from leafwork.session import cut

#: Lines of a group that one salt of the pair join holds.
PER_SALT = 1_000


def letters(col: str):
    """Number of characters of Unicode category L."""
    return F.length(F.regexp_replace(col, r"\P{L}+", ""))


def look_alike_groups(rows: DataFrame, min_letters: int = 30) -> DataFrame:
    """group_id (two hashes of the book and the look), n (lines of the group), line_id and raw (hash of the text): the lines of
    one book with equal one_form, of ``min_letters`` letters each, of the groups that hold different texts. Null book, null
    text and null line_id are in no group; a line delivered twice is in it once per text. Texts don't travel."""
    src = rows.select(F.col("line_id").cast("bigint").alias("line_id"), F.col("book_id").cast("string").alias("book_id"), F.col("text").cast("string").alias("text"))
    src = src.filter("line_id IS NOT NULL AND book_id IS NOT NULL AND length(text) >= %d" % min_letters)
    src = src.withColumn("raw", F.xxhash64("text"))
    one = one_form(src, ["line_id", "book_id", "raw"], "text", where=letters("text") >= min_letters)
    keyed = one.select(F.struct(F.xxhash64("book_id", "one_form").alias("a"), F.xxhash64("one_form", F.lit(7), "book_id").alias("b")).alias("group_id"), "raw", "line_id")
    keyed = cut(keyed)  # read twice below
    mixed = keyed.groupBy("group_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("group_id", "n")
    return keyed.join(mixed, "group_id").select("group_id", "n", "line_id", "raw").distinct()


def group_members(groups: DataFrame) -> DataFrame:
    """line_id, first_line (the group's least line_id, its representative) and same_text (whether it has the representative's
    text): the links of all lines of a group without all their pairs. A line delivered with several texts has a row each."""
    first = groups.groupBy("group_id").agg(F.min(F.struct("line_id", "raw")).alias("first"))
    return groups.join(first, "group_id").select("line_id", F.col("first.line_id").alias("first_line"), (F.col("raw") == F.col("first.raw")).alias("same_text")).distinct()


def look_alike_pairs(rows: DataFrame, min_letters: int = 30) -> DataFrame:
    """line_a < line_b of all pairs of lines of a group with different texts (as the query asks for pairs). A group is spread
    over as many salts as its lines need."""
    held = look_alike_groups(rows, min_letters).withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int"))
    a = held.withColumn("salt", F.pmod(F.xxhash64("line_id"), F.col("salts")).cast("int"))
    b = held.select("group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("raw").alias("raw_b"), F.col("line_id").alias("line_b"))
    return a.join(b, ["group_id", "salt"]).filter("raw <> raw_b AND line_id < line_b").select(F.col("line_id").alias("line_a"), "line_b").distinct()
