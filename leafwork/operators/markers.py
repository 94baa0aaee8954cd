"""Note markers in the text and the notes they belong to.

A marker is a number of one to three digits, or up to three stars, right after a word and before a blank, a stop or the
end; a number set apart from its word before a stop counts as a weak one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.functions.text import to_int

# What a marker looks like: a number or stars at a word, or a number set apart from its word.
_D = "0-9۰-۹٠-٩"
_AFTER = r"(?=[\s.،؛:!?؟»«)\]‌]|$)"
STRONG = rf"(?<=[^\s{_D}/\-(.])([{_D}]{{1,3}}){_AFTER}"
STARS = r"(?<=[^\s*])(\*{1,3})(?=[\s.،؛:!?؟»«)\]]|$)"
WEAK = rf"(?<=[^\s{_D}])\s([{_D}]{{1,3}})(?=[.،؛:!?؟»)\]]|\s*$)"


def markers(lines: DataFrame) -> DataFrame:
    """book_id, page_no, row_no, y0, k, number, weak: the markers of each line, strong ones first, in order; stars number
    by how many they are."""
    found = []
    for pattern, weak in ((STRONG, False), (STARS, False), (WEAK, True)):
        at = lines.select("book_id", "page_no", "row_no", "y0", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("k", "mark"))
        found.append(at.withColumn("weak", F.lit(weak)).withColumn("number", F.when(F.col("mark").startswith("*"), F.length("mark").cast("bigint")).otherwise(to_int(F.col("mark")))))
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.filter("number > 0").select("book_id", "page_no", "row_no", "y0", "k", F.col("number").cast("int").alias("number"), "weak")


def linked(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """book_id, page_no, pos, number, row_no, k: each numbered note (pos) with its marker, by number on its page: the first
    note of a number takes the first strong marker of it (a weak one only without a strong), the second the second, each
    marker once; null row and k where there is none."""
    key = ["book_id", "page_no", "number"]
    m = marks.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("weak", "y0", "row_no", "k"))).select(*key, "r", "row_no", "k")
    n = notes.filter("number IS NOT NULL").withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("pos"))).select(*key, "r", "pos")
    return n.join(m, [*key, "r"], "left").select("book_id", "page_no", "pos", "number", "row_no", "k")


def unlinked(links: DataFrame) -> DataFrame:
    """Notes without a marker: their text goes to the end of the page's text."""
    return links.filter("row_no IS NULL").select("book_id", "page_no", "pos", "number")


def stray(marks: DataFrame, links: DataFrame) -> DataFrame:
    """Strong markers without a note."""
    used = links.filter("row_no IS NOT NULL").select("book_id", "page_no", "number", "row_no", "k")
    return marks.filter("NOT weak").join(used, ["book_id", "page_no", "number", "row_no", "k"], "left_anti")


def owners(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """book_id, page_no, row_no, head: the last head at or above each line of its page; null above the first. ``heads``:
    book_id, page_no, y0, head. Lines and heads are one sequence down the page, in which the last head is looked up."""
    marked = heads.filter("y0 IS NOT NULL").select("book_id", "page_no", F.lit(None).cast("int").alias("row_no"), "y0", "head", F.lit(0).alias("is_line"))
    own = lines.select("book_id", "page_no", "row_no", "y0", F.lit(None).cast(dict(heads.dtypes)["head"]).alias("head"), F.lit(1).alias("is_line"))
    w = W.partitionBy("book_id", "page_no").orderBy(F.col("y0").asc_nulls_first(), "is_line", "head").rowsBetween(W.unboundedPreceding, 0)
    return marked.unionByName(own).withColumn("head", F.last("head", ignorenulls=True).over(w)).filter("is_line = 1").select("book_id", "page_no", "row_no", "head")
