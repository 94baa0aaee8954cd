"""Queries of the training-text problems over the tables of a data folder, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.llm.lookpairs import group_members, look_alike_groups, look_alike_pairs
from leafwork.llm.looks import one_form, one_form_shared
from leafwork.llm.packing import pack_documents, room_left
from leafwork.llm.repeats import repeated_in_books, repeated_in_documents, rows_without_repeats, without_repeats
from leafwork.llm.scans import book_paragraphs, scan_defects
from leafwork.llm.sentences import sentence_units
from leafwork.llm.tokens import encode_documents
from leafwork.llm.truncation import truncated, truncation_by_source
from leafwork.session import table


def p1_found(spark, folder):
    return scan_defects(*(table(spark, folder, t) for t in ("ocr_rows", "books", "page_layouts")))


def p1_text(spark, folder):
    return book_paragraphs(*(table(spark, folder, t) for t in ("ocr_rows", "books", "page_layouts")))


def p2_found(spark, folder):
    documents, rows, books = (table(spark, folder, t) for t in ("documents", "ocr_rows", "books"))
    a = repeated_in_documents(documents).select(F.lit("documents").alias("tbl"), "item_id", "line_no")
    b = repeated_in_books(rows, books).select(F.lit("ocr_rows").alias("tbl"), "item_id", "line_no")
    return a.unionByName(b)


def p2_clean(spark, folder):
    return without_repeats(table(spark, folder, "documents"))


def p2_clean_rows(spark, folder):
    """The rows of the books without their source's repeated lines."""
    return rows_without_repeats(table(spark, folder, "ocr_rows"), table(spark, folder, "books"))


def p3_found(spark, folder):
    return look_alike_pairs(table(spark, folder, "ocr_rows"))


def p3_groups(spark, folder):
    return group_members(look_alike_groups(table(spark, folder, "ocr_rows")))


def p6_ids(spark, folder):
    return encode_documents(table(spark, folder, "documents"))


def p3_rows(spark, folder):
    """Every delivered text of every row in one form."""
    rows = table(spark, folder, "ocr_rows").filter("text IS NOT NULL").withColumn("raw", F.xxhash64("text"))
    return one_form(rows, ["line_id", "raw"], "text").select("line_id", "one_form").distinct()


def p3_words(spark, folder):
    """The words of every row in one form, by their numbers in the row."""
    rows = table(spark, folder, "ocr_rows").select("line_id", F.posexplode("words").alias("word_no", "w"))
    rows = rows.select("line_id", "word_no", F.col("w.text").alias("text")).filter("text IS NOT NULL")
    return one_form_shared(rows, ["line_id", "word_no"], "text").distinct()


def p3_titles(spark, folder):
    books = table(spark, folder, "books").filter("title IS NOT NULL")
    return one_form(books, ["book_id"], "title")


def p4_found(spark, folder):
    return sentence_units(table(spark, folder, "documents"))


def p7_packed(spark, folder):
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"))


def p7_room(spark, folder):
    return room_left(p7_packed(spark, folder), table(spark, folder, "pack_sizes"))


def p8_found(spark, folder):
    return truncated(table(spark, folder, "documents"))


def p8_sources(spark, folder):
    return truncation_by_source(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_text": p1_text,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p2_clean_rows": p2_clean_rows,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_rows": p3_rows,
    "p3_words": p3_words,
    "p3_titles": p3_titles,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_room": p7_room,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}

SQL: dict[str, str] = {}
