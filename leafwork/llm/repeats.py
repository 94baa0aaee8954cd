"""Lines repeated across the texts of one source (problem 2).

A line's key is the 64-bit hash of its letters in the one form of problem 3, lower case. Each partition keeps a
heavy-hitter summary per source (counters, less the first counter dropped, as Misra and Gries); summaries merge by adding
their counters and errors. A line that stands in the wanted share of a source's texts is never lost: the capacity follows
from the source's own numbers of lines and texts, and a candidate is whatever could reach the threshold by counter plus
error. Candidates are then counted exactly, by distinct texts, in a second pass; confirmed lines are joined back.

Defined cases: a null source has no texts and no lines; null and empty texts count as texts of their source and hold no
lines; a line repeated within one text counts once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.lookpairs import letters
from leafwork.llm.looks import joined_letters, needs_explosion, one_form
from leafwork.session import cut, small_enough

#: Sets of keys are broadcast up to this many rows (16 bytes each), joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
SALTS = 32


def join_keys(lines: DataFrame, keys: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """lines joined with ``keys``, unique in ``on``: by broadcast up to ``rows`` rows, beyond it by a shuffle over SALTS salts,
    so that a line which stands in all texts of the largest source is no task of its own."""
    if small_enough(keys, rows):
        return lines.join(F.broadcast(keys), on)
    salted = lines.withColumn("__salt", F.pmod(F.xxhash64("item_id", "line_no"), F.lit(SALTS)).cast("int"))
    return salted.join(keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "__salt"]).drop("__salt")


def document_lines(documents: DataFrame) -> DataFrame:
    """source, text_id, item_id, line_no, line of each newline-separated line of each document with a source."""
    src = documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("source IS NOT NULL AND text IS NOT NULL")
    return src.select("source", F.col("item_id").alias("text_id"), "item_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def book_lines(rows: DataFrame, books: DataFrame) -> DataFrame:
    """source, text_id, item_id, line_no, line of each row whose book has a source; the text is the book."""
    own = books.select(F.col("book_id").cast("string").alias("book_id"), F.col("source").cast("string").alias("source")).filter("source IS NOT NULL").dropDuplicates(["book_id"])
    src = rows.select(F.col("book_id").cast("string").alias("book_id"), F.col("line_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("line"))
    return src.filter("line IS NOT NULL").join(own, "book_id").select("source", F.xxhash64("book_id").alias("text_id"), "item_id", F.lit(0).alias("line_no"), "line")


def once(c: Column, name: str) -> Column:
    """c as a column that filters above it don't evaluate again, as a generator's."""
    return F.explode_outer(F.array(c)).alias(name)


def keyed_lines(lines: DataFrame, min_letters: int = 15) -> DataFrame:
    """src (hash of the source), text_id, item_id, line_no and key of the lines of at least ``min_letters`` letters, cut from
    their lineage. Lines are read once: those that need no explosion get their key at once, the others are kept for it."""
    keys = ["src", "text_id", "item_id", "line_no"]
    only = lines.select(F.xxhash64("source").alias("src"), *keys[1:], once(F.regexp_replace("line", r"[^\p{L}\p{M}]+", ""), "bare")).filter(F.length("bare") >= min_letters)
    only = only.select(*keys, "bare", once(needs_explosion(F.col("bare")), "hard"))
    plain = F.when(~F.col("hard"), F.regexp_replace(joined_letters(F.col("bare")), r"\P{L}+", ""))
    only = only.select(*keys, F.when(F.col("hard"), F.col("bare")).alias("bare"), once(plain, "plain")).filter(F.col("plain").isNull() | (F.length("plain") >= min_letters))
    only = cut(only.select(*keys, F.when(F.col("plain").isNotNull(), F.xxhash64(F.lower("plain"))).alias("key"), "bare"))
    hard = one_form(only.filter("bare IS NOT NULL").drop("key"), keys, "bare", where=letters("bare") >= min_letters)
    return only.filter("bare IS NULL").drop("bare").unionByName(cut(hard.select(*keys, F.xxhash64(F.lower(F.regexp_replace("one_form", r"\P{L}+", ""))).alias("key"))))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source: counters of the partition's lines, at most the source's capacity, and the error of the rest."""
    held: dict[int, tuple[dict, int]] = {}

    def shrink(counts: dict[int, int], size: int) -> tuple[dict[int, int], int]:
        if len(counts) <= size:
            return counts, 0
        values = np.fromiter(counts.values(), np.int64, len(counts))
        off = int(np.partition(values, len(values) - size - 1)[len(values) - size - 1])
        return {k: v - off for k, v in counts.items() if v > off}, off

    for batch in batches:
        src, key, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for s in np.unique(src):
            at = src == s
            k, n = np.unique(key[at], return_counts=True)
            counts, error = held.get(int(s), ({}, 0))
            for a, b in zip(k.tolist(), n.tolist()):
                counts[a] = counts.get(a, 0) + b
            most = int(size[at][0])
            if len(counts) > 2 * most:
                counts, off = shrink(counts, most)
                error += off
            held[int(s)] = counts, error
    for s, (counts, error) in held.items():
        # the row without a key carries the error of this summary
        yield pa.RecordBatch.from_arrays([pa.array([s] * (len(counts) + 1), pa.int64()), pa.array([None, *counts], pa.int64()), pa.array([error, *counts.values()], pa.int64())], ["src", "key", "n"])


def repeated_keys(keyed: DataFrame, texts: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """src and key of the lines that stand in at least ``least`` and ``share`` of the texts of their source. ``texts``
    has src and n_texts; ``keyed`` is read three times."""
    sizes = keyed.groupBy("src").agg(F.count("*").alias("n_lines")).join(texts, "src")
    # error of all summaries together is at most n_lines / capacity, held under half the threshold
    sizes = sizes.withColumn("need", F.greatest(F.lit(least).cast("double"), F.ceil(F.col("n_texts") * share - 1e-9).cast("double")))
    sizes = sizes.withColumn("size", F.least(F.ceil(2 * F.col("n_lines") / F.col("need")) + 1, F.lit(2**31 - 1)).cast("bigint"))
    sizes = cut(sizes.select("src", "need", "size"))
    small = F.broadcast(sizes) if small_enough(sizes, BROADCAST_ROWS) else sizes
    summed = keyed.select("src", "key").join(small, "src").select("src", "key", "size").mapInArrow(_summaries, "src bigint, key bigint, n bigint").groupBy("src", "key").agg(F.sum("n").alias("n"))
    summed = cut(summed)
    errors = summed.filter("key IS NULL").select("src", F.col("n").alias("error"))
    candidates = summed.filter("key IS NOT NULL").join(errors, "src").join(small, "src").filter("n + error >= need").select("src", "key", "need")
    candidates = cut(candidates)
    exact = join_keys(keyed, candidates, ["src", "key"]).select("src", "key", "need", "text_id").distinct().groupBy("src", "key", "need").agg(F.count("*").alias("n"))
    return exact.filter("n >= need").select("src", "key")


def repeated_lines(lines: DataFrame, texts: DataFrame, min_letters: int = 15, share: float = 0.05, least: int = 3) -> DataFrame:
    """item_id, line_no of all lines repeated too often within their source; ``texts`` has one row per text with its
    source."""
    keyed = keyed_lines(lines, min_letters)
    counted = texts.filter("source IS NOT NULL").groupBy(F.xxhash64("source").alias("src")).agg(F.count("*").alias("n_texts"))
    found = cut(repeated_keys(keyed, counted, share, least))
    return join_keys(keyed, found, ["src", "key"]).select("item_id", "line_no").distinct()


def repeated_in_documents(documents: DataFrame, **how) -> DataFrame:
    return repeated_lines(document_lines(documents), documents.select("source"), **how)


def repeated_in_books(rows: DataFrame, books: DataFrame, **how) -> DataFrame:
    return repeated_lines(book_lines(rows, books), books.select("source"), **how)


def without_repeats(documents: DataFrame, **how) -> DataFrame:
    """doc_id and text of every document, the text without the lines repeated too often within its source. Null texts
    stay null; a text of nothing else becomes empty."""
    gone = repeated_in_documents(documents, **how).groupBy(F.col("item_id").alias("doc_id")).agg(F.collect_set("line_no").alias("gone"))
    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return src.join(gone, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


def rows_without_repeats(rows: DataFrame, books: DataFrame, **how) -> DataFrame:
    """line_id, book_id, page_no, row_no and text of every delivered row that isn't repeated too often within the source of
    its book. Rows with a null text or without a source stay."""
    gone = repeated_in_books(rows, books, **how).select(F.col("item_id").alias("line_id")).distinct()
    src = rows.select(F.col("line_id").cast("bigint").alias("line_id"), "book_id", "page_no", "row_no", F.col("text").cast("string").alias("text"))
    return src.join(gone, "line_id", "left_anti").distinct()
