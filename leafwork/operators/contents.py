"""Printed contents: entries, their page numbers put right, and the entries' places among the pages.

A list is (book_id, list) with entries in order ``pos``. Null numbers stay null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.operators.sequences import last_known, running_max

D = "0-9۰-۹٠-٩"
#: Greatest distance from the printed page that counts between equal chains.
FAR = 50


def entry_number(text: Column) -> Column:
    """Page number at the end of a contents line, after a blank, leaders or a bar; null without one."""
    return X.contents_number(F.regexp_extract(text, rf"[.…\s\-–|]+([{D}][{D}.]*)\s*$", 1))


def entry_title(text: Column) -> Column:
    """A contents line without its number and leaders."""
    bare = F.when(entry_number(text).isNotNull(), F.regexp_replace(text, rf"[.…\s\-–|]+[{D}][{D}.]*\s*$", "")).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?:\s*[.…·]){2,}", " "), r"^[\s.…:|]+|[\s.…:|]+$", ""))


def contents_pages(lines: DataFrame, least: int = 5, share: float = 0.5, rising: float = 0.8) -> DataFrame:
    """book_id, page_no, n, numbered: pages of which ``share`` of at least ``least`` lines end in a number, and whose
    numbers rise down the page in ``rising`` of the steps."""
    from pyspark.sql import Window as W

    at = lines.withColumn("number", entry_number(F.col("text")))
    inner = W.partitionBy("book_id", "page_no").orderBy("y0", "row_no").rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("before", F.when(F.col("number").isNotNull(), F.last("number", ignorenulls=True).over(inner)))
    per = at.groupBy("book_id", "page_no").agg(F.count("*").alias("n"), F.count("number").alias("numbered"), F.count("before").alias("steps"), F.count_if(F.col("number") >= F.col("before")).alias("up"))
    return per.filter((F.col("numbered") >= least) & (F.col("numbered") >= share * F.col("n")) & (F.col("up") >= rising * F.col("steps"))).select("book_id", "page_no", "n", "numbered")


def read_zeros(entries: DataFrame, last_page: int) -> DataFrame:
    """entries with ``number`` less a zero that a leader dot was read for: numbers beyond the book or beyond the next
    number that fits, of which a tenth fits; what is still beyond the book becomes null."""
    fits = entries.withColumn("fit", F.when(F.col("number") <= last_page, F.col("number")))
    at = last_known(fits, ["book_id", "list"], "pos", "fit", "next", back=True, strictly=True)
    n, nxt = F.col("number"), F.col("next")
    cut = (n % 10 == 0) & ((n > last_page) | F.coalesce((n > nxt) & (F.floor(n / 10) <= nxt), F.lit(False)))
    fixed = F.when(cut, F.floor(n / 10).cast("int")).otherwise(n)
    return at.withColumn("number", F.when(fixed <= last_page, fixed)).drop("fit", "next")


def drop_unordered(entries: DataFrame) -> DataFrame:
    """entries with null for a number smaller than one listed before it."""
    at = running_max(entries, ["book_id", "list"], "pos", "number", "top")
    return at.withColumn("number", F.when(F.col("top").isNull() | (F.col("number") >= F.col("top")), F.col("number"))).drop("top")


def numbered_labels(entries: DataFrame) -> DataFrame:
    """entries with bare labels numbered: where a list holds a label word alone at least once and twice in all, its entries
    are numbered in order."""
    from pyspark.sql import Window as W

    label = F.regexp_extract(F.trim("title"), rf"^(فصل|بخش|قسمت|گفتار|دفتر|پیوست)(?:\s+[{D}]{{1,3}})?$", 1)
    at = entries.withColumn("label", F.nullif(label, F.lit("")))
    w = W.partitionBy("book_id", "list", "label")
    at = at.withColumn("k", F.row_number().over(w.orderBy("pos"))).withColumn("many", F.count("*").over(w)).withColumn("bare", F.max((F.trim("title") == F.col("label")).cast("int")).over(w))
    name = F.when(F.col("label").isNotNull() & (F.col("many") >= 2) & (F.col("bare") == 1), F.concat("label", F.lit(" "), X.persian_digits(F.col("k")))).otherwise(F.col("title"))
    return at.withColumn("title", name).drop("label", "k", "many", "bare")


def longest_chain(cands: list[list[int]], wanted: list[int | None]) -> dict[int, int]:
    """Page of each entry on the longest chain of entries with pages that don't fall; of equal chains the one nearest to
    the printed pages, then the earlier pages. ``cands``: the pages an entry may stand on."""
    # best chain that ends at each page so far: (length, -distance), back pointer
    ends: dict[int, tuple[tuple[int, int], int]] = {}
    nodes: list[tuple[int, int, int]] = []
    for i, pages in enumerate(cands):
        fresh = {}
        for page in sorted(set(pages)):
            far = min(abs(page - wanted[i]), FAR) if wanted[i] is not None else 0
            before = max(((ends[p][0], -p, ends[p][1]) for p in ends if p <= page), default=((0, 0), 0, -1))
            rank = before[0][0] + 1, before[0][1] - far
            if page not in ends or rank > ends[page][0]:
                nodes.append((i, page, before[2]))
                fresh[page] = rank, len(nodes) - 1
        ends |= fresh
    if not ends:
        return {}
    at = max(((rank, -page, node) for page, (rank, node) in ends.items()))[2]
    out = {}
    while at >= 0:
        i, page, at = nodes[at]
        out[i] = page
    return out


def align(entries: DataFrame, heads: DataFrame, alike: float = 0.8) -> DataFrame:
    """book_id, pos, page: the page of each entry whose title is like one of the first lines (``heads``: book_id, page,
    text) of a page, in the order of the list. Titles and lines meet by shared trigrams; a book's contents are one
    group, which is bounded by what a book lists."""
    e = entries.select("book_id", "pos", "number", X.letters_only(F.col("title")).alias("a"))
    h = heads.select("book_id", "page", X.letters_only(F.col("text")).alias("b"))
    gram = lambda c: F.explode(X.trigrams(F.col(c)))
    near = e.filter("length(a) >= 3").select("book_id", "pos", "a", gram("a").alias("g")).join(h.select("book_id", "page", "b", gram("b").alias("g")), ["book_id", "g"])
    pairs = near.groupBy("book_id", "pos", "page", "a", "b").agg(F.count("*").alias("k")).filter("k >= 0.4 * length(a)")
    hits = pairs.filter((X.similarity("a", "b") >= alike) | F.col("b").startswith(F.col("a"))).select("book_id", "pos", "page").distinct()
    every = e.select("book_id", "pos", "number").join(hits.groupBy("book_id", "pos").agg(F.collect_list("page").alias("pages")), ["book_id", "pos"], "left")

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cands = [[int(p) for p in x] if x is not None else [] for x in pdf.pages]
        got = longest_chain(cands, [None if pd.isna(n) else int(n) for n in pdf.number])
        pos = pdf.pos.tolist()
        return pd.DataFrame([(key[0], pos[i], p) for i, p in sorted(got.items())], columns=["book_id", "pos", "page"])

    return every.groupBy("book_id").applyInPandas(chain, "book_id string, pos int, page int")
