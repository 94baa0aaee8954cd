"""Pages put in the order of their printed numbers.

A page's number is chosen among its candidates by the pages around it, d pages away in the file and d numbers away in
print. Neighbours meet by the difference (or sum) of position and number and by blocks of positions, so no book is paired
with itself. Null candidates count as none; a page delivered twice counts by its latest delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators.delivery import latest
from leafwork.operators.sequences import last_known, missing, runs
from leafwork.session import cut

WINDOW = 8
ALIKE = 0.5
FEW_WORDS = 8


def pages(layouts: DataFrame) -> DataFrame:
    return latest(layouts, ["book_id", "page_no"], "loaded_at", F.col("quality").desc_nulls_last())


def candidates(layouts: DataFrame) -> DataFrame:
    """book_id, page_no, k, c: the candidates of each page in order."""
    text = pages(layouts).filter("kind = 'text'")
    return text.select("book_id", "page_no", F.posexplode("number_candidates").alias("k", "c")).filter("c IS NOT NULL")


def support(asked: DataFrame, given: DataFrame, window: int = WINDOW) -> DataFrame:
    """book_id, page_no, c, support: how many pages within ``window`` agree with number c. A neighbour's first candidate
    counts 1, its others one half, its best only. Pages without support are left out."""
    near = []
    for sign in (-1, 1):
        run = F.col("c") + sign * F.col("page_no")
        a = asked.select("book_id", "page_no", "c", run.alias("run"), F.floor(F.col("page_no") / window).alias("block"))
        b = given.select("book_id", F.col("page_no").alias("j"), "k", run.alias("run"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col("page_no") / window) + d)).alias("block"))
        near.append(a.join(b, ["book_id", "run", "block"]).filter((F.abs(F.col("page_no") - F.col("j")) <= window) & (F.col("page_no") != F.col("j"))).select("book_id", "page_no", "c", "j", F.when(F.col("k") == 0, 1.0).otherwise(0.5).alias("w")))
    both = near[0].unionByName(near[1]).groupBy("book_id", "page_no", "c", "j").agg(F.max("w").alias("w"))
    return both.groupBy("book_id", "page_no", "c").agg(F.sum("w").alias("support"))


def chosen_numbers(layouts: DataFrame) -> DataFrame:
    """book_id, page_no, number of the pages whose number its neighbours back: the best candidate (a first candidate gets
    the weight of one more neighbour; ties go to the larger number), backed again by the chosen ones alone, and not off a
    run that the numbered pages on both sides form."""
    cands = cut(candidates(layouts))
    backed = cands.join(support(cands.select("book_id", "page_no", "c").distinct(), cands), ["book_id", "page_no", "c"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    best = backed.withColumn("score", F.col("support") + (F.col("k") == 0).cast("double")).groupBy("book_id", "page_no").agg(F.max(F.struct("score", "c", "support")).alias("x"))
    first = cut(best.filter("x.support >= 1").select("book_id", "page_no", F.col("x.c").alias("c"), F.lit(0).alias("k")))
    again = cut(first.join(support(first, first), ["book_id", "page_no", "c"], "left_semi").select("book_id", "page_no", "c"))
    steps = F.explode(F.filter(F.sequence(F.lit(-WINDOW), F.lit(WINDOW)), lambda d: d != 0))
    around = again.select("book_id", F.col("page_no").alias("j"), F.col("c").alias("d"), steps.alias("step")).withColumn("page_no", F.col("j") + F.col("step"))
    sides = again.join(around, ["book_id", "page_no"]).groupBy("book_id", "page_no", "c").agg(
        F.max(F.when(F.col("j") < F.col("page_no"), F.struct("j", "d"))).alias("a"), F.min(F.when(F.col("j") > F.col("page_no"), F.struct("j", "d"))).alias("b")
    )
    up, apart = F.col("b.d") - F.col("a.d"), F.col("b.j") - F.col("a.j")
    fits = F.when(up == apart, F.col("c") == F.col("a.d") + F.col("page_no") - F.col("a.j")).when(up == -apart, F.col("c") == F.col("a.d") - F.col("page_no") + F.col("a.j")).otherwise(True)
    off = sides.filter(~F.coalesce(fits, F.lit(True))).select("book_id", "page_no")
    return again.join(off, ["book_id", "page_no"], "left_anti").select("book_id", "page_no", F.col("c").alias("number"))


def numbered(layouts: DataFrame, by_hand: DataFrame | None = None) -> DataFrame:
    """book_id, page_no, number, read: every page with its number, set by a person (``by_hand``: book_id, page_no, number, one
    row per page), chosen or inferred: from both sides where they form one
    run, else one on from the page before, else one back from the page after, unless a read page carries it; a book
    without numbers keeps the order of the file."""
    known = chosen_numbers(layouts)
    if by_hand is not None:
        own = pages(layouts).select("book_id", "page_no").join(by_hand.filter("number IS NOT NULL"), ["book_id", "page_no"])
        known = own.select("book_id", "page_no", "number").unionByName(known.join(own, ["book_id", "page_no"], "left_anti"))
    known = cut(known)
    every = pages(layouts).select("book_id", "page_no").join(known, ["book_id", "page_no"], "left")
    every = every.withColumn("pair", F.when(F.col("number").isNotNull(), F.struct("page_no", "number")))
    # the tables below are one row per page
    every = last_known(cut(every), ["book_id"], "page_no", "pair", "a")
    every = last_known(every, ["book_id"], "page_no", "pair", "b", back=True)
    i = F.col("page_no")
    up, apart = F.col("b.number") - F.col("a.number"), F.col("b.page_no") - F.col("a.page_no")
    run = F.when(up == apart, F.col("a.number") + (i - F.col("a.page_no"))).when(up == -apart, F.col("a.number") - (i - F.col("a.page_no")))
    guess = F.coalesce(run, F.col("a.number") + (i - F.col("a.page_no")), F.col("b.number") - (F.col("b.page_no") - i))
    every = every.withColumn("guess", F.when(F.col("number").isNull(), guess)).withColumn("on_run", run.isNotNull())
    taken = known.select("book_id", F.col("number").alias("guess"), F.lit(True).alias("taken")).distinct()
    every = every.join(taken, ["book_id", "guess"], "left")
    none = F.col("a").isNull() & F.col("b").isNull()
    number = F.coalesce("number", F.when(none, i), F.when(F.col("on_run") | F.col("taken").isNull(), F.col("guess")))
    return cut(every.select("book_id", "page_no", number.cast("int").alias("number"), F.col("number").isNotNull().alias("read")))


def page_words(rows: DataFrame) -> DataFrame:
    """book_id, page_no, words: the distinct words of three characters or more on each page (a joiner is part of a word)."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}_\x{200C}]+", " "), " "), lambda w: F.length(w) >= 3)
    return rows.filter("text IS NOT NULL").select("book_id", "page_no", words.alias("w")).groupBy("book_id", "page_no").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("words"))


def alike(a, b):
    """Whether two pages' words tell one page scanned twice; pages of few words only where both have few."""
    few = (F.size(a) < FEW_WORDS) | (F.size(b) < FEW_WORDS)
    return F.when(few, (F.size(a) < FEW_WORDS) & (F.size(b) < FEW_WORDS)).otherwise(F.size(F.array_intersect(a, b)) >= ALIKE * F.size(F.array_union(a, b)))


def page_order(layouts: DataFrame, rows: DataFrame, by_hand: DataFrame | None = None) -> DataFrame:
    """book_id, page_no, number, sort_key, status (own, apart, second_scan): the pages of one number are ranked by whether
    a person set it, whether it was read and by quality; the first owns it, pages that read like it are second scans, others stand apart right
    after it; pages without a number follow the page before them."""
    at = numbered(layouts, by_hand).join(pages(layouts).select("book_id", "page_no", "quality"), ["book_id", "page_no"])
    hand = F.lit(False)
    if by_hand is not None:
        at, hand = at.join(by_hand.filter("number IS NOT NULL").select("book_id", "page_no", F.lit(True).alias("hand")), ["book_id", "page_no"], "left"), F.col("hand").isNotNull()
    # words are compared only where pages share a number
    shared = at.filter("number IS NOT NULL").groupBy("book_id", "number").agg(F.count("*").alias("n")).filter("n > 1")
    twice = at.join(shared, ["book_id", "number"], "left_semi").select("book_id", "page_no")
    at = at.join(page_words(rows.join(twice, ["book_id", "page_no"], "left_semi")), ["book_id", "page_no"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    rank = F.struct(hand.alias("hand"), "read", F.coalesce("quality", F.lit(0.0)).alias("quality"), (-F.col("page_no")).alias("back"))
    owners = at.filter("number IS NOT NULL").groupBy("book_id", "number").agg(F.max(rank).alias("best"), F.max_by("words", rank).alias("owner_words")).withColumn("owner", -F.col("best.back"))
    got = at.join(owners.select("book_id", "number", "owner", "owner_words"), ["book_id", "number"], "left")
    status = F.when(F.col("number").isNull(), "apart").when(F.col("page_no") == F.col("owner"), "own").when(alike(F.col("words"), F.col("owner_words")), "second_scan").otherwise("apart")
    got = cut(got.withColumn("status", status).select("book_id", "page_no", "number", "status").withColumn("own", F.when(F.col("status") == "own", F.col("number"))))
    got = last_known(got, ["book_id"], "page_no", "own", "before", strictly=True)
    key = F.when(F.col("status") == "apart", F.coalesce("before", F.lit(0)) + 0.5).otherwise(F.col("number").cast("double"))
    return got.select("book_id", "page_no", "number", key.alias("sort_key"), "status")


def reversed_runs(layouts: DataFrame) -> DataFrame:
    """book_id, first_page, last_page, first_number: maximal stretches of the file whose numbers fall by one from page to
    page."""
    at = numbered(layouts).filter("number IS NOT NULL").select("book_id", "page_no", "number")
    after = at.select("book_id", (F.col("page_no") - 1).alias("page_no"), F.col("number").alias("n2"))
    down = at.join(after, ["book_id", "page_no"]).filter("n2 = number - 1").select("book_id", "page_no")
    stretch = runs(down, ["book_id"], "page_no").select("book_id", F.col("first").alias("page_no"), (F.col("last") + 1).alias("last_page"))
    return stretch.join(at, ["book_id", "page_no"]).select("book_id", F.col("page_no").alias("first_page"), "last_page", F.col("number").alias("first_number"))


def missing_numbers(layouts: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """book_id, first, last: gaps in the numbers of a book's pages; with ``order`` (page_order) a gap in which a page without a
    number stands isn't reported, as that page may be the missing one."""
    if order is None:
        return missing(numbered(layouts), ["book_id"], "number")
    gaps = missing(order, ["book_id"], "number")
    loose = order.filter("status = 'apart'").select("book_id", F.floor("sort_key").cast("bigint").alias("loose"))
    filled = gaps.join(loose, "book_id").filter("loose BETWEEN first - 1 AND last").select("book_id", "first").distinct()
    return gaps.join(filled, ["book_id", "first"], "left_anti").select("book_id", "first", "last")
