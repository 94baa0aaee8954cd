"""Line features of scanned pages as window expressions, page and book statistics. A page is (book_id, page_no).

Windows are partitioned by page, which is bounded; book statistics are aggregates joined back, so that a book of a third
of all rows is pre-aggregated like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as X
from leafwork.operators.delivery import latest

PAGE = ["book_id", "page_no"]
GOOD_CONF = 85
GAP_CAP = 60.0
SMALL = 0.9


def text_lines(rows: DataFrame) -> DataFrame:
    """The latest delivery of each row that holds text, with its corners and height."""
    one = latest(rows, ["line_id"], "loaded_at", F.col("text"))
    box = F.col("bbox")
    return one.filter("trim(text) <> ''").select("line_id", "book_id", "page_no", "row_no", "col_no", "text", "conf", "words", *[G.corner(box, i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], G.height(box).alias("h"))


def is_noise(conf: Column, text: Column) -> Column:
    """Specks and dirt: read with low confidence, or one or two characters that are no number and not sure."""
    t = F.trim(text)
    return (conf < 50) | ((F.length(t) <= 2) & ~X.is_digits(t) & (conf < 90))


def is_good(conf: Column, text: Column) -> Column:
    return (conf >= GOOD_CONF) & (F.length(text) >= 2)


def is_latin(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z]")) >= 3) & (X.latin_ratio(text) >= 0.5)


def keeps_short(conf: Column, text: Column) -> Column:
    """Short unsure lines are dropped unless they are a number."""
    return (F.length(text) > 4) | (conf >= 80) | X.is_digits(text)


def page_quality(lines: DataFrame) -> DataFrame:
    """book_id, page_no, n_lines, n_good, quality: the good lines' confidence over all lines, less on pages of few."""
    good = is_good(F.col("conf"), F.col("text")) & ~is_noise(F.col("conf"), F.col("text"))
    agg = lines.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.count_if(good).alias("n_good"), F.sum(F.when(good, F.col("conf"))).alias("s"))
    return agg.select(*PAGE, "n_lines", "n_good", (F.coalesce("s", F.lit(0.0)) / F.greatest("n_lines", F.lit(1)) / 100 * F.least(F.lit(1.0), F.col("n_good") / 10)).alias("quality"))


def placed(lines: DataFrame) -> DataFrame:
    """Lines with their place from the top of the page (rank, rank_rev, n_lines) and the gaps to their neighbours, or the page's
    edge, in line heights of the book. Tables hold no page sizes: a book's pages are as wide and high (page_w, page_h) as its
    lines reach."""
    heights = lines.groupBy("book_id").agg(F.median(F.when(F.col("conf") >= 70, F.col("h"))).alias("a"), F.median("h").alias("b"), F.max("y1").alias("page_h"), F.max("x1").alias("page_w"))
    heights = heights.select("book_id", F.coalesce("a", "b").alias("h_med"), "page_h", "page_w")
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    whole = W.partitionBy(*PAGE)
    df = lines.join(heights, "book_id").withColumn("rank", F.row_number().over(w) - 1).withColumn("n_lines", F.count("*").over(whole))
    clip = lambda c: F.greatest(F.lit(-GAP_CAP), F.least(F.lit(GAP_CAP), c))
    up = (F.col("y0") - F.lag("y1").over(w)) / F.col("h_med")
    down = (F.lead("y0").over(w) - F.col("y1")) / F.col("h_med")
    return df.withColumn("rank_rev", F.col("n_lines") - 1 - F.col("rank")).withColumn("gap_up", clip(F.coalesce(up, F.col("y0") / F.col("h_med")))).withColumn("gap_down", clip(F.coalesce(down, (F.col("page_h") - F.col("y1")) / F.col("h_med")))).withColumn("h_book", F.col("h") / F.col("h_med"))


def neighbours(lines: DataFrame, columns: list[str]) -> DataFrame:
    """prev_ and next_ values of columns of placed lines, -1 at the ends of the page."""
    w = W.partitionBy(*PAGE).orderBy("rank")
    return lines.withColumns({f"{p}{c}": F.coalesce(f(c).over(w), F.lit(-1.0)) for c in columns for p, f in (("prev_", F.lag), ("next_", F.lead))})


def small_runs(lines: DataFrame) -> DataFrame:
    """Placed lines with tail_small, the share of small lines from here to the end of the page, and small_run_up, the
    length of the run of small lines right above."""
    w = W.partitionBy(*PAGE).orderBy("rank")
    df = lines.withColumn("small", (F.col("h_book") < SMALL).cast("int"))
    df = df.withColumn("tail_small", F.avg("small").over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    last = F.max(F.when(F.col("small") == 0, F.col("rank"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("small_run_up", F.col("rank") - 1 - F.coalesce(last, F.lit(-1)))


def size_rank(lines: DataFrame) -> DataFrame:
    """Lines with size_rank, the share of the book's lines that are no taller. By a histogram of heights, so that no book
    is one window."""
    sizes = lines.groupBy("book_id", "h").agg(F.count("*").alias("n"))
    w = W.partitionBy("book_id").orderBy("h")
    ranks = sizes.select("book_id", "h", (F.sum("n").over(w) / F.sum("n").over(W.partitionBy("book_id"))).alias("size_rank"))
    return lines.join(ranks, ["book_id", "h"])


def repeat_share(lines: DataFrame, first: int = 2) -> DataFrame:
    """book_id, key, n_pages, share: texts among the first lines of pages, and the share of the book's pages with them."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    top = lines.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= first).select(*PAGE, X.repeat_key(F.col("text")).alias("key")).filter("length(key) >= 3")
    pages = lines.select(*PAGE).distinct().groupBy("book_id").agg(F.count("*").alias("pages"))
    counts = top.distinct().groupBy("book_id", "key").agg(F.count("*").alias("n_pages"))
    return counts.join(pages, "book_id").select("book_id", "key", "n_pages", (F.col("n_pages") / F.col("pages")).alias("share"))


def block_metrics(lines: DataFrame) -> DataFrame:
    """book_id, page_no, right_edge, left_edge, lh, pitch: the text block of each page over its wide lines (wider than half
    the widest), outer fifths cut; pitch is the middle step between lines, 1.3 line heights without steps."""
    whole = W.partitionBy(*PAGE)
    df = lines.withColumn("w", F.col("x1") - F.col("x0")).withColumn("wide", F.col("w") > 0.5 * F.max("w").over(whole))
    w = whole.orderBy("y0", "row_no")
    df = df.withColumn("step", (F.col("y0") + F.col("y1") - F.lag(F.col("y0") + F.col("y1")).over(w)) / 2)
    at = df.groupBy(*PAGE).agg(
        F.percentile(F.when(F.col("wide"), F.col("x1")), 0.8).alias("right_edge"), F.percentile(F.when(F.col("wide"), F.col("x0")), 0.2).alias("left_edge"), F.median(F.when(F.col("wide"), F.col("h"))).alias("lh"), F.collect_list("step").alias("steps"),
    )
    # a page's steps are few
    fit = F.filter("steps", lambda s: (s > 0) & (s < 2.5 * F.col("lh")))
    s = F.array_sort(fit)
    n = F.size(s)
    mid = (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return at.select(*PAGE, "right_edge", "left_edge", "lh", F.when(n > 0, mid).otherwise(1.3 * F.col("lh")).alias("pitch"))


#: Margins of the zones, where they lie in a book without full pages, lines of a full page, top of the text without one.
ZONE, TOP, FOOT, FULL_PAGE, BOOK_TOP = 0.04, 0.06, 0.92, 8, 0.08


def zones(lines: DataFrame, least: int = FULL_PAGE) -> DataFrame:
    """book_id, top_zone, foot_zone: shares of the page's height above and below which furniture is looked for: lower quartile
    of the first and upper quartile of the last line that is no noise on pages of at least ``least``, widened by ZONE."""
    size = lines.groupBy("book_id").agg(F.max("y1").alias("page_h"))
    clean = lines.filter(~is_noise(F.col("conf"), F.col("text")))
    pages = clean.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("y0").alias("a"), F.max("y1").alias("b")).filter(F.col("n") >= least).join(size, "book_id")
    edges = pages.groupBy("book_id").agg(F.percentile(F.col("a") / F.col("page_h"), 0.25).alias("a"), F.percentile(F.col("b") / F.col("page_h"), 0.75).alias("b"))
    return size.join(edges, "book_id", "left").select("book_id", (F.coalesce("a", F.lit(TOP)) + ZONE).alias("top_zone"), (F.coalesce("b", F.lit(FOOT)) - ZONE).alias("foot_zone"))


def book_tops(lines: DataFrame, least: int = FULL_PAGE) -> DataFrame:
    """book_id, book_top: lower quartile, over pages of at least ``least`` lines that are no noise, of the share of the page's
    height at which its wide lines begin."""
    size = lines.groupBy("book_id").agg(F.max("y1").alias("page_h"))
    wide = F.col("w") > 0.5 * F.max("w").over(W.partitionBy(*PAGE))
    at = lines.withColumn("w", F.col("x1") - F.col("x0")).withColumn("wide", wide)
    pages = at.groupBy(*PAGE).agg(F.min(F.when(F.col("wide"), F.col("y0"))).alias("top"), F.count_if(~is_noise(F.col("conf"), F.col("text"))).alias("n")).filter(F.col("n") >= least).join(size, "book_id")
    tops = pages.groupBy("book_id").agg(F.percentile(F.col("top") / F.col("page_h"), 0.25).alias("t"))
    return size.join(tops, "book_id", "left").select("book_id", F.coalesce("t", F.lit(BOOK_TOP)).alias("book_top"))


def places(lines: DataFrame) -> DataFrame:
    """Placed lines with h_page (height in middle heights of the page), first_y (where the page's first line stands, in page
    heights), y_vs_book_top (the same against the book's lower quartile) and page_pos (the page among the book's)."""
    page = lines.groupBy(*PAGE).agg(F.median("h").alias("h_mid"), (F.min("y0") / F.first("page_h")).alias("first_y"))
    book = page.groupBy("book_id").agg(F.percentile("first_y", 0.25).alias("usual"), F.max("page_no").alias("last"))
    at = lines.join(page, PAGE).join(book, "book_id")
    return at.withColumns({"h_page": F.col("h") / F.col("h_mid"), "y_vs_book_top": F.col("first_y") - F.col("usual"), "page_pos": F.col("page_no") / F.col("last")}).drop("h_mid", "usual", "last")


def middle_of(df: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """keys and ``to``, the upper of the two middle values. By a histogram of values, so that no group is one list."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    by = W.partitionBy(*keys).orderBy(value)
    at = counts.withColumn("__upto", F.sum("__n").over(by)).withColumn("__all", F.sum("__n").over(W.partitionBy(*keys)))
    return at.filter(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min(value).alias(to))


def style_counts(lines: DataFrame) -> DataFrame:
    """Placed lines with style_n and first_n: log of one more than the book's lines of the same height and width class,
    and of the same first word."""
    style = [F.bround(F.col("h_book") * 10).cast("int").alias("size_class"), ((F.col("x1") - F.col("x0")) / 200).cast("int").alias("width_class"), X.letters_only(F.split(F.trim("text"), r"\s+")[0]).alias("first_word")]
    df = lines.withColumns({"size_class": style[0], "width_class": style[1], "first_word": style[2]})
    a = df.groupBy("book_id", "size_class", "width_class").agg(F.log1p(F.count("*")).alias("style_n"))
    b = df.groupBy("book_id", "first_word").agg(F.log1p(F.count("*")).alias("first_n"))
    return df.join(a, ["book_id", "size_class", "width_class"]).join(b, ["book_id", "first_word"])


def _beside(lines: DataFrame) -> DataFrame:
    """Lines with their page's block and ind, sl: the free shares of the block's width on the right and the left."""
    at = lines.join(block_metrics(lines), PAGE).withColumn("bw", F.col("right_edge") - F.col("left_edge")).filter("bw > 1")
    return at.withColumn("ind", (F.col("right_edge") - F.col("x1")) / F.col("bw")).withColumn("sl", (F.col("x0") - F.col("left_edge")) / F.col("bw"))


def indent_mode(lines: DataFrame, least: int = 20) -> DataFrame:
    """book_id, indent: the commonest right indent of the lines right below a line that ends short, in bins of half a
    hundredth of the block, counts smoothed over neighbours 1-2-1; .04 with fewer than ``least``. Ties go to the smaller."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    at = _beside(lines).withColumn("short", F.lag("sl").over(w) > 0.06).withColumn("gap", F.col("y0") - F.lag("y1").over(w))
    at = at.filter("short AND gap >= 0 AND gap < lh AND ind BETWEEN 0.015 AND 0.15").withColumn("bin", F.bround(F.col("ind") * 200).cast("int"))
    counts = at.groupBy("book_id", "bin").agg(F.count("*").alias("n"))
    spread = counts.select("book_id", F.inline(F.array(*[F.struct((F.col("bin") + d).alias("bin"), (F.col("n") * k).alias("n"), (F.col("n") * int(d == 0)).alias("own")) for d, k in ((-1, 1), (0, 2), (1, 1))])))
    smooth = spread.groupBy("book_id", "bin").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).filter("own > 0")
    best = smooth.groupBy("book_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("bin")))["bin"].alias("b"), F.sum("own").alias("k"))
    return lines.select("book_id").distinct().join(best, "book_id", "left").select("book_id", F.when(F.coalesce("k", F.lit(0)) < least, F.lit(0.04)).otherwise(-F.col("b") / 200).alias("indent"))


def page_tests(lines: DataFrame, least: int = 6) -> DataFrame:
    """book_id, page_no, n, full (share of lines that reach both margins), hanging (a list whose entries wrap to an indented line
    below a full one) and poem (verse: few full lines, most aligned right or centred, short lines not followed by indented
    ones); pages of fewer than ``least`` lines are neither."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    ltr = X.latin_ratio(F.col("text")) > 0.5
    at = _beside(lines).join(indent_mode(lines), "book_id").withColumn("near", F.when(ltr, F.col("sl")).otherwise(F.col("ind"))).withColumn("far", F.when(ltr, F.col("ind")).otherwise(F.col("sl")))
    at = at.withColumns({"after_full": F.lag("far").over(w) < 0.03, "second": F.row_number().over(w) > 1, "next_ind": F.lead("ind").over(w)})
    wraps = (F.col("near") > 0.02) & F.col("second")
    short = (F.col("sl") > 0.06) & F.col("next_ind").isNotNull()
    got = at.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.avg(((F.col("sl") < 0.03) & (F.col("ind") < 0.03)).cast("int")).alias("full"), F.count_if(wraps).alias("wraps"), F.count_if(wraps & F.col("after_full")).alias("wraps_full"),
        F.avg(((F.col("ind") < 0.02) | (F.abs(F.col("sl") - F.col("ind")) < 0.03)).cast("int")).alias("aligned"), F.count_if(short).alias("short"), F.count_if(short & (F.col("next_ind") > 0.6 * F.col("indent"))).alias("short_ind"),
    )
    n = F.col("n")
    hanging = (n >= least) & (F.col("wraps") >= 3) & (F.col("wraps") >= 0.25 * n) & (F.col("wraps_full") >= 0.7 * F.col("wraps"))
    poem = (n >= least) & (F.col("full") < 0.5) & (F.col("aligned") >= 0.8) & (F.col("short") >= 0.3 * (n - 1)) & (F.col("short_ind") < 0.3 * F.col("short"))
    return got.select(*PAGE, "n", "full", hanging.alias("hanging"), poem.alias("poem"))


def readable_letters(lines: DataFrame) -> DataFrame:
    """book_id, page_no, letters: Arabic-script letters in lines of at least three characters read with confidence."""
    sure = (F.col("conf") >= 80) & (F.length(F.trim("text")) >= 3)
    return lines.groupBy(*PAGE).agg(F.coalesce(F.sum(F.when(sure, F.regexp_count("text", F.lit("[؀-ۿ]")))), F.lit(0)).alias("letters"))


def turn(upright: Column, left: Column, right: Column, least: int = 20) -> Column:
    """0, 90 or 270: the turn at which a figure's page reads best, if it reads at least ``least`` letters and twice as many as
    upright."""
    best = F.when((left > upright) & (left >= right), 90).when((right > upright) & (right > left), 270).otherwise(0)
    score = F.greatest(upright, left, right)
    return F.when((best != 0) & (score >= F.greatest(F.lit(least), 2 * upright)), best).otherwise(0)


def stamp_lines(lines: DataFrame) -> DataFrame:
    """line_id of the lines in a margin of the page (12 % of its height, 10 % of its width) that name a site, mail or channel
    in 3 to 60 characters. Lines are placed (see placed)."""
    margin = (F.col("y1") <= 0.12 * F.col("page_h")) | (F.col("y0") >= 0.88 * F.col("page_h")) | (F.col("x1") <= 0.1 * F.col("page_w")) | (F.col("x0") >= 0.9 * F.col("page_w"))
    # Fixed value: what names a site, mail or channel.
    named = F.trim("text").rlike(r"(?i)www\.|https?://|\.(?:com|net|org|ir|me|info|co)\b|@\w{3,}|t\.me/|telegram")
    return lines.filter(margin & F.length(F.trim("text")).between(3, 60) & named).select("line_id")


def centred(lines: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """line_id of the placed lines that stand in the middle of the page, both margins wide and about equal."""
    left, right = F.col("x0") / F.col("page_w"), 1 - F.col("x1") / F.col("page_w")
    return lines.filter((left > 0.12) & (right > 0.12) & (F.abs(left - right) < tolerance)).select("line_id")


def sure_lines(lines: DataFrame, first: int = 8) -> DataFrame:
    """book_id, page_no, k, line_id: the first lines of each page from the top that are read with confidence and hold two
    letters."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    sure = lines.filter((F.col("conf") >= GOOD_CONF) & (F.length(X.letters_only(F.col("text"))) >= 2))
    return sure.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= first).select(*PAGE, "k", "line_id")


def frequent_headers(lines: DataFrame, least: int = 4) -> DataFrame:
    """book_id, key, n: letters (ASCII ones left out) of pages' top lines, of four letters or more, on at least ``least``
    pages."""
    top = lines.groupBy(*PAGE).agg(F.min_by("text", F.struct("y0", "row_no")).alias("text"))
    key = F.regexp_replace("text", r"[^\p{L}]|[A-Za-z]", "")
    return top.select("book_id", key.alias("key")).filter("length(key) >= 4").groupBy("book_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def word_stats(lines: DataFrame) -> DataFrame:
    """line_id, n_words, weakest, mean_conf (one decimal, halves to even): of the words' confidences; nulls are left
    out."""
    confs = F.filter(F.transform("words", lambda w: w["conf"]), lambda c: c.isNotNull())
    mean = F.aggregate(confs, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(confs), F.lit(0))
    return lines.select("line_id", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), F.array_min(confs).alias("weakest"), F.bround(mean, 1).alias("mean_conf"))


def stamp_texts(lines: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """book_id, key, n_pages: texts (lower case, no blanks, three characters or more) on at least ``least`` pages and
    ``share`` of the book's pages: a stamp over the scans."""
    key = F.lower(F.regexp_replace("text", r"\s", ""))
    pages = lines.groupBy("book_id").agg(F.count_distinct("page_no").alias("pages"))
    n = lines.select("book_id", "page_no", key.alias("key")).filter("length(key) >= 3").distinct().groupBy("book_id", "key").agg(F.count("*").alias("n_pages"))
    return n.join(pages, "book_id").filter((F.col("n_pages") >= least) & (F.col("n_pages") >= share * F.col("pages"))).select("book_id", "key", "n_pages")


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, similarity: Pearson's correlation, 0 where a side is flat."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return df.groupBy(*keys).agg(F.covar_pop(a, b).alias("c"), spread.alias("s")).select(*keys, F.coalesce(F.try_divide("c", "s"), F.lit(0.0)).alias("similarity"))


def in_block(lines: DataFrame, least_chars: int = 20) -> DataFrame:
    """Placed lines with ind_r, short_l, c_col and fill: their place in the column of the page's ordinary lines (long and of
    the book's height), or of the book's where a page has fewer than three or its column is much narrower."""
    ordinary = (F.length("text") >= least_chars) & F.col("h_book").between(0.8, 1.25)
    middle = lambda c: F.percentile(F.when(ordinary, F.col(c)), 0.5)
    book = lines.groupBy("book_id").agg(F.coalesce(middle("x0"), F.median("x0")).alias("bl"), F.coalesce(middle("x1"), F.median("x1")).alias("br"))
    page = lines.groupBy(*PAGE).agg(middle("x0").alias("pl"), middle("x1").alias("pr"), F.count_if(ordinary).alias("n"))
    at = lines.join(page, PAGE).join(book, "book_id")
    own = (F.col("n") >= 3) & (F.col("pr") - F.col("pl") >= 0.85 * (F.col("br") - F.col("bl")))
    at = at.withColumn("cl", F.when(own, F.col("pl")).otherwise(F.col("bl"))).withColumn("cr", F.when(own, F.col("pr")).otherwise(F.col("br")))
    w = F.greatest(F.col("cr") - F.col("cl"), F.lit(1e-6))
    return at.withColumns({"ind_r": (F.col("cr") - F.col("x1")) / w, "short_l": (F.col("x0") - F.col("cl")) / w, "c_col": ((F.col("x0") + F.col("x1")) / 2 - (F.col("cl") + F.col("cr")) / 2) / w, "fill": (F.col("x1") - F.col("x0")) / w}).drop("pl", "pr", "bl", "br", "n")


def full_share(lines: DataFrame, full: float = 0.9) -> DataFrame:
    """book_id, page_no, n, share: the share of a page's lines (see in_block) that fill their column: low on pages of
    verse."""
    return lines.groupBy(*PAGE).agg(F.count("*").alias("n"), F.avg((F.col("fill") >= full).cast("int")).alias("share"))


def paragraph_starts(lines: DataFrame) -> DataFrame:
    """line_id, starts, stanza: whether a paragraph starts with the line (indented, below a line that ends short, or below a gap
    wider than the book's leading leaves; the first line of a page by its indent alone), and whether a stanza would."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    at = _beside(lines).join(indent_mode(lines), "book_id").withColumn("up_sl", F.lag("sl").over(w)).withColumn("space", F.col("y0") - F.lag("y1").over(w))
    gap = (F.col("space") - F.greatest(F.lit(0.0), F.col("pitch") - F.col("lh"))) / F.col("lh") + 0.2
    indented = F.col("ind") > F.least(F.lit(0.05), F.greatest(F.lit(0.015), 0.6 * F.col("indent")))
    starts = indented | F.coalesce(F.col("up_sl") > 0.06, F.lit(False)) | F.coalesce(gap > 0.9, F.lit(False))
    return at.select("line_id", starts.alias("starts"), F.coalesce(F.col("space") > 0.9 * F.col("lh"), F.lit(False)).alias("stanza"))


def header_likes(lines: DataFrame, alike: float = 0.8) -> DataFrame:
    """line_id of the top lines of pages whose letters are like a frequent header's of their book. A book's frequent headers are
    few: each stands on four pages or more."""
    w = W.partitionBy(*PAGE).orderBy("y0", "row_no")
    top = lines.withColumn("k", F.row_number().over(w)).filter("k = 1").select("line_id", "book_id", F.regexp_replace("text", r"[^\p{L}]|[A-Za-z]", "").alias("own")).filter("length(own) >= 4")
    different = top.select("book_id", "own").distinct().join(frequent_headers(lines).select("book_id", "key"), "book_id")
    like = different.withColumn("like", X.similarity(F.col("own"), F.col("key"))).filter(F.col("like") >= alike).select("book_id", "own").distinct()
    return top.join(like, ["book_id", "own"], "left_semi").select("line_id")


def word_letters(lines: DataFrame) -> DataFrame:
    """line_id, joined, alnum: the words of a line joined by blanks, and how many letters and digits they hold."""
    joined = F.array_join(F.transform(F.coalesce("words", F.array().cast("array<struct<text:string,bbox:array<int>,conf:double>>")), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return lines.select("line_id", joined.alias("joined")).withColumn("alnum", F.length(F.regexp_replace("joined", r"[^\p{L}\p{N}]", "")))
