"""Pages as text columns, ready for Spark's writers. A page is one row; its lines are bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.text import escape_html

PAGE = ["book_id", "page_no"]


def page_text(lines: DataFrame) -> DataFrame:
    """book_id, page_no, text: one printed line per line, columns in order, each ended by a newline."""
    rows = F.array_sort(F.collect_list(F.struct("col_no", "y0", "row_no", "text")))
    return lines.groupBy(*PAGE).agg(rows.alias("v")).select(*PAGE, F.concat(F.array_join(F.transform("v", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def page_json(lines: DataFrame) -> DataFrame:
    """book_id, page_no, pos, value: one JSON object per line, words' confidences with one decimal."""
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), F.round(w["conf"], 1).alias("conf")))
    box = F.array("x0", "y0", "x1", "y1")
    value = F.to_json(F.struct(F.format_string("p-%03d", "page_no").alias("page"), F.col("col_no").alias("column"), box.alias("bbox"), "text", "conf", words.alias("words")))
    return lines.select(*PAGE, F.col("row_no").alias("pos"), value.alias("value"))


def hocr(lines: DataFrame, language: str = "fas") -> DataFrame:
    """book_id, page_no, html: page, column, paragraph, line and word elements with boxes and confidences. Ids of lines and words
    run through the page, those of columns and paragraphs are the columns' numbers; words without a confidence have 0."""
    from pyspark.sql import Window as W

    page = W.partitionBy(*PAGE).orderBy("col_no", "y0", "row_no")
    at = lines.withColumn("words", F.coalesce("words", F.array().cast("array<struct<text:string,bbox:array<int>,conf:double>>")))
    at = at.withColumn("n_line", F.row_number().over(page)).withColumn("n_word", F.coalesce(F.sum(F.size("words")).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n_col", F.dense_rank().over(W.partitionBy(*PAGE).orderBy("col_no")))
    span = lambda x0, y0, x1, y1: F.concat_ws(" ", F.lit("bbox"), x0, y0, x1, y1)
    of = lambda kind, n: F.concat(F.lit(f"id='{kind}_"), F.col("page_no").cast("string"), F.lit("_"), n.cast("string"), F.lit("'"))
    word = F.transform(
        "words",
        lambda w, i: F.concat(F.lit("<span class='ocrx_word' "), of("word", F.col("n_word") + i + 1), F.lit(" title='bbox "), F.array_join(w["bbox"], " "), F.lit("; x_wconf "), F.bround(F.coalesce(w["conf"], F.lit(0.0))).cast("int").cast("string"), F.lit("'>"), escape_html(F.coalesce(w["text"], F.lit(""))), F.lit("</span>")),
    )
    line = F.concat(F.lit("<span class='ocr_line' "), of("line", F.col("n_line")), F.lit(' title="'), span("x0", "y0", "x1", "y1"), F.lit("; x_conf "), F.coalesce(F.col("conf").cast("string"), F.lit("0")), F.lit('">'), F.array_join(word, " "), F.lit("</span>"))
    cols = at.withColumn("html", line).groupBy(*PAGE, "n_col").agg(F.array_sort(F.collect_list(F.struct("n_line", "html"))).alias("v"), F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    title = F.concat(F.lit(' title="'), span("a", "b", "c", "d"), F.lit('"'))
    block = F.concat(F.lit("<div class='ocr_carea' "), of("block", F.col("n_col")), title, F.lit("><p class='ocr_par' "), of("par", F.col("n_col")), F.lit(f" lang='{language}' dir='rtl'"), title, F.lit(">\n"), F.array_join(F.transform("v", lambda x: x["html"]), "\n"), F.lit("\n</p></div>"))
    whole = cols.select(*PAGE, F.struct("n_col", block.alias("html")).alias("x"), "c", "d").groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("v"), F.max("c").alias("w"), F.max("d").alias("h"))
    head = F.concat(F.lit("<div class='ocr_page' id='page_"), F.col("page_no").cast("string"), F.lit("' title=\"bbox 0 0 "), F.col("w"), F.lit(" "), F.col("h"), F.lit('">\n'))
    return whole.select(*PAGE, F.concat(head, F.array_join(F.transform("v", lambda x: x["html"]), "\n"), F.lit("\n</div>\n")).alias("html"))


def training_manifest(lines: DataFrame, seed: str, test: int, train: int, least_lines: int = 15, least_conf: float = 80.0) -> DataFrame:
    """book_id, page_no, part, pos: pages of enough well-read lines in an order drawn by hash, ``test`` for the test part
    of each book, then ``train`` for training. Quotas of a book are filled from its best hashes only."""
    good = lines.groupBy(*PAGE).agg(F.count("*").alias("n"), F.avg("conf").alias("conf")).filter((F.col("n") >= least_lines) & (F.col("conf") >= least_conf))
    drawn = good.select(*PAGE, F.md5(F.concat(F.lit(seed), "book_id", F.lit("/"), F.col("page_no").cast("string"))).alias("draw"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("book_id").orderBy("draw"))
    return drawn.withColumn("k", place).filter(F.col("k") <= test + train).select(*PAGE, F.when(F.col("k") <= test, "test").otherwise("train").alias("part"), F.col("k").alias("pos"))


def report(lines: DataFrame, quality: DataFrame, gaps: DataFrame, low: float = 0.8) -> DataFrame:
    """book_id, report: Markdown on each book's pages, lines, pages of low quality and gaps in the numbers."""
    a = lines.groupBy("book_id").agg(F.count_distinct("page_no").alias("pages"), F.count("*").alias("lines"))
    b = quality.groupBy("book_id").agg(F.count_if(F.col("quality") < low).alias("poor"))
    c = gaps.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda g: F.when(g["first"] == g["last"], g["first"].cast("string")).otherwise(F.concat_ws("-", g["first"], g["last"]))), ", ").alias("gaps"))
    at = a.join(b, "book_id", "left").join(c, "book_id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("# "), "book_id"), F.concat(F.lit("- pages: "), "pages"), F.concat(F.lit("- lines: "), "lines"), F.concat(F.lit("- pages of low quality: "), F.coalesce("poor", F.lit(0))), F.concat(F.lit("- missing numbers: "), F.coalesce("gaps", F.lit("none"))))
    return at.select("book_id", text.alias("report"))
