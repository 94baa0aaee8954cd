"""Page labels given by a model or a person: reading, validation, layers, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The roles of a line and the kinds of a page.
ROLES = ["header", "pagenum", "heading", "byline", "body", "quote", "epigraph", "verse", "note", "endnote", "reference", "caption", "table", "figure", "contents", "noise", "other"]
PAGE_TYPES = ["cover", "title", "imprint", "dedication", "epigraph", "contents", "part", "opening", "text", "endnotes", "bibliography", "index", "figure", "table", "ad", "blank", "other"]
ANSWER = "page STRUCT<type: STRING, pn: STRING, cols: INT>, lines ARRAY<STRUCT<i: INT, r: STRING, l: INT, n: INT, p: BOOLEAN, m: ARRAY<INT>, a: ARRAY<STRING>, t: STRING>>, missing ARRAY<STRUCT<r: STRING, l: INT, t: STRING, before: INT>>, toc ARRAY<STRUCT<t: STRING, a: STRING, pg: STRING, l: INT>>"
# Tokens of an answer about a page, fitted by its publisher: input is base + characters / per, output base + per line.
INPUT_BASE, INPUT_CHARS, OUTPUT_BASE, OUTPUT_LINE, BOOK_INPUT, BOOK_OUTPUT = 545, 2.74, 94, 16.9, 8000, 3000


def json_part(text: Column) -> Column:
    """The answer's text from its first brace on: models like to talk before it."""
    return F.regexp_extract(text, r"(?s)(\{.*)", 1)


def parsed(answers: DataFrame, text: str) -> DataFrame:
    """answers with ``a``, the parsed answer, null where it isn't JSON of the wanted shape."""
    ok = F.try_parse_json(json_part(F.col(text))).isNotNull()
    return answers.withColumn("a", F.when(ok, F.from_json(json_part(F.col(text)), ANSWER, {"mode": "PERMISSIVE"})))


def problems(answers: DataFrame, n_lines: str) -> DataFrame:
    """answers (with ``a`` of parsed()) and ``problems``, the complaints in a fixed order; empty where the answer is valid."""
    a, n = F.col("a"), F.col(n_lines)
    lines = F.coalesce(a["lines"], F.array())
    ids = F.transform(lines, lambda x: x["i"])
    known = F.filter(ids, lambda i: i.isNotNull() & (i >= 0) & (i < n))
    unknown = F.filter(ids, lambda i: i.isNull() | (i < 0) | (i >= n))
    wanted = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    lost = F.array_except(wanted, known)
    twice = F.array_distinct(F.filter(known, lambda i: F.size(F.filter(known, lambda j: j == i)) > 1))
    strange = F.filter(lines, lambda x: x["i"].isNotNull() & ~F.coalesce(x["r"].isin(ROLES), F.lit(False)))
    flat = F.filter(lines, lambda x: (x["r"] == "heading") & ~F.coalesce(x["l"].between(1, 3), F.lit(False)))
    text = lambda ids: F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")
    found = F.array(
        F.when(a.isNull() | a["lines"].isNull(), "not the expected JSON"),
        F.when(a.isNotNull() & a["page"].isNull(), "no page"),
        F.when(a["page"].isNotNull() & ~F.coalesce(a["page"]["type"].isin(PAGE_TYPES), F.lit(False)), "unknown page type"),
        F.when(a["lines"].isNotNull() & (F.size(unknown) > 0), F.concat(F.lit("unknown index: "), F.size(unknown).cast("string"))),
        F.when(a["lines"].isNotNull() & (F.size(twice) > 0), F.concat(F.lit("duplicate index: "), text(twice))),
        F.when(F.size(strange) > 0, F.concat(F.lit("unknown role: "), text(F.transform(strange, lambda x: x["i"])))),
        F.when(F.size(flat) > 0, F.concat(F.lit("heading level: "), text(F.transform(flat, lambda x: x["i"])))),
        F.when(a["lines"].isNotNull() & (F.size(lost) > 0), F.concat(F.lit("missing index: "), text(lost))),
    )
    return answers.withColumn("problems", F.filter(found, lambda p: p.isNotNull()))


def label_plan(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """book_id, todo, input_tokens, output_tokens: what labelling the pages without valid labels should take."""
    pages = lines.groupBy("book_id", "page_no").agg(F.sum(F.length("text") + 8).alias("chars"), F.count("*").alias("n"))
    todo = pages.join(labelled.select("book_id", "page_no").distinct(), ["book_id", "page_no"], "left_anti")
    per = todo.groupBy("book_id").agg(F.count("*").alias("todo"), F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    return per.select(
        "book_id", "todo", F.floor(BOOK_INPUT + INPUT_BASE * F.col("todo") + F.col("chars") / INPUT_CHARS).cast("bigint").alias("input_tokens"), F.floor(BOOK_OUTPUT + OUTPUT_BASE * F.col("todo") + OUTPUT_LINE * F.col("n")).cast("bigint").alias("output_tokens")
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, charged: Column) -> Column:
    """Charged cost where it is known, else by the prices of a million tokens; null where neither is."""
    return F.coalesce(charged, (tokens_in * price_in + tokens_out * price_out) / 1e6)


def to_retry(error: Column) -> Column:
    """Whether a page is asked again: its answer is missing or failed otherwise than by a block or a full stop."""
    return error.isNull() | ~error.rlike("^(blocked|finish)")
