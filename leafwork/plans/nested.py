"""Queries on nested records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.operators import joins, ordering
from leafwork.operators.nested import flat_table, review_boxes, review_fields, review_pages, schema_graph, shredded
from leafwork.plans.pages import ORDERED
from leafwork.session import cut, table


def p5_found(spark, folder):
    return review_fields(table(spark, folder, "review_files"))


def p5_tables(spark, folder):
    rows, _ = shredded(table(spark, folder, "review_files"), "review_id", "received_at", "review")
    return rows.select("record_id", "version", "tbl", "row_id", "parent_tbl", "parent_id", "via", "pos", "key", F.to_json("cols").alias("cols"))


def p5_schema(spark, folder):
    return schema_graph(table(spark, folder, "review_files"), "review")


def corrections_found(spark, folder):
    stored = review_boxes(table(spark, folder, "review_files"))
    rows = table(spark, folder, "ocr_rows").filter("trim(text) <> ''").groupBy("book_id", "page_no", "row_no").agg(F.first("bbox").alias("box"))
    return joins.matched_boxes(stored, rows.join(stored.select("review_id", "book_id", "page_no").distinct(), ["book_id", "page_no"]), ["review_id", "book_id", "page_no"])


def human_pages(spark, folder):
    """The pages on which a person set a field."""
    return review_fields(table(spark, folder, "review_files")).filter("place = 'pages'").select("review_id", "pdf").distinct()


def p5_history(spark, folder):
    """The flat table of history entries, linked to its file by review_id, of each file's latest valid delivery."""
    rows, _ = shredded(table(spark, folder, "review_files"), "review_id", "received_at", "review", ("history",))
    rows = cut(rows.filter("tbl = '' OR (tbl = 'history' AND parent_tbl = '')"))
    valid = rows.filter("tbl = ''").groupBy("record_id").agg(F.max("version").alias("version"))
    return flat_table(rows.join(valid, ["record_id", "version"], "left_semi"), "history", ["pdf"]).select(F.col("record_id").alias("review_id"), F.col("pos").alias("entry_no"), F.col("c_pdf").alias("pdf"))


def page_fields(spark, folder):
    return review_pages(table(spark, folder, "review_files"))


def _by_hand(spark, folder):
    """The number of the latest file (by its id) that sets one."""
    got = review_pages(table(spark, folder, "review_files")).filter("number IS NOT NULL")
    return got.groupBy("book_id", "page_no").agg(F.max_by("number", "review_id").alias("number"))


def page_order_by_hand(spark, folder):
    return ordering.page_order(table(spark, folder, "page_layouts"), table(spark, folder, "ocr_rows"), cut(_by_hand(spark, folder)))


QUERIES = {f.__name__: f for f in (page_fields, page_order_by_hand, p5_found, p5_tables, p5_schema, p5_history, human_pages, corrections_found)}

FIELDS = """WITH rv AS (SELECT review_id, review::JSON AS j, received_at FROM review_files WHERE review IS NOT NULL AND json_valid(review)), rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY received_at DESC NULLS LAST) AS rn FROM rv) WHERE rn = 1 AND json_type(j) = 'OBJECT'),
 pg AS (SELECT review_id, e.key AS key, e.value AS page FROM rf, json_each(j, '$.pages') e WHERE regexp_full_match(e.key, '\\p{Nd}+')),
 hs AS (SELECT review_id, e.id AS n, row_number() OVER (PARTITION BY review_id ORDER BY e.id) - 1 AS entry_no, e.value AS x FROM rf, json_each(j, '$.history') e),
 u AS (SELECT review_id, 'pages' AS place, -1 AS entry_no, try_cast(translate(key, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS INT) AS pdf, page FROM pg UNION ALL SELECT review_id, 'history', entry_no::INT, try_cast(x->>'$.pdf' AS INT), x->'$.before' FROM hs WHERE json_type(x->'$.before') = 'OBJECT'),
 n AS (SELECT review_id, place, entry_no, pdf, l.value AS line FROM u, json_each(page, '$.lines') l WHERE json_type(l.value) = 'OBJECT' AND pdf IS NOT NULL)
"""

FIELDS_OF_PAGES = FIELDS + """, hp AS (SELECT rf.review_id, try_cast(translate(pg.key, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS INT) AS page_no, page->'$.page' AS p, list(hv.value->>'$') AS h FROM pg JOIN rf USING (review_id), json_each(page, '$.h') hv WHERE json_type(page->'$.page') = 'OBJECT' AND json_type(hv.value) <> 'NULL' GROUP BY ALL),
 hd AS (SELECT *, translate(trim(p->>'$.pn', ' -–—.()[]'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS d FROM hp WHERE page_no IS NOT NULL),
 fields_ AS (SELECT review_id, book_id, page_no, CASE WHEN list_contains(h, 'type') THEN CASE WHEN p->>'$.type' IN ('figure', 'cover') THEN 'figure' WHEN p->>'$.type' = 'blank' THEN 'blank' END END AS kind, CASE WHEN list_contains(h, 'pn') AND regexp_full_match(d, '[0-9]{1,4}') THEN d::INT END AS number
  FROM hd JOIN (SELECT review_id, min(book_id) AS book_id FROM review_files WHERE book_id IS NOT NULL GROUP BY review_id) USING (review_id))"""
BY_HAND = FIELDS_OF_PAGES + ", hand AS (SELECT book_id, page_no, arg_max(number, review_id) AS number FROM fields_ WHERE number IS NOT NULL GROUP BY ALL)"
_ORDERED = (
    ORDERED.replace("chosen AS (", "chosen0 AS (", 1).replace(", ev AS (", ", chosen AS (SELECT book_id, page_no, number FROM hand SEMI JOIN p USING (book_id, page_no) UNION ALL SELECT * FROM chosen0 ANTI JOIN hand USING (book_id, page_no)), ev AS (", 1)
    .replace("ORDER BY read DESC", "ORDER BY EXISTS (SELECT 1 FROM hand h WHERE h.book_id = n.book_id AND h.page_no = n.page_no) DESC, read DESC", 1)
)

SQL = {
    "page_fields": FIELDS_OF_PAGES + " SELECT * FROM fields_",
    "page_order_by_hand": BY_HAND + ", " + _ORDERED + " SELECT book_id, page_no, number, sort_key, status FROM ordered",
    "p5_found": FIELDS + """ SELECT DISTINCT review_id, place, entry_no, pdf, try_cast(line->>'$.i' AS INT) AS line_i, h.value->>'$' AS field FROM n, json_each(line, '$.h') h WHERE json_type(h.value) <> 'NULL'""",
    "human_pages": FIELDS + """ SELECT DISTINCT review_id, pdf FROM n, json_each(line, '$.h') h WHERE json_type(h.value) <> 'NULL' AND place = 'pages'""",
    "p5_history": """WITH rv AS (SELECT review_id, review::JSON AS j, received_at FROM review_files WHERE review IS NOT NULL AND json_valid(review)), rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY received_at DESC NULLS LAST) AS rn FROM rv) WHERE rn = 1 AND json_type(j) = 'OBJECT') SELECT review_id, (row_number() OVER (PARTITION BY review_id ORDER BY id) - 1)::INT AS entry_no, x->>'$.pdf' AS pdf FROM (SELECT review_id, e.id AS id, e.value AS x FROM rf, json_each(j, '$.history') e) QUALIFY json_type(x) <> 'NULL'""",
}
