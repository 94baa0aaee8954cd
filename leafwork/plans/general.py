"""Queries of the general operators (sequences, joins, sets, models) over the tables of a data folder, with their SQL.
The order, event and document tables stand in for page data where it has no such shape; the operators are the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.models.forest import Forest, score
from leafwork.operators import joins, lines, sequences
from leafwork.operators.delivery import latest
from leafwork.session import table
from leafwork.streaming import progress


def number_runs(spark, folder):
    return sequences.runs(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber")


def number_gaps(spark, folder):
    return sequences.missing(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber")


def order_guard(spark, folder):
    at = sequences.running_max(table(spark, folder, "events"), ["user_id"], "event_id", "value", "before")
    return at.filter("value < before").select("event_id", "user_id", "value", "before")


def asof_signup(spark, folder):
    e = table(spark, folder, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return sequences.last_known(e, ["user_id"], "event_id", "mark", "signup").select("event_id", "user_id", "signup")


def next_signup(spark, folder):
    e = table(spark, folder, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return sequences.last_known(e, ["user_id"], "event_id", "mark", "signup", back=True, strictly=True).select("event_id", "user_id", "signup")


def running_total(spark, folder):
    e = table(spark, folder, "events").withColumn("cents", F.bround(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint"))
    return sequences.running_sum(e, ["event_type"], "event_id", "cents", "total").select("event_id", "event_type", "total")


def nearest_purchase(spark, folder):
    e = table(spark, folder, "events")
    other = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("other"), F.col("user_id").alias("buyer"), F.lit(1).alias("k"))
    left = e.select("event_id", F.lit(1).alias("k"))
    return joins.nearest(left.withColumn("place", F.col("event_id")), other, ["k"], "event_id", "place", "other", 2, "buyer").select("event_id", "buyer")


def sizes_in_capacity(spark, folder):
    d = table(spark, folder, "documents").filter("n_chars IS NOT NULL").select("doc_id", "n_chars", F.lit(1).alias("k"))
    p = table(spark, folder, "pack_sizes").select("pack_id", (F.col("capacity") / 2).cast("bigint").alias("low"), F.col("capacity").cast("bigint").alias("high"), F.lit(1).alias("k"))
    return joins.between(d, p, ["k"], "n_chars", "low", "high", 512).groupBy("pack_id").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


def title_recall(spark, folder):
    d = table(spark, folder, "documents").filter("title IS NOT NULL AND text IS NOT NULL")
    words = lambda c: F.explode(F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
    got = joins.multiset_recall(d.select("doc_id", words("title").alias("w")), d.select("doc_id", words("text").alias("w")), ["doc_id"], "w")
    return got.withColumn("recall", F.round("recall", 9))


def without_tags(spark, folder):
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", X.strip_tags(F.col("text")).alias("plain")).filter("plain <> ''")


def upper_median(spark, folder):
    at = table(spark, folder, "lineitem")
    return at.groupBy("l_suppkey").agg(F.median("l_quantity").alias("true_median")).join(lines.middle_of(at, ["l_suppkey"], "l_quantity", "upper"), "l_suppkey", "left")


def flat_correlation(spark, folder):
    return lines.correlation(table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("similarity", F.round("similarity", 6))


def unlisted_books(spark, folder):
    pages = table(spark, folder, "page_layouts").select("book_id")
    return joins.unmatched(table(spark, folder, "books").select("book_id"), pages, ["book_id"])


def layered_books(spark, folder):
    """Book data by layers: the books table over the documents' commonest language of the source over a default."""
    b = table(spark, folder, "books").select("book_id", "lang", "source")
    s = table(spark, folder, "sites").select("source", F.col("main_lang").alias("lang"))
    site = b.select("book_id", "source").join(s, "source", "left").select("book_id", "lang")
    rest = b.select("book_id", F.lit("und").alias("lang"))
    return joins.layered(b.select("book_id", "lang"), site, rest, keys=["book_id"], fields=["lang"])


def stage_state(spark, folder):
    return progress.stage_state(table(spark, folder, "job_progress"))


def unfinished_stages(spark, folder):
    return progress.unfinished(table(spark, folder, "job_progress"))


TREE = Forest(
    feature=np.array([[0, 1, -1, -1, -1]]), threshold=np.array([[25.0, 0.05, 0, 0, 0]]), left=np.array([[1, 3, 0, 0, 0]]), right=np.array([[2, 4, 0, 0, 0]]), missing_left=np.array([[0, 1, 0, 0, 0]]),
    value=np.array([[0.0, 0.0, 2.0, -2.0, 0.5]]), baseline=np.array([0.5]),
)


def tree_score(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", score(TREE, F.col("l_quantity"), F.col("l_discount"), raw=True)[0].alias("raw"))


def latest_layouts(spark, folder):
    one = latest(table(spark, folder, "page_layouts"), ["book_id", "page_no"], "loaded_at", F.col("quality").desc_nulls_last())
    return one.groupBy("book_id").agg(F.count("*").alias("n_pages"), F.sum("body_rows").alias("body_rows"), F.max("loaded_at").alias("last_at"))


QUERIES = {f.__name__: f for f in (number_runs, number_gaps, order_guard, asof_signup, next_signup, running_total, nearest_purchase, sizes_in_capacity, title_recall, without_tags, upper_median, flat_correlation, unlisted_books, layered_books, stage_state, unfinished_stages, tree_score, latest_layouts)}

_STATE = """e AS (SELECT DISTINCT job_id, stage, done, total, sent_at FROM job_progress WHERE stage IS NOT NULL),
 a AS (SELECT job_id, stage, max(sent_at) AS sent_at, count(*) AS n_events FROM e GROUP BY ALL),
 d AS (SELECT job_id, stage, done FROM (SELECT *, row_number() OVER (PARTITION BY job_id, stage ORDER BY sent_at DESC NULLS LAST, done DESC) AS rn FROM e WHERE done IS NOT NULL) WHERE rn = 1),
 t AS (SELECT job_id, stage, total FROM (SELECT *, row_number() OVER (PARTITION BY job_id, stage ORDER BY sent_at DESC NULLS LAST, total DESC) AS rn FROM e WHERE total IS NOT NULL) WHERE rn = 1),
 s AS (SELECT a.job_id, a.stage, d.done, t.total, a.sent_at, a.n_events FROM a LEFT JOIN d ON a.job_id IS NOT DISTINCT FROM d.job_id AND a.stage = d.stage LEFT JOIN t ON a.job_id IS NOT DISTINCT FROM t.job_id AND a.stage = t.stage)"""
SQL = {
    "number_runs": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM d) SELECT l_orderkey, min(n)::BIGINT AS first, max(n)::BIGINT AS last FROM g GROUP BY l_orderkey, i",
    "number_gaps": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS m FROM d) SELECT l_orderkey, (n + 1)::BIGINT AS first, (m - 1)::BIGINT AS last FROM g WHERE m - n > 1",
    "order_guard": "SELECT * FROM (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE value < before",
    "asof_signup": "SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS signup FROM events",
    "next_signup": "SELECT event_id, user_id, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS signup FROM events",
    "running_total": "SELECT event_id, event_type, (sum(round_even(coalesce(value, 0) * 100, 0)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id))::BIGINT AS total FROM events",
    "nearest_purchase": "WITH c AS (SELECT a.event_id, b.user_id AS buyer, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.event_id - b.event_id), b.event_id, b.user_id) AS rn FROM events a JOIN events b ON b.event_type = 'purchase' AND b.event_id BETWEEN a.event_id - 2 AND a.event_id + 2) SELECT e.event_id, c.buyer FROM events e LEFT JOIN c ON c.event_id = e.event_id AND rn = 1",
    "sizes_in_capacity": "SELECT pack_id, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents JOIN pack_sizes ON n_chars BETWEEN capacity // 2 AND capacity GROUP BY pack_id",
    "title_recall": """WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS a, list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
 x AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(a) AS w FROM d) GROUP BY ALL), y AS (SELECT doc_id, w, count(*) AS m FROM (SELECT doc_id, unnest(b) AS w FROM d) GROUP BY ALL)
 SELECT doc_id, sum(n)::BIGINT AS n, sum(least(n, coalesce(m, 0)))::BIGINT AS found, round(sum(least(n, coalesce(m, 0))) / sum(n), 9) AS recall FROM x LEFT JOIN y USING (doc_id, w) GROUP BY doc_id""",
    "without_tags": "SELECT doc_id, plain FROM (SELECT doc_id, regexp_replace(text, '<[^<>]*>', '', 'g') AS plain FROM documents WHERE text IS NOT NULL) WHERE plain <> ''",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper, median(l_quantity) AS true_median FROM lineitem GROUP BY l_suppkey",
    "flat_correlation": "SELECT l_suppkey, round(CASE WHEN stddev_pop(l_quantity) * stddev_pop(l_extendedprice) = 0 THEN 0 ELSE covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)) END, 6) AS similarity FROM lineitem GROUP BY l_suppkey",
    "unlisted_books": "SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM page_layouts WHERE book_id IS NOT NULL)",
    "layered_books": "SELECT b.book_id, coalesce(b.lang, s.main_lang, 'und') AS lang FROM books b LEFT JOIN sites s USING (source)",
    "stage_state": f"WITH {_STATE} SELECT * FROM s",
    "unfinished_stages": f"WITH {_STATE} SELECT job_id, stage, done, total FROM s WHERE total IS NULL OR done IS NULL OR done < total",
    "tree_score": "SELECT l_orderkey, l_linenumber, l_partkey, 0.5::DOUBLE + CASE WHEN l_quantity IS NULL OR l_quantity > 25 THEN 2.0 WHEN l_discount IS NULL OR l_discount <= 0.05 THEN -2.0 ELSE 0.5 END::DOUBLE AS raw FROM lineitem",
    "latest_layouts": "SELECT book_id, count(*) AS n_pages, sum(body_rows)::BIGINT AS body_rows, max(loaded_at) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY loaded_at DESC NULLS LAST, quality DESC NULLS LAST) AS rn FROM page_layouts) WHERE rn = 1 GROUP BY book_id",
}
