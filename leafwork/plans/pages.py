"""Queries on scanned pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.operators import columns, contents, corrections, issues, joins, labels, lines, markers, notes, ordering, sequences
from leafwork.operators.delivery import latest
from leafwork.session import cut, table
from leafwork.sinks import pages as sinks


def _lines(spark, folder):
    return lines.text_lines(table(spark, folder, "ocr_rows"))


def _layouts(spark, folder):
    return table(spark, folder, "page_layouts")


L = """l AS (SELECT line_id, book_id, page_no, row_no, col_no, text, conf, words, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1, bbox[4] - bbox[2] AS h
 FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at DESC NULLS LAST, text) AS rn FROM ocr_rows) WHERE rn = 1 AND trim(text) <> '')"""
NOISE = "(conf < 50 OR (length(trim(text)) <= 2 AND NOT regexp_matches(trim(text), '^[0-9۰-۹٠-٩]+$') AND conf < 90))"
GOOD = "(conf >= 85 AND length(text) >= 2)"
PLACED = L + """, m AS (SELECT book_id, coalesce(median(h) FILTER (conf >= 70), median(h)) AS h_med, max(y1) AS page_h, max(x1) AS page_w FROM l GROUP BY book_id),
 p AS (SELECT l.*, h_med, page_h, page_w, h / h_med AS h_book, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY book_id, page_no) AS n_lines,
  lag(y1) OVER w AS up, lead(y0) OVER w AS down FROM l JOIN m USING (book_id) WINDOW w AS (PARTITION BY book_id, page_no ORDER BY y0, row_no))"""
BLOCK = L + """, s AS (SELECT *, (x1 - x0) > 0.5 * max(x1 - x0) OVER (PARTITION BY book_id, page_no) AS wide, (y0 + y1 - lag(y0 + y1) OVER (PARTITION BY book_id, page_no ORDER BY y0, row_no)) / 2 AS step FROM l),
 b AS (SELECT book_id, page_no, quantile_cont(x1, 0.8) FILTER (wide) AS right_edge, quantile_cont(x0, 0.2) FILTER (wide) AS left_edge, median(h) FILTER (wide) AS lh FROM s GROUP BY ALL),
 t AS (SELECT book_id, page_no, median(step) AS pitch FROM s JOIN b USING (book_id, page_no) WHERE step > 0 AND step < 2.5 * lh GROUP BY ALL),
 block AS (SELECT b.*, coalesce(pitch, 1.3 * lh) AS pitch FROM b LEFT JOIN t USING (book_id, page_no))"""
INBLOCK = PLACED + """, o AS (SELECT *, length(text) >= 20 AND h_book BETWEEN 0.8 AND 1.25 AS ord FROM p),
 bb AS (SELECT book_id, coalesce(quantile_cont(x0, 0.5) FILTER (ord), median(x0)) AS bl, coalesce(quantile_cont(x1, 0.5) FILTER (ord), median(x1)) AS br FROM o GROUP BY book_id),
 pp AS (SELECT book_id, page_no, quantile_cont(x0, 0.5) FILTER (ord) AS pl, quantile_cont(x1, 0.5) FILTER (ord) AS pr, count(*) FILTER (ord) AS n FROM o GROUP BY ALL),
 y AS (SELECT o.*, CASE WHEN n >= 3 AND pr - pl >= 0.85 * (br - bl) THEN pl ELSE bl END AS cl, CASE WHEN n >= 3 AND pr - pl >= 0.85 * (br - bl) THEN pr ELSE br END AS cr FROM o JOIN pp USING (book_id, page_no) JOIN bb USING (book_id)),
 v AS (SELECT *, greatest(cr - cl, 1e-6) AS cw FROM y)"""
DOUBT = L + """, d AS (SELECT line_id, book_id, page_no, coalesce(list_min(list_filter(list_transform(words, lambda w: w.conf), lambda c: c IS NOT NULL)), conf) AS weakest FROM l),
 e AS (SELECT *, round(least(1.0, greatest(0.0, (97 - weakest) / 25)), 3) AS doubt FROM d)"""
CHOSEN = """p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY loaded_at DESC NULLS LAST, quality DESC NULLS LAST) AS rn FROM page_layouts) WHERE rn = 1),
 c AS (SELECT book_id, page_no, i - 1 AS k, number_candidates[i] AS c FROM p, range(1, 9) t(i) WHERE kind = 'text' AND i <= len(number_candidates) AND number_candidates[i] IS NOT NULL),
 s AS (SELECT book_id, page_no, c, sum(w) AS support FROM (SELECT a.book_id, a.page_no, a.c, b.page_no AS j, max(CASE WHEN b.k = 0 THEN 1.0 ELSE 0.5 END) AS w FROM (SELECT DISTINCT book_id, page_no, c FROM c) a JOIN c b
   ON a.book_id = b.book_id AND a.page_no <> b.page_no AND abs(a.page_no - b.page_no) <= 8 AND abs(a.c - b.c) = abs(a.page_no - b.page_no) GROUP BY ALL) GROUP BY ALL),
 f AS (SELECT book_id, page_no, c FROM (SELECT c.*, coalesce(support, 0) AS sup, row_number() OVER (PARTITION BY c.book_id, c.page_no ORDER BY coalesce(support, 0) + CASE WHEN k = 0 THEN 1 ELSE 0 END DESC, c.c DESC, coalesce(support, 0) DESC) AS rn FROM c LEFT JOIN s USING (book_id, page_no, c)) WHERE rn = 1 AND sup >= 1),
 g AS (SELECT * FROM f a WHERE EXISTS (SELECT 1 FROM f b WHERE a.book_id = b.book_id AND a.page_no <> b.page_no AND abs(a.page_no - b.page_no) <= 8 AND abs(a.c - b.c) = abs(a.page_no - b.page_no))),
 h AS (SELECT g.book_id, g.page_no, g.c, max(a.page_no) AS pa, min(b.page_no) AS pb FROM g LEFT JOIN g a ON a.book_id = g.book_id AND a.page_no BETWEEN g.page_no - 8 AND g.page_no - 1 LEFT JOIN g b ON b.book_id = g.book_id AND b.page_no BETWEEN g.page_no + 1 AND g.page_no + 8 GROUP BY ALL),
 x AS (SELECT h.*, a.c AS ca, b.c AS cb FROM h LEFT JOIN g a ON a.book_id = h.book_id AND a.page_no = pa LEFT JOIN g b ON b.book_id = h.book_id AND b.page_no = pb),
 chosen AS (SELECT book_id, page_no, c AS number FROM x WHERE NOT coalesce((cb - ca = pb - pa AND c <> ca + page_no - pa) OR (cb - ca = pa - pb AND c <> ca - page_no + pa), false))"""

NUMBERED = CHOSEN + """, ev AS (SELECT p.book_id, p.page_no, p.quality, c.number FROM p LEFT JOIN chosen c USING (book_id, page_no)),
 ab AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN page_no END IGNORE NULLS) OVER w1 AS pa, last_value(number IGNORE NULLS) OVER w1 AS na, first_value(CASE WHEN number IS NOT NULL THEN page_no END IGNORE NULLS) OVER w2 AS pb, first_value(number IGNORE NULLS) OVER w2 AS nb
  FROM ev WINDOW w1 AS (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ru AS (SELECT *, CASE WHEN nb - na = pb - pa THEN na + (page_no - pa) WHEN nb - na = pa - pb THEN na - (page_no - pa) END AS run FROM ab), gu AS (SELECT *, CASE WHEN number IS NULL THEN coalesce(run, na + (page_no - pa), nb - (pb - page_no)) END AS guess FROM ru),
 numbered AS (SELECT g.book_id, g.page_no, g.quality, g.number IS NOT NULL AS read, coalesce(g.number, CASE WHEN na IS NULL AND nb IS NULL THEN g.page_no END, CASE WHEN run IS NOT NULL OR NOT EXISTS (SELECT 1 FROM chosen c WHERE c.book_id = g.book_id AND c.number = g.guess) THEN guess END)::INT AS number FROM gu g)"""
ORDERED = NUMBERED + """, pw AS (SELECT book_id, page_no, list_distinct(flatten(list(list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{N}_\u200c]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)))) AS words FROM ocr_rows WHERE text IS NOT NULL GROUP BY ALL),
 rk AS (SELECT n.*, coalesce(words, []) AS words, CASE WHEN number IS NOT NULL THEN row_number() OVER (PARTITION BY n.book_id, number ORDER BY read DESC, coalesce(quality, 0) DESC, n.page_no) END AS rn FROM numbered n LEFT JOIN pw USING (book_id, page_no)),
 st AS (SELECT a.book_id, a.page_no, a.number, CASE WHEN a.number IS NULL THEN 'apart' WHEN a.rn = 1 THEN 'own' WHEN CASE WHEN len(a.words) < 8 OR len(o.words) < 8 THEN len(a.words) < 8 AND len(o.words) < 8 ELSE len(list_intersect(a.words, o.words)) >= 0.5 * len(list_distinct(list_concat(a.words, o.words))) END THEN 'second_scan' ELSE 'apart' END AS status
  FROM rk a LEFT JOIN rk o ON a.book_id = o.book_id AND a.number = o.number AND o.rn = 1),
 ordered AS (SELECT *, CASE WHEN status = 'apart' THEN coalesce(last_value(CASE WHEN status = 'own' THEN number END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE ELSE number::DOUBLE END AS sort_key FROM st)"""
MISSING = ORDERED + """, nx AS (SELECT book_id, number, lead(number) OVER (PARTITION BY book_id ORDER BY number) AS after FROM (SELECT DISTINCT book_id, number FROM numbered WHERE number IS NOT NULL)), gp AS (SELECT book_id, number + 1 AS first, after - 1 AS last FROM nx WHERE after > number + 1),
 gaps AS (SELECT * FROM gp WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.book_id = gp.book_id AND o.status = 'apart' AND floor(o.sort_key) BETWEEN gp.first - 1 AND gp.last))"""

REVERSED = f"""{NUMBERED}, d AS (SELECT a.book_id, a.page_no FROM numbered a JOIN numbered b ON a.book_id = b.book_id AND b.page_no = a.page_no + 1 AND b.number = a.number - 1), i AS (SELECT *, page_no - row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS g FROM d),
 r AS (SELECT book_id, min(page_no) AS first_page, max(page_no) + 1 AS last_page FROM i GROUP BY book_id, g) SELECT r.book_id, first_page, last_page, number AS first_number FROM r JOIN numbered n ON n.book_id = r.book_id AND n.page_no = first_page"""


def latest_rows(spark, folder):
    rows = latest(table(spark, folder, "ocr_rows"), ["line_id"], "loaded_at", F.col("text"))
    return rows.groupBy("book_id").agg(F.count("*").alias("n_rows"), F.count_if(F.trim("text") == "").alias("n_blank"), F.max("loaded_at").alias("last_at"))


def line_classes(spark, folder):
    c, t = F.col("conf"), F.col("text")
    return _lines(spark, folder).select("line_id", lines.is_noise(c, t).alias("noise"), lines.is_good(c, t).alias("good"), lines.is_latin(t).alias("latin"), lines.keeps_short(c, t).alias("kept"))


def page_quality(spark, folder):
    return lines.page_quality(_lines(spark, folder)).withColumn("quality", F.round("quality", 6))


def line_neighbours(spark, folder):
    got = lines.neighbours(lines.placed(_lines(spark, folder)), ["h_book", "conf"])
    return got.select("line_id", "rank", "rank_rev", "n_lines", *[F.round(c, 6).alias(c) for c in ("gap_up", "gap_down", "h_book", "prev_h_book", "next_h_book", "prev_conf", "next_conf")])


def small_runs(spark, folder):
    return lines.small_runs(lines.placed(_lines(spark, folder))).select("line_id", "small", F.round("tail_small", 6).alias("tail_small"), "small_run_up")


def size_rank(spark, folder):
    return lines.size_rank(_lines(spark, folder)).select("line_id", F.round("size_rank", 9).alias("size_rank"))


def repeat_share(spark, folder):
    return lines.repeat_share(_lines(spark, folder)).withColumn("share", F.round("share", 9))


def block_metrics(spark, folder):
    return lines.block_metrics(_lines(spark, folder)).select("book_id", "page_no", *[F.round(c, 4).alias(c) for c in ("right_edge", "left_edge", "lh", "pitch")])


def zones(spark, folder):
    return lines.zones(_lines(spark, folder)).select("book_id", *[F.round(c, 9).alias(c) for c in ("top_zone", "foot_zone")])


def style_counts(spark, folder):
    return lines.style_counts(lines.placed(_lines(spark, folder))).select("line_id", "size_class", "width_class", F.round("style_n", 9).alias("style_n"), F.round("first_n", 9).alias("first_n"))


def indent_mode(spark, folder):
    return lines.indent_mode(_lines(spark, folder))


def frequent_headers(spark, folder):
    return lines.frequent_headers(_lines(spark, folder))


def word_stats(spark, folder):
    return lines.word_stats(_lines(spark, folder))


def line_shape(spark, folder):
    s = X.shape(F.col("text"))
    return _lines(spark, folder).select("line_id", *[(F.round(c, 9) if n.endswith("share") else c).alias(n) for n, c in s.items()])


def stamp_texts(spark, folder):
    return lines.stamp_texts(_lines(spark, folder))


def number_lines(spark, folder):
    return _lines(spark, folder).select("line_id", X.to_int(F.col("text")).alias("number")).filter("number IS NOT NULL")


def script_shares(spark, folder):
    t = F.col("text")
    return _lines(spark, folder).select("line_id", F.round(X.latin_ratio(t), 9).alias("latin"), F.round(X.arabic_share(t), 9).alias("arabic"), X.base_direction(t).alias("direction"))


def same_row_pairs(spark, folder):
    got = table(spark, folder, "ocr_rows")
    one = latest(got, ["line_id"], "loaded_at", F.col("text")).filter("trim(text) <> ''")
    return joins.rows_of(one, ["book_id", "page_no"], "line_id", "bbox")


def page_numbers(spark, folder):
    return ordering.chosen_numbers(_layouts(spark, folder))


def number_support(spark, folder):
    c = ordering.candidates(_layouts(spark, folder))
    return ordering.support(c.select("book_id", "page_no", "c").distinct(), c)


def page_order(spark, folder):
    return ordering.page_order(_layouts(spark, folder), table(spark, folder, "ocr_rows"))


def missing_pages(spark, folder):
    return ordering.missing_numbers(_layouts(spark, folder), page_order(spark, folder))


def missing_read_numbers(spark, folder):
    """Gaps in the numbers read on the pages, before any is inferred."""
    return sequences.missing(ordering.chosen_numbers(_layouts(spark, folder)), ["book_id"], "number")


def reversed_runs(spark, folder):
    return ordering.reversed_runs(_layouts(spark, folder))


def reversed_books(spark, folder):
    """The same with every book's pages in the file the other way round."""
    return ordering.reversed_runs(_layouts(spark, folder).withColumn("page_no", 100_000 - F.col("page_no")))


def header_numbers(spark, folder):
    heads = ordering.pages(_layouts(spark, folder)).filter("header.text IS NOT NULL")
    return heads.select("book_id", "page_no", F.array_join(F.array_sort(X.page_number_candidates(F.col("header.text"))), ",").alias("candidates"))


def title_match(spark, folder):
    heads = ordering.pages(_layouts(spark, folder)).filter("header.text IS NOT NULL")
    a = heads.select("book_id", "page_no", X.trigrams(X.letters_only(F.col("header.text"))).alias("a"))
    b = table(spark, folder, "books").select("book_id", F.lit(1).alias("t"), X.trigrams(X.letters_only(F.coalesce("title", F.lit("")))).alias("b"))
    return joins.set_similarity(a, b, ["book_id"], "page_no", "a", "t", "b").withColumn("best", F.round("best", 9))


def line_doubts(spark, folder):
    return issues.line_doubts(_lines(spark, folder))


def weak_pages(spark, folder):
    return issues.weak_pages(_lines(spark, folder))


def book_summary(spark, folder):
    return issues.book_summary(_lines(spark, folder))


def open_issues(spark, folder):
    order = cut(page_order(spark, folder))
    return issues.issues(_lines(spark, folder), ordering.missing_numbers(_layouts(spark, folder), order), order.filter("status = 'second_scan'"))


def label_plan(spark, folder):
    done = _layouts(spark, folder).filter("kind IS NULL").select("book_id", "page_no")
    return labels.label_plan(_lines(spark, folder), done)


def page_text(spark, folder):
    return sinks.page_text(_lines(spark, folder))


def page_json(spark, folder):
    return sinks.page_json(_lines(spark, folder))


def hocr_pages(spark, folder):
    return sinks.hocr(_lines(spark, folder))


def training_manifest(spark, folder):
    return sinks.training_manifest(_lines(spark, folder), "7", 2, 5)


def book_report(spark, folder):
    lines_ = _lines(spark, folder)
    return sinks.report(lines_, lines.page_quality(lines_), missing_pages(spark, folder))


def page_notes(spark, folder):
    return notes.page_notes(_lines(spark, folder))


def reading_order(spark, folder):
    return columns.reading_order(_lines(spark, folder))


def canonical_rows(spark, folder):
    return _lines(spark, folder).select("line_id", X.canonical("text").alias("canonical"), X.relaxed("text").alias("relaxed"))


def hashed_grams(spark, folder):
    return _lines(spark, folder).select("line_id", X.hashed_grams(X.gram_key(F.col("text")), 256).alias("grams"), X.word_tokens(F.col("text")).alias("tokens"))


def mended_rows(spark, folder):
    return _lines(spark, folder).select("line_id", X.mend(F.col("text")).alias("mended")).join(_lines(spark, folder).select("line_id", "text"), "line_id").filter("mended <> text").select("line_id", "mended")


def bulk_groups(spark, folder):
    return corrections.bulk_groups(_lines(spark, folder))


def contents_pages(spark, folder):
    return contents.contents_pages(_lines(spark, folder))


def contents_lines(spark, folder):
    t = F.col("text")
    return _lines(spark, folder).select("line_id", contents.entry_number(t).alias("number"), contents.entry_title(t).alias("title")).filter("number IS NOT NULL")


def note_markers(spark, folder):
    return markers.markers(_lines(spark, folder)).select("book_id", "page_no", "row_no", "k", "number", "weak")


def note_links(spark, folder):
    at = _lines(spark, folder)
    return markers.linked(markers.markers(at), notes.page_notes(at))


def line_block(spark, folder):
    got = lines.in_block(lines.placed(_lines(spark, folder)))
    return got.select("line_id", *[F.round(c, 6).alias(c) for c in ("ind_r", "short_l", "c_col", "fill")])


def full_share(spark, folder):
    return lines.full_share(lines.in_block(lines.placed(_lines(spark, folder)))).withColumn("share", F.round("share", 9))


QUERIES = {f.__name__: f for f in (latest_rows, line_classes, page_quality, line_neighbours, small_runs, size_rank, repeat_share, block_metrics, zones, style_counts, indent_mode, frequent_headers, word_stats, line_shape, stamp_texts, number_lines, script_shares, same_row_pairs, page_numbers, number_support, page_order, missing_pages, missing_read_numbers, reversed_runs, reversed_books, header_numbers, title_match, line_doubts, weak_pages, book_summary, open_issues, label_plan, page_text, page_json, hocr_pages, training_manifest, book_report, page_notes, reading_order, canonical_rows, hashed_grams, mended_rows, bulk_groups, contents_pages, contents_lines, note_markers, note_links, line_block, full_share)}

_D = "0-9۰-۹٠-٩"
_N = "length(regexp_replace(text, '\\s', '', 'g'))"
SQL = {
    "latest_rows": "SELECT book_id, count(*) AS n_rows, count(*) FILTER (trim(text) = '') AS n_blank, max(loaded_at) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at DESC NULLS LAST, text) AS rn FROM ocr_rows) WHERE rn = 1 GROUP BY book_id",
    "line_classes": f"WITH {L} SELECT line_id, {NOISE} AS noise, {GOOD} AS good, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')) AS latin, (length(text) > 4 OR conf >= 80 OR regexp_matches(trim(text), '^[{_D}]+$')) AS kept FROM l",
    "page_quality": f"WITH {L} SELECT book_id, page_no, count(*) AS n_lines, count(*) FILTER ({GOOD} AND NOT {NOISE}) AS n_good, round(coalesce(sum(conf) FILTER ({GOOD} AND NOT {NOISE}), 0) / count(*) / 100 * least(1.0, count(*) FILTER ({GOOD} AND NOT {NOISE}) / 10), 6) AS quality FROM l GROUP BY ALL",
    "line_neighbours": f"""WITH {PLACED}, q AS (SELECT *, greatest(-60.0, least(60.0, coalesce((y0 - up) / h_med, y0 / h_med))) AS gap_up, greatest(-60.0, least(60.0, (coalesce(down, page_h) - y1) / h_med)) AS gap_down FROM p)
 SELECT line_id, rank, n_lines - 1 - rank AS rank_rev, n_lines, round(gap_up, 6) AS gap_up, round(gap_down, 6) AS gap_down, round(h_book, 6) AS h_book, round(coalesce(lag(h_book) OVER w, -1), 6) AS prev_h_book, round(coalesce(lead(h_book) OVER w, -1), 6) AS next_h_book, round(coalesce(lag(conf) OVER w, -1), 6) AS prev_conf, round(coalesce(lead(conf) OVER w, -1), 6) AS next_conf FROM q WINDOW w AS (PARTITION BY book_id, page_no ORDER BY rank)""",
    "small_runs": f"""WITH {PLACED}, q AS (SELECT *, (h_book < 0.9)::INT AS small FROM p)
 SELECT line_id, small, round(avg(small) OVER (PARTITION BY book_id, page_no ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS tail_small, rank - 1 - coalesce(max(CASE WHEN small = 0 THEN rank END) OVER (PARTITION BY book_id, page_no ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS small_run_up FROM q""",
    "size_rank": f"WITH {L} SELECT line_id, round(cume_dist() OVER (PARTITION BY book_id ORDER BY h), 9) AS size_rank FROM l",
    "repeat_share": f"""WITH {L}, k AS (SELECT book_id, page_no, trim(regexp_replace(regexp_replace(translate(text, 'يك', 'یک'), '[{_D}]', '', 'g'), '\\s+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y0, row_no) AS n FROM l)
 SELECT book_id, key, n_pages, round(n_pages / pages, 9) AS share FROM (SELECT book_id, key, count(DISTINCT page_no) AS n_pages FROM k WHERE n <= 2 AND length(key) >= 3 GROUP BY ALL) JOIN (SELECT book_id, count(DISTINCT page_no) AS pages FROM l GROUP BY ALL) USING (book_id)""",
    "block_metrics": f"WITH {BLOCK} SELECT book_id, page_no, round(right_edge, 4) AS right_edge, round(left_edge, 4) AS left_edge, round(lh, 4) AS lh, round(pitch, 4) AS pitch FROM block",
    "zones": f"""WITH {L}, s AS (SELECT book_id, max(y1) AS page_h FROM l GROUP BY book_id), z AS (SELECT book_id, page_no, min(y0) AS a, max(y1) AS b FROM l WHERE NOT coalesce({NOISE}, true) GROUP BY ALL HAVING count(*) >= 8)
 SELECT s.book_id, round(coalesce(quantile_cont(a / page_h, 0.25), 0.06) + 0.04::DOUBLE, 9) AS top_zone, round(coalesce(quantile_cont(b / page_h, 0.75), 0.92) - 0.04::DOUBLE, 9) AS foot_zone FROM s LEFT JOIN z USING (book_id) GROUP BY s.book_id""",
    "style_counts": f"""WITH {PLACED}, q AS (SELECT line_id, book_id, round_even(h_book * 10, 0)::INT AS size_class, ((x1 - x0) // 200)::INT AS width_class, regexp_replace(regexp_split_to_array(trim(text), '\\s+')[1], '[^\\p{{L}}]', '', 'g') AS first_word FROM p)
 SELECT line_id, size_class, width_class, round(ln(1 + count(*) OVER (PARTITION BY book_id, size_class, width_class)), 9) AS style_n, round(ln(1 + count(*) OVER (PARTITION BY book_id, first_word)), 9) AS first_n FROM q""",
    "frequent_headers": f"""WITH {L}, t AS (SELECT book_id, page_no, regexp_replace(text, '[^\\p{{L}}]|[A-Za-z]', '', 'g') AS key, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y0, row_no) AS rn FROM l) SELECT book_id, key, count(*) AS n FROM t WHERE rn = 1 AND length(key) >= 4 GROUP BY ALL HAVING count(*) >= 4""",
    "word_stats": f"""WITH {L}, w AS (SELECT line_id, words, list_filter(list_transform(words, lambda w: w.conf), lambda c: c IS NOT NULL) AS c FROM l) SELECT line_id, coalesce(len(words), 0)::INT AS n_words, list_min(c) AS weakest, round_even(list_sum(c) / nullif(len(c), 0), 1) AS mean_conf FROM w""",
    "line_shape": f"""WITH {L}, s AS (SELECT line_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM l) SELECT line_id, length(text)::INT AS n_chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INT AS n_words,
 round(coalesce(length(regexp_replace(text, '[^{_D}]', '', 'g')) / nullif(length(replace(text, ' ', '')), 0), 0), 9) AS digit_share, round(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(replace(text, ' ', '')), 0), 0), 9) AS latin_share,
 regexp_matches(text, '^[ ()\\[\\]{{}}«»"'']*[{_D}]')::INT AS starts_digit, regexp_matches(text, '^[ (\\[«"'']*[0-9۰-۹]{{1,3}} *[.\\-–)،:]')::INT AS starts_num_mark, regexp_matches(text, '[.،؛:!؟»"]$')::INT AS ends_punct,
 regexp_matches(text, '^[ .…\\-–—()]*[{_D}][{_D} .…\\-–—()]*$')::INT AS is_number_only, regexp_matches(text, '^[*٭]')::INT AS star_start, regexp_matches(translate(text, 'يك', 'یک'), '(^|[^\\p{{L}}\\p{{N}}_‌])({"|".join(X.LABEL_WORDS)})($|[^\\p{{L}}\\p{{N}}_‌])')::INT AS has_label_word, round(coalesce(length(regexp_replace(text, '[^()\\[\\]{{}}]', '', 'g')) / nullif(length(replace(text, ' ', '')), 0), 0), 9) AS bracket_share,
 regexp_matches(text, '^[«"“]')::INT AS quote_start, regexp_matches(text, '[»"”]$')::INT AS quote_end, contains(text, ':')::INT AS colon_in, regexp_matches(text, '[.؟?!]$')::INT AS ends_stop FROM s""",
    "stamp_texts": f"""WITH {L} SELECT book_id, key, n_pages FROM (SELECT book_id, key, count(DISTINCT page_no) AS n_pages FROM (SELECT book_id, page_no, lower(regexp_replace(text, '\\s', '', 'g')) AS key FROM l) WHERE length(key) >= 3 GROUP BY ALL) JOIN (SELECT book_id, count(DISTINCT page_no) AS pages FROM l GROUP BY ALL) USING (book_id) WHERE n_pages >= 3 AND n_pages >= 0.3 * pages""",
    "number_lines": f"WITH {L} SELECT line_id, try_cast(translate(trim(text), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS BIGINT) AS number FROM l WHERE regexp_matches(trim(text), '^[{_D}]+$') AND number IS NOT NULL",
    "script_shares": f"""WITH {L}, c AS (SELECT line_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')) AS b, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n, regexp_extract(text, '[A-Za-zÀ-ɏͰ-ϿЀ-ӿ֐-ۿݐ-ݿﭐ-﷿ﹰ-﻿]') AS f FROM l)
 SELECT line_id, round(coalesce(a / nullif(a + b, 0), 0), 9) AS latin, round(coalesce(b / nullif(n, 0), 0), 9) AS arabic, CASE WHEN regexp_matches(f, '[֐-ۿݐ-ݿﭐ-﷿ﹰ-﻿]') THEN 'R' ELSE 'L' END AS direction FROM c""",
    "same_row_pairs": f"WITH {L} SELECT a.book_id, a.page_no, a.line_id AS line_a, b.line_id AS line_b FROM l a JOIN l b ON a.book_id = b.book_id AND a.page_no = b.page_no AND a.line_id < b.line_id WHERE greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0.5 * least(a.h, b.h)",
    "page_numbers": f"WITH {CHOSEN} SELECT book_id, page_no, number FROM chosen",
    "number_support": f"WITH {CHOSEN} SELECT book_id, page_no, c, support FROM s",
    "page_order": f"WITH {ORDERED} SELECT book_id, page_no, number, sort_key, status FROM ordered",
    "missing_pages": f"WITH {MISSING} SELECT book_id, first::BIGINT AS first, last::BIGINT AS last FROM gaps",
    "header_numbers": f"""WITH y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY loaded_at DESC NULLS LAST, quality DESC NULLS LAST) AS rn FROM page_layouts) WHERE rn = 1 AND header.text IS NOT NULL),
 r AS (SELECT book_id, page_no, list_filter([translate(regexp_extract(header.text, '^[ \\-–—.:،؛BGOoا]*([{_D}]+)', 1), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), translate(regexp_extract(header.text, '([{_D}]+)[ \\-–—.:،؛BGOoا]*$', 1), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')], lambda x: length(x) BETWEEN 1 AND 5) AS r FROM y),
 n AS (SELECT book_id, page_no, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(r, lambda x: [x, substring(x, 2), left(x, length(x) - 1)])), lambda x: try_cast(x AS INT)), lambda x: x > 0))) AS n FROM r) SELECT book_id, page_no, array_to_string(n, ',') AS candidates FROM n""",
    "contents_lines": f"""WITH {L}, e AS (SELECT line_id, text, trim(regexp_extract(text, '[.…\\s\\-–|]+([{_D}][{_D}.]*)\\s*$', 1)) AS x FROM l), n AS (SELECT *, CASE WHEN length(x) BETWEEN 1 AND 5 THEN try_cast(translate(replace(x, '.', '0'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS INT) END AS number FROM e)
 SELECT line_id, number, trim(regexp_replace(regexp_replace(regexp_replace(text, '[.…\\s\\-–|]+[{_D}][{_D}.]*\\s*$', ''), '(?:\\s*[.…·]){{2,}}', ' ', 'g'), '^[\\s.…:|]+|[\\s.…:|]+$', '', 'g')) AS title FROM n WHERE number IS NOT NULL""",
    "missing_read_numbers": f"WITH {CHOSEN}, nx AS (SELECT book_id, number, lead(number) OVER (PARTITION BY book_id ORDER BY number) AS after FROM (SELECT DISTINCT book_id, number FROM chosen)) SELECT book_id, (number + 1)::BIGINT AS first, (after - 1)::BIGINT AS last FROM nx WHERE after > number + 1",
    "reversed_runs": f"WITH {REVERSED}",
    "reversed_books": "WITH " + REVERSED.replace("FROM page_layouts", "FROM (SELECT * REPLACE (100000 - page_no AS page_no) FROM page_layouts)"),
    "open_issues": f"""WITH {DOUBT}, g AS (SELECT book_id, page_no, count(*) AS n, count(*) FILTER (doubt >= 0.3) AS w FROM e GROUP BY ALL), m AS (WITH {MISSING} SELECT 'gap:' || book_id || ':' || first AS id, 'gap' AS kind, book_id, NULL::INT AS page_no, NULL::BIGINT AS "row", 0.7::DOUBLE AS doubt FROM gaps UNION ALL SELECT 'left:' || book_id || ':' || page_no, 'left', book_id, page_no, NULL, 0.85::DOUBLE FROM ordered WHERE status = 'second_scan')
 SELECT 'text:' || line_id AS id, 'text' AS kind, book_id, page_no, line_id AS "row", doubt FROM e WHERE doubt >= 0.3 UNION ALL SELECT 'page:' || book_id || ':' || page_no, 'page', book_id, page_no, NULL, round(least(0.95, 0.4 + w / n / 2), 3) FROM g WHERE n >= 5 AND w >= 0.3 * n UNION ALL SELECT * FROM m""",
    "book_report": f"""WITH {L}, a AS (SELECT book_id, count(DISTINCT page_no) AS pages, count(*) AS n FROM l GROUP BY book_id), q AS (SELECT book_id, page_no, coalesce(sum(conf) FILTER ({GOOD} AND NOT {NOISE}), 0) / count(*) / 100 * least(1.0, count(*) FILTER ({GOOD} AND NOT {NOISE}) / 10) AS quality FROM l GROUP BY ALL), b AS (SELECT book_id, count(*) FILTER (quality < 0.8) AS poor FROM q GROUP BY book_id),
 c AS (WITH {MISSING} SELECT book_id, string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ', ' ORDER BY first) AS g FROM gaps GROUP BY book_id)
 SELECT a.book_id, '# ' || a.book_id || chr(10) || '- pages: ' || pages || chr(10) || '- lines: ' || n || chr(10) || '- pages of low quality: ' || coalesce(poor, 0) || chr(10) || '- missing numbers: ' || coalesce(g, 'none') AS report FROM a LEFT JOIN b USING (book_id) LEFT JOIN c USING (book_id)""",
    "line_doubts": f"WITH {DOUBT} SELECT line_id, book_id, page_no, weakest, doubt, CASE WHEN doubt >= 0.5 THEN 'unsure' WHEN doubt >= 0.2 THEN 'check' WHEN doubt IS NOT NULL THEN 'sure' END AS level FROM e",
    "weak_pages": f"WITH {DOUBT}, g AS (SELECT book_id, page_no, count(*) AS n, count(*) FILTER (doubt >= 0.3) AS n_weak FROM e GROUP BY ALL) SELECT book_id, page_no, n, n_weak, round(least(0.95, 0.4 + n_weak / n / 2), 3) AS doubt FROM g WHERE n >= 5 AND n_weak >= 0.3 * n",
    "book_summary": f"WITH {DOUBT} SELECT book_id, count(DISTINCT page_no) AS n_pages, count(*) AS n_lines, count(*) FILTER (doubt >= 0.5) AS unsure, count(*) FILTER (doubt >= 0.2 AND doubt < 0.5) AS check, max(doubt) AS worst FROM e GROUP BY book_id",
    "label_plan": f"""WITH {L}, p AS (SELECT book_id, page_no, sum(length(text) + 8) AS chars, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM page_layouts y WHERE y.kind IS NULL AND y.book_id = p.book_id AND y.page_no = p.page_no))
 SELECT book_id, count(*) AS todo, floor(8000 + 545 * count(*) + sum(chars)::DOUBLE / 2.74::DOUBLE)::BIGINT AS input_tokens, floor(3000 + 94 * count(*) + 16.9::DOUBLE * sum(n)::DOUBLE)::BIGINT AS output_tokens FROM t GROUP BY book_id""",
    "page_text": f"WITH {L} SELECT book_id, page_no, string_agg(text, chr(10) ORDER BY col_no, y0, row_no) || chr(10) AS text FROM l GROUP BY ALL",
    "training_manifest": f"""WITH {L}, g AS (SELECT book_id, page_no FROM l GROUP BY ALL HAVING count(*) >= 15 AND avg(conf) >= 80), d AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY md5('7' || book_id || '/' || page_no)) AS k FROM g) SELECT book_id, page_no, CASE WHEN k <= 2 THEN 'test' ELSE 'train' END AS part, k::INT AS pos FROM d WHERE k <= 7""",
    "line_block": f"WITH {INBLOCK} SELECT line_id, round((cr - x1) / cw, 6) AS ind_r, round((x0 - cl) / cw, 6) AS short_l, round(((x0 + x1) / 2 - (cl + cr) / 2) / cw, 6) AS c_col, round((x1 - x0) / cw, 6) AS fill FROM v",
    "full_share": f"WITH {INBLOCK} SELECT book_id, page_no, count(*) AS n, round(avg(((x1 - x0) / cw >= 0.9)::INT), 9) AS share FROM v GROUP BY ALL",
    "bulk_groups": f"WITH {L} SELECT book_id, key, count(*) AS n_lines, count(DISTINCT page_no) AS n_pages FROM (SELECT book_id, page_no, regexp_replace(text, '[{_D}]|\\s', '', 'g') AS key FROM l) WHERE key <> '' GROUP BY ALL HAVING count(*) >= 2",
    "title_match": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY loaded_at DESC NULLS LAST, quality DESC NULLS LAST) AS rn FROM page_layouts) WHERE rn = 1 AND header.text IS NOT NULL),
 a AS (SELECT book_id, page_no, regexp_replace(header.text, '[^\\p{L}]', '', 'g') AS s FROM p), b AS (SELECT book_id, regexp_replace(coalesce(title, ''), '[^\\p{L}]', '', 'g') AS s FROM books),
 g AS (SELECT book_id, page_no, CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) WHEN s <> '' THEN [s] ELSE [] END AS t FROM a), h AS (SELECT book_id, CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) WHEN s <> '' THEN [s] ELSE [] END AS t FROM b)
 SELECT g.book_id, page_no, round(coalesce(max(len(list_intersect(g.t, h.t)) / nullif(len(g.t) + len(h.t) - len(list_intersect(g.t, h.t)), 0)), 0), 9) AS best FROM g LEFT JOIN h USING (book_id) GROUP BY ALL""",
}
