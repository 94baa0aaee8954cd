"""Queries on the layout of pages, detection, jobs and decisions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.models.forest import TextModel, text_probabilities
from leafwork.operators import decisions, detection, issues, jobs, joins, lines, markers, notes, ordering, sequences
from leafwork.plans.pages import BLOCK, DOUBT, GOOD, L, NOISE, PLACED
from leafwork.session import table


def _lines(spark, folder):
    return lines.text_lines(table(spark, folder, "ocr_rows"))


def _placed(spark, folder):
    return lines.placed(_lines(spark, folder))


def line_places(spark, folder):
    return lines.places(_placed(spark, folder)).select("line_id", *[F.round(c, 6).alias(c) for c in ("h_page", "first_y", "y_vs_book_top", "page_pos")])


def line_neighbours_far(spark, folder):
    """Neighbours two lines away, and the gaps of the nearest."""
    from pyspark.sql import Window as W

    w = W.partitionBy("book_id", "page_no").orderBy("rank")
    at = _placed(spark, folder)
    far = {"prev2_h_book": F.lag("h_book", 2).over(w), "next2_h_book": F.lead("h_book", 2).over(w), "prev_gap_up": F.lag("gap_up").over(w), "next_gap_down": F.lead("gap_down").over(w)}
    return at.select("line_id", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(n) for n, c in far.items()])


def book_tops(spark, folder):
    return lines.book_tops(_lines(spark, folder)).withColumn("book_top", F.round("book_top", 9))


def page_tests(spark, folder):
    return lines.page_tests(_lines(spark, folder)).withColumn("full", F.round("full", 9))


def readable_letters(spark, folder):
    return lines.readable_letters(_lines(spark, folder))


def figure_turns(spark, folder):
    """The pages after stand in for a page read at a quarter and three quarters of a turn."""
    from pyspark.sql import Window as W

    w = W.partitionBy("book_id").orderBy("page_no")
    at = lines.readable_letters(_lines(spark, folder)).withColumn("left", F.coalesce(F.lead("letters").over(w), F.lit(0))).withColumn("right", F.coalesce(F.lead("letters", 2).over(w), F.lit(0)))
    return at.select("book_id", "page_no", lines.turn(F.col("letters"), F.col("left"), F.col("right")).alias("turn"))


def stamp_lines(spark, folder):
    return lines.stamp_lines(_placed(spark, folder))


def centred_lines(spark, folder):
    return lines.centred(_placed(spark, folder))


def sure_lines(spark, folder):
    return lines.sure_lines(_lines(spark, folder))


def line_shape_more(spark, folder):
    return _lines(spark, folder).select("line_id", *[(F.round(c, 9) if n.endswith("share") else c).alias(n) for n, c in X.shape_more(F.col("text")).items()])


def box_kinds(spark, folder):
    return detection.box_kinds(_lines(spark, folder))


def small_text(spark, folder):
    return detection.small_text(_lines(spark, folder))


def detection_scales(spark, folder):
    at = _lines(spark, folder).groupBy("book_id").agg(F.max("x1").alias("width"))
    return at.select("book_id", "width", F.round(detection.scale(F.col("width")), 9).alias("factor"), F.bround(F.col("width") * detection.scale(F.col("width"))).cast("int").alias("scaled"))


def crop_boxes(spark, folder):
    return detection.crops(_placed(spark, folder)).select("line_id", "cx0", "cy0", "cx1", "cy1")


def crop_neighbours(spark, folder):
    return detection.neighbours_in_crops(_placed(spark, folder))


def note_number_crops(spark, folder):
    return detection.note_number_crops(_placed(spark, folder))


def safe_names(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", jobs.safe_name(F.concat(F.lit("C:\\dir/"), F.coalesce("title", F.lit(".hidden")))).alias("name"), jobs.safe_name(F.col("title")).alias("own"))


def label_folders(spark, folder):
    return table(spark, folder, "sites").select("source", jobs.labels_folder(F.concat(F.lit("openrouter:site/"), "source")).alias("folder"))


def job_list(spark, folder):
    return jobs.job_list(table(spark, folder, "job_progress"))


def meta_pages(spark, folder):
    return jobs.meta_pages(ordering.pages(table(spark, folder, "page_layouts")))


def meta_pages_typed(spark, folder):
    """The same with pages of text standing in for typed ones."""
    return jobs.meta_pages(ordering.pages(table(spark, folder, "page_layouts")).filter("page_no > 1"), ("text",))


def row_decisions(spark, folder):
    at = _lines(spark, folder)
    note = at.filter(F.col("text").rlike(r"^[0-9۰-۹]{1,2}\s*[-–—.]")).select("book_id", "page_no", "row_no", F.lit("structure").alias("layer"), F.lit("note").alias("role"))
    noise = at.filter(lines.is_noise(F.col("conf"), F.col("text"))).select("book_id", "page_no", "row_no", F.lit("noise").alias("layer"), F.lit("noise").alias("role"))
    body = at.filter(lines.is_good(F.col("conf"), F.col("text")) & (F.length("text") >= 20)).select("book_id", "page_no", "row_no", F.lit("other").alias("layer"), F.lit("body").alias("role"))
    return decisions.collected(at, note.unionByName(decisions.of_layouts(ordering.pages(table(spark, folder, "page_layouts")))).unionByName(noise).unionByName(body))


def page_kinds(spark, folder):
    """First pages stand in for listed ones, books' last pages for openings of parts, pages 5 for labelled ones."""
    at = ordering.pages(table(spark, folder, "page_layouts"))
    last = at.groupBy("book_id").agg(F.max("page_no").alias("page_no")).withColumn("opens", F.lit("part"))
    labels = at.filter("page_no = 5").select("book_id", "page_no", F.lit("imprint").alias("label"))
    return decisions.page_kinds(at, labels, at.filter("page_no <= 2").select("book_id", "page_no"), last)


def text_model(spark, folder):
    weights = np.array([[((3 * b + 5 * c) % 7 - 3) / 4 for c in range(2)] for b in range(8)])
    tokens = table(spark, folder, "lineitem").filter("l_linenumber < 8").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("int") % 4 + (F.col("l_quantity").cast("int") % 4)).alias("t"))
    return tokens.select("l_orderkey", text_probabilities(TextModel(weights, np.array([0.25, -0.25])), F.col("t")).alias("p")).select("l_orderkey", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


def paragraph_starts(spark, folder):
    return lines.paragraph_starts(_lines(spark, folder))


def header_likes(spark, folder):
    return lines.header_likes(_lines(spark, folder))


def word_letters(spark, folder):
    return lines.word_letters(_lines(spark, folder))


def list_owners(spark, folder):
    """Short lines stand in for the heads of lists."""
    at = _lines(spark, folder)
    return markers.owners(at, at.filter("length(text) < 30").select("book_id", "page_no", "y0", F.col("line_id").alias("head")))


def lines_in_boxes(spark, folder):
    """The boxes of the layout step's headers stand in for regions."""
    heads = ordering.pages(table(spark, folder, "page_layouts")).filter("header.bbox IS NOT NULL").select("book_id", "page_no", F.lit("header").alias("region"), F.col("header.bbox").alias("region_box"))
    at = _lines(spark, folder).withColumn("box", F.array("x0", "y0", "x1", "y1"))
    return joins.lines_in_regions(at, heads, ["book_id", "page_no"], "line_id", "box", "region", "region_box")


def issue_order(spark, folder):
    """Place of each doubtful line among its page's issues, least sure first."""
    from pyspark.sql import Window as W

    w = W.partitionBy("book_id", "page_no").orderBy(F.col("doubt").desc(), "line_id")
    return issues.line_doubts(_lines(spark, folder)).filter("doubt >= 0.3").withColumn("place", F.row_number().over(w)).select("line_id", "place", "doubt")


def page_ranges(spark, folder):
    """Numbers of a written range of each book's pages."""
    b = table(spark, folder, "books").filter("n_pages IS NOT NULL").select("book_id", F.concat(F.lit("1-"), F.col("n_pages").cast("string"), F.lit(", "), (F.col("n_pages") + 5).cast("string"), F.lit(",x,9-3")).alias("pages"))
    return sequences.parse_ranges(b, "pages").groupBy("book_id").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


def job_ids(spark, folder):
    return table(spark, folder, "job_progress").filter("job_id IS NOT NULL AND sent_at IS NOT NULL").select(jobs.job_id(F.col("sent_at"), F.col("job_id")).alias("id")).distinct()


def note_gaps(spark, folder):
    """Numbers missing between the first and the last note of a page."""
    got = notes.page_notes(_lines(spark, folder)).filter("number IS NOT NULL").groupBy("book_id", "page_no").agg(F.array_sort(F.collect_set("number")).alias("n"))
    return got.select("book_id", "page_no", F.explode(F.array_except(F.sequence(F.array_min("n"), F.array_max("n")), "n")).alias("missing"))


def joined_notes(spark, folder):
    return notes.joined_notes(notes.page_notes(_lines(spark, folder)))


QUERIES = {f.__name__: f for f in (paragraph_starts, header_likes, word_letters, list_owners, lines_in_boxes, issue_order, page_ranges, job_ids, note_gaps, joined_notes, line_places, line_neighbours_far, book_tops, page_tests, readable_letters, figure_turns, stamp_lines, centred_lines, sure_lines, line_shape_more, box_kinds, small_text, detection_scales, crop_boxes, crop_neighbours, note_number_crops, safe_names, label_folders, job_list, meta_pages, meta_pages_typed, row_decisions, page_kinds, text_model)}

_BARE = "greatest(length(replace(t, ' ', '')), 1)"
_COUNT = lambda of: f"length(regexp_replace(t, '[^{of}]', '', 'g'))"
INDENT = BLOCK + """, be AS (SELECT l.*, lh, right_edge - left_edge AS bw, (right_edge - x1) / (right_edge - left_edge) AS ind, (x0 - left_edge) / (right_edge - left_edge) AS sl FROM l JOIN block USING (book_id, page_no) WHERE right_edge - left_edge > 1),
 bw AS (SELECT *, lag(sl) OVER w AS up_sl, y0 - lag(y1) OVER w AS gap, lead(ind) OVER w AS next_ind, row_number() OVER w AS k FROM be WINDOW w AS (PARTITION BY book_id, page_no ORDER BY y0, row_no)),
 ic AS (SELECT book_id, round_even(ind * 200, 0)::INT AS bin, count(*) AS n FROM bw WHERE up_sl > 0.06 AND gap >= 0 AND gap < lh AND ind BETWEEN 0.015 AND 0.15 GROUP BY ALL),
 iz AS (SELECT a.book_id, a.bin, a.n AS own, 2 * a.n + coalesce(sum(b.n), 0) AS n FROM ic a LEFT JOIN ic b ON a.book_id = b.book_id AND abs(a.bin - b.bin) = 1 GROUP BY a.book_id, a.bin, a.n),
 indents AS (SELECT book_id, CASE WHEN coalesce(sum(own), 0) < 20 THEN 0.04 ELSE arg_max(bin, n * 1000 - bin) / 200 END AS indent FROM (SELECT DISTINCT book_id FROM l) LEFT JOIN iz USING (book_id) GROUP BY book_id)"""
CROPS = PLACED + """, cm AS (SELECT *, greatest(8, round_even(0.35 * median(h) OVER (PARTITION BY book_id, page_no), 0))::INT AS px FROM p), cp AS (SELECT *, greatest(2, px // 2) AS py FROM cm),
 cr AS (SELECT *, greatest(0, x0 - px) AS cx0, greatest(0, y0 - py) AS cy0, least(page_w, x1 + px) AS cx1, least(page_h, y1 + py) AS cy1 FROM cp)"""
LATIN = "length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g'))"
_PAGES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY loaded_at DESC NULLS LAST, quality DESC NULLS LAST) AS rn FROM page_layouts) WHERE rn = 1"
_SAFE = lambda c: f"coalesce(nullif(left(regexp_replace(trim(regexp_replace(regexp_extract({c}, '([^\\\\/]*)$', 1), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Zl}}\\p{{Zp}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')), '^\\.+', ''), 150), ''), 'file')"
_META = lambda src, typed: f"""WITH p AS ({src}), k AS (SELECT book_id, page_no, kind, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM p),
 t AS (SELECT *, coalesce({typed}, false) AND (k <= 12 OR k > n - 4) AS typed FROM k), c AS (SELECT *, sum(typed::INT) OVER (PARTITION BY book_id ORDER BY page_no) AS t, bool_or(typed) OVER (PARTITION BY book_id) AS a FROM t)
 SELECT book_id, page_no FROM c WHERE CASE WHEN a THEN typed AND t <= 4 ELSE k <= 3 END"""  # noqa: E731

SQL = {
    "paragraph_starts": f"""WITH {INDENT}, pb AS (SELECT bw.*, indent, pitch FROM bw JOIN indents USING (book_id) JOIN block USING (book_id, page_no))
 SELECT line_id, ind > least(0.05, greatest(0.015, 0.6 * indent)) OR coalesce(up_sl > 0.06, false) OR coalesce((gap - greatest(0.0, pitch - lh)) / lh + 0.2 > 0.9, false) AS starts, coalesce(gap > 0.9 * lh, false) AS stanza FROM pb""",
    "word_letters": f"WITH {L}, j AS (SELECT line_id, coalesce(array_to_string(list_transform(words, lambda w: coalesce(w.text, '')), ' '), '') AS joined FROM l) SELECT line_id, joined, length(regexp_replace(joined, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::INT AS alnum FROM j",
    "list_owners": f"WITH {L}, u AS (SELECT book_id, page_no, row_no, y0, line_id, length(text) < 30 AS head FROM l) SELECT a.book_id, a.page_no, a.row_no, (SELECT arg_max(b.line_id, b.y0 * 1000000000000 + b.line_id) FROM u b WHERE b.head AND b.book_id = a.book_id AND b.page_no = a.page_no AND b.y0 <= a.y0) AS head FROM u a",
    "lines_in_boxes": f"WITH {L}, y AS ({_PAGES}) SELECT l.book_id, l.page_no, line_id, 'header' AS region FROM l JOIN y USING (book_id, page_no) WHERE header.bbox IS NOT NULL AND (x0 + x1) / 2 BETWEEN header.bbox[1] - 5 AND header.bbox[3] + 5 AND (y0 + y1) / 2 BETWEEN header.bbox[2] - 5 AND header.bbox[4] + 5",
    "issue_order": f"WITH {DOUBT} SELECT line_id, row_number() OVER (PARTITION BY book_id, page_no ORDER BY doubt DESC, line_id)::INT AS place, doubt FROM e WHERE doubt >= 0.3",
    "page_ranges": "SELECT book_id, n_pages + 1 AS n, (n_pages * (n_pages + 1) // 2 + n_pages + 5)::BIGINT AS total FROM books WHERE n_pages >= 1",
    "job_ids": "SELECT DISTINCT strftime(sent_at, '%Y%m%d-%H%M%S') || '-' || left(md5(job_id), 4) AS id FROM job_progress WHERE job_id IS NOT NULL AND sent_at IS NOT NULL",
    "line_places": f"""WITH {PLACED}, g AS (SELECT book_id, page_no, median(h) AS mid, min(y0) / max(page_h) AS first_y FROM p GROUP BY ALL), b AS (SELECT book_id, quantile_cont(first_y, 0.25) AS usual, max(page_no) AS last FROM g GROUP BY book_id)
 SELECT line_id, round(h / mid, 6) AS h_page, round(first_y, 6) AS first_y, round(first_y - usual, 6) AS y_vs_book_top, round(page_no / last, 6) AS page_pos FROM p JOIN g USING (book_id, page_no) JOIN b USING (book_id)""",
    "line_neighbours_far": f"""WITH {PLACED}, q AS (SELECT *, greatest(-60.0, least(60.0, coalesce((y0 - up) / h_med, y0 / h_med))) AS gap_up, greatest(-60.0, least(60.0, (coalesce(down, page_h) - y1) / h_med)) AS gap_down FROM p)
 SELECT line_id, round(coalesce(lag(h_book, 2) OVER w, -1), 6) AS prev2_h_book, round(coalesce(lead(h_book, 2) OVER w, -1), 6) AS next2_h_book, round(coalesce(lag(gap_up) OVER w, -1), 6) AS prev_gap_up, round(coalesce(lead(gap_down) OVER w, -1), 6) AS next_gap_down FROM q WINDOW w AS (PARTITION BY book_id, page_no ORDER BY rank)""",
    "book_tops": f"""WITH {L}, s AS (SELECT book_id, max(y1) AS page_h FROM l GROUP BY book_id), w AS (SELECT *, (x1 - x0) > 0.5 * max(x1 - x0) OVER (PARTITION BY book_id, page_no) AS wide FROM l),
 g AS (SELECT book_id, page_no, min(y0) FILTER (wide) AS top FROM w GROUP BY ALL HAVING count(*) FILTER (NOT {NOISE}) >= 8) SELECT s.book_id, round(coalesce(quantile_cont(top / page_h, 0.25), 0.08), 9) AS book_top FROM s LEFT JOIN g USING (book_id) GROUP BY s.book_id""",
    "indent_mode": f"WITH {INDENT} SELECT book_id, indent FROM indents",
    "page_tests": f"""WITH {INDENT}, x AS (SELECT bw.*, indent, coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')), 0), 0) > 0.5 AS ltr FROM bw JOIN indents USING (book_id)),
 y AS (SELECT *, CASE WHEN ltr THEN sl ELSE ind END AS near, CASE WHEN ltr THEN ind ELSE sl END AS far FROM x), z AS (SELECT *, lag(far) OVER (PARTITION BY book_id, page_no ORDER BY y0, row_no) < 0.03 AS after_full FROM y),
 g AS (SELECT book_id, page_no, count(*) AS n, avg((sl < 0.03 AND ind < 0.03)::INT) AS full_, count(*) FILTER (near > 0.02 AND k > 1) AS wraps, count(*) FILTER (near > 0.02 AND k > 1 AND after_full) AS wf, avg((ind < 0.02 OR abs(sl - ind) < 0.03)::INT) AS aligned,
  count(*) FILTER (sl > 0.06 AND next_ind IS NOT NULL) AS short, count(*) FILTER (sl > 0.06 AND next_ind > 0.6 * indent) AS si FROM z GROUP BY ALL)
 SELECT book_id, page_no, n, round(full_, 9) AS "full", n >= 6 AND wraps >= 3 AND wraps >= 0.25 * n AND wf >= 0.7 * wraps AS hanging, n >= 6 AND full_ < 0.5 AND aligned >= 0.8 AND short >= 0.3 * (n - 1) AND si < 0.3 * short AS poem FROM g""",
    "readable_letters": f"WITH {L} SELECT book_id, page_no, coalesce(sum(length(regexp_replace(text, '[^؀-ۿ]', '', 'g'))) FILTER (conf >= 80 AND length(trim(text)) >= 3), 0)::BIGINT AS letters FROM l GROUP BY ALL",
    "figure_turns": f"""WITH {L}, g AS (SELECT book_id, page_no, coalesce(sum(length(regexp_replace(text, '[^؀-ۿ]', '', 'g'))) FILTER (conf >= 80 AND length(trim(text)) >= 3), 0)::BIGINT AS a FROM l GROUP BY ALL),
 n AS (SELECT *, coalesce(lead(a) OVER w, 0) AS b, coalesce(lead(a, 2) OVER w, 0) AS c FROM g WINDOW w AS (PARTITION BY book_id ORDER BY page_no)), t AS (SELECT *, CASE WHEN b > a AND b >= c THEN 90 WHEN c > a AND c > b THEN 270 ELSE 0 END AS best FROM n)
 SELECT book_id, page_no, CASE WHEN best <> 0 AND greatest(a, b, c) >= greatest(20, 2 * a) THEN best ELSE 0 END AS turn FROM t""",
    "stamp_lines": f"""WITH {PLACED} SELECT line_id FROM p WHERE (y1 <= 0.12 * page_h OR y0 >= 0.88 * page_h OR x1 <= 0.1 * page_w OR x0 >= 0.9 * page_w) AND length(trim(text)) BETWEEN 3 AND 60
 AND regexp_matches(trim(text), '(?i)www\\.|https?://|\\.(?:com|net|org|ir|me|info|co)\\b|@\\w{{3,}}|t\\.me/|telegram')""",
    "centred_lines": f"WITH {PLACED} SELECT line_id FROM p WHERE x0 / page_w > 0.12 AND 1 - x1 / page_w > 0.12 AND abs(x0 / page_w - (1 - x1 / page_w)) < 0.08",
    "sure_lines": f"WITH {L}, s AS (SELECT book_id, page_no, line_id, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y0, row_no) AS k FROM l WHERE conf >= 85 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2) SELECT book_id, page_no, k::INT AS k, line_id FROM s WHERE k <= 8",
    "line_shape_more": f"""WITH {L}, s AS (SELECT line_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM l) SELECT line_id, round({_COUNT("ء-يپچژکگی")} / {_BARE}, 9) AS fa_share, round({_COUNT(".,،؛:!?؟…–—/" + chr(92) * 2 + "-")} / {_BARE}, 9) AS punct_share, round({_COUNT("ً-ْٰ")} / {_BARE}, 9) AS diacritic_share,
 ends_with(t, ':')::INT AS ends_colon, regexp_matches(t, '[،,]$')::INT AS ends_comma, regexp_matches(t, '(^|[^0-9۰-۹])((1[2-4]|19|20)[0-9]{{2}}([^0-9]|$)|(۱[۲-۴]|۱۹|۲۰)[۰-۹]{{2}}([^۰-۹]|$))')::INT AS has_year,
 length(string_split(t, ' ')[1])::INT AS first_word_len, length(string_split(t, ' ')[-1])::INT AS last_word_len FROM s""",
    "box_kinds": f"WITH {L}, m AS (SELECT *, median(h) OVER (PARTITION BY book_id, page_no) AS mid FROM l) SELECT line_id, CASE WHEN x1 - x0 < 8 OR h < 6 THEN 'dropped' WHEN h > 1.8 * mid AND h > 32 THEN 'block' ELSE 'line' END AS kind FROM m",
    "small_text": f"WITH {L} SELECT book_id, page_no, list_sort(list(h) FILTER (h IS NOT NULL))[count(h) // 2 + 1] AS height, list_sort(list(h) FILTER (h IS NOT NULL))[count(h) // 2 + 1] < 14 AS small FROM l GROUP BY ALL HAVING count(h) > 0",
    "detection_scales": f"WITH {L}, w AS (SELECT book_id, max(x1) AS width FROM l GROUP BY book_id), f AS (SELECT *, CASE WHEN width > 0 AND width < 1600 THEN 1600 / width WHEN width > 2000 THEN 2000 / width ELSE 1.0 END AS f FROM w) SELECT book_id, width, round(f, 9) AS factor, round_even(width * f, 0)::INT AS scaled FROM f",
    "crop_boxes": f"WITH {CROPS} SELECT line_id, cx0, cy0, cx1, cy1 FROM cr",
    "crop_neighbours": f"""WITH {CROPS}, n AS (SELECT a.line_id, b.line_id AS other, greatest(b.x0, a.cx0) AS u0, greatest(b.y0, a.cy0) AS v0, least(b.x1, a.cx1) AS u1, least(b.y1, a.cy1) AS v1, (b.y0 + b.y1) / 2 AS my, (b.x0 + b.x1) / 2 AS mx, a.x0, a.y0, a.x1, a.y1 FROM cr a JOIN cr b ON a.book_id = b.book_id AND a.page_no = b.page_no AND a.line_id <> b.line_id),
 s AS (SELECT *, CASE WHEN my < y0 THEN 'a' WHEN my > y1 THEN 'b' WHEN mx < x0 THEN 'l' ELSE 'r' END AS side FROM n WHERE u1 > u0 AND v1 > v0),
 c AS (SELECT line_id, other, CASE WHEN side = 'r' THEN greatest(u0, x1) ELSE u0 END AS u0, CASE WHEN side = 'b' THEN greatest(v0, y1) ELSE v0 END AS v0, CASE WHEN side = 'l' THEN least(u1, x0) ELSE u1 END AS u1, CASE WHEN side = 'a' THEN least(v1, y0) ELSE v1 END AS v1 FROM s) SELECT * FROM c WHERE u1 > u0 AND v1 > v0""",
    "note_number_crops": f"""WITH {PLACED}, ng AS (SELECT * FROM p WHERE length(text) >= 6), nm AS (SELECT book_id, page_no, list_sort(list(h))[count(*) // 2 + 1] AS mid FROM ng GROUP BY ALL),
 k AS (SELECT ng.*, regexp_extract(trim(text), '^[(\\[«]?([0-9۰-۹]{{1,4}}|\\*{{1,3}})', 1) AS lead, {LATIN} AS latin FROM ng JOIN nm USING (book_id, page_no) WHERE h <= 0.95 * mid AND y0 >= 0.4 * page_h),
 i AS (SELECT *, CASE WHEN lead <> '' AND len(words) > 0 THEN words[1].bbox END AS word FROM k WHERE NOT starts_with(lead, '*') AND length(lead) < 3),
 j AS (SELECT *, CASE WHEN latin THEN coalesce(word[3] + 0.2 * h, x0 + 0.8 * h) ELSE coalesce(word[1] - 0.2 * h, x1 - 0.8 * h) END AS inside FROM i),
 o AS (SELECT line_id, greatest(0, trunc(CASE WHEN latin THEN x0 - 1.2 * h ELSE inside END)::INT) AS u0, greatest(0, trunc(y0 - 0.35 * h)::INT) AS v0, least(page_w, trunc(CASE WHEN latin THEN inside ELSE x1 + 1.2 * h END)::INT) AS u1, least(page_h, trunc(y1 + 0.2 * h)::INT) AS v1 FROM j) SELECT * FROM o WHERE u1 - u0 > 4 AND v1 - v0 > 4""",
    "safe_names": f"SELECT doc_id, {_SAFE("'C:' || chr(92) || 'dir/' || coalesce(title, '.hidden')")} AS name, {_SAFE("coalesce(title, '')")} AS own FROM documents",
    "label_folders": "SELECT source, 'labels-' || regexp_replace('openrouter:site/' || source, '[^\\p{L}\\p{N}_.\\-]+', '-', 'g') AS folder FROM sites",
    "job_list": "WITH j AS (SELECT job_id, max(book_id) AS book_id, min(sent_at) AS first_at, max(sent_at) AS last_at FROM job_progress WHERE job_id IS NOT NULL GROUP BY job_id) SELECT *, row_number() OVER (ORDER BY first_at NULLS FIRST, job_id) AS turn, row_number() OVER (ORDER BY first_at DESC NULLS LAST, job_id) AS place FROM j",
    "meta_pages": _META(_PAGES, "kind IN ('cover', 'title', 'imprint')"),
    "meta_pages_typed": _META(_PAGES + " AND page_no > 1", "kind = 'text'"),
    "row_decisions": f"""WITH {L}, y AS ({_PAGES}), d AS (SELECT book_id, page_no, row_no, 1 AS k, 'structure' AS layer, 'note' AS role FROM l WHERE regexp_matches(text, '^[0-9۰-۹]{{1,2}}\\s*[-–—.]') UNION ALL SELECT book_id, page_no, header.row_no, 2, 'header', 'header' FROM y UNION ALL SELECT book_id, page_no, footer.row_no, 3, 'pagenum', 'pagenum' FROM y
  UNION ALL SELECT book_id, page_no, row_no, 5, 'other', 'body' FROM l WHERE {GOOD} AND length(text) >= 20 UNION ALL SELECT book_id, page_no, row_no, 6, 'noise', 'noise' FROM l WHERE {NOISE}), b AS (SELECT book_id, page_no, row_no, arg_min(layer, k) AS layer, arg_min(role, k) AS role FROM d WHERE row_no IS NOT NULL GROUP BY ALL)
 SELECT l.book_id, l.page_no, l.row_no, coalesce(layer, 'noise') AS layer, coalesce(role, 'noise') AS role FROM (SELECT DISTINCT book_id, page_no, row_no FROM l) l LEFT JOIN b USING (book_id, page_no, row_no)""",
    "page_kinds": f"""WITH y AS ({_PAGES}), m AS (SELECT book_id, max(page_no) AS last FROM y GROUP BY book_id) SELECT y.book_id, page_no, CASE WHEN page_no = 5 THEN 'imprint' WHEN page_no <= 2 THEN 'contents' WHEN kind IN ('figure', 'blank') THEN kind WHEN page_no = last THEN 'part' ELSE 'text' END AS type FROM y JOIN m USING (book_id)""",
    "text_model": """WITH t AS (SELECT l_orderkey, (l_linenumber % 4 + l_quantity::INT % 4)::INT AS b, count(*) AS n FROM lineitem WHERE l_linenumber < 8 GROUP BY ALL), s AS (SELECT l_orderkey, sqrt(sum(n * n)) AS z, sum(n * ((3 * b) % 7 - 3) / 4) AS w0, sum(n * ((3 * b + 5) % 7 - 3) / 4) AS w1 FROM t GROUP BY ALL),
 r AS (SELECT l_orderkey, exp(0.25::DOUBLE + w0 / z) AS e0, exp(-0.25::DOUBLE + w1 / z) AS e1 FROM s) SELECT l_orderkey, round(e0 / (e0 + e1), 6) AS p0, round(e1 / (e0 + e1), 6) AS p1 FROM r""",
}
