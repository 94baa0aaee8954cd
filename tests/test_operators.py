import random

import pytest
from pyspark.sql import functions as F

from leafwork.operators import columns, issues, joins, labels, lines, notes, ordering, sequences
from leafwork.operators.delivery import latest, latest_fields


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d")], "k int, at int, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"], "at").collect()} == {(1, "b"), (None, "d")}
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 6), (1, 3, None, None)], "k int, at int, v string, n int")
    assert tuple(latest_fields(df, ["k"], "at", ["v", "n"]).first()) == (1, "a", 6)


def test_running_values_against_loops(spark):
    random.seed(1)
    data = [(g, i, random.choice([None, random.randrange(9)])) for g in ("a", "b", None) for i in random.sample(range(-5, 30_000), 300)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    got = {(r.g, r.i): r for r in sequences.running_sum(sequences.last_known(sequences.last_known(sequences.running_max(df, ["g"], "i", "v", "m"), ["g"], "i", "v", "p"), ["g"], "i", "v", "n", back=True, strictly=True), ["g"], "i", "v", "s").collect()}
    assert len(got) == len(data)
    for g in ("a", "b", None):
        own = sorted((i, v) for h, i, v in data if h == g)
        total, best, seen = 0, None, None
        for k, (i, v) in enumerate(own):
            r = got[g, i]
            total += v or 0
            assert (r.s, r.m) == (total, best)
            seen = v if v is not None else seen
            assert r.p == seen
            assert r.n == next((w for _, w in own[k + 1 :] if w is not None), None)
            if v is not None:
                best = v if best is None else max(best, v)


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, 9, 10)] + [("b", None)], "g string, n int")
    assert rows(sequences.runs(df, ["g"], "n"), "first", "last") == [(1, 3), (7, 7), (9, 10)]
    assert rows(sequences.missing(df, ["g"], "n"), "first", "last") == [(4, 6), (8, 8)]
    df = spark.createDataFrame([("1-3, 9",), ("x,5-2",), (None,)], "r string")
    assert rows(sequences.parse_ranges(df, "r"), "number") == [(1,), (2,), (3,), (9,)]


def test_band_and_between(spark):
    a = spark.createDataFrame([("k", i) for i in (-7, 0, 3, 10)] + [(None, 3), ("k", None)], "g string, a int")
    b = spark.createDataFrame([("k", i) for i in (-9, 1, 4, 12)], "g string, b int")
    assert rows(joins.band(a, b, ["g"], "a", "b", 2), "a", "b") == [(-7, -9), (0, 1), (3, 1), (3, 4), (10, 12)]
    r = spark.createDataFrame([("k", -8, 0), ("k", 3, 3), ("k", 9, 1)], "g string, lo int, hi int")
    assert rows(joins.between(a, r, ["g"], "a", "lo", "hi", 4), "a", "lo") == [(-7, -8), (0, -8), (3, 3)]


def test_nearest_ties(spark):
    a = spark.createDataFrame([(1, "k", 5), (2, "k", 50)], "id int, g string, a int")
    b = spark.createDataFrame([("k", 4, "low"), ("k", 6, "high")], "g string, b int, v string")
    assert rows(joins.nearest(a, b, ["g"], "id", "a", "b", 3, "v"), "id", "v") == [(1, "low"), (2, None)]


def test_matched_boxes(spark):
    stored = spark.createDataFrame([("p", i, [0, 20 * i, 100, 20 * i + 10]) for i in range(4)], "page string, i int, old_box array<int>")
    same = spark.createDataFrame([("p", i + 1, [0, 20 * i, 100, 20 * i + 10]) for i in range(3)], "page string, row_no int, box array<int>")
    assert rows(joins.matched_boxes(stored, same, ["page"]), "i", "row_no", "how") == [(0, 1, "moved"), (1, 2, "moved"), (2, 3, "moved"), (3, None, "lost")]


def test_layers_and_sets(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "p", None)], "k int, u string, v string")
    b = spark.createDataFrame([(1, "m", "y"), (3, "z", None)], "k int, u string, v string")
    assert rows(joins.layered(a, b, keys=["k"], fields=["u", "v"]), "k", "u", "v") == [(1, "m", "x"), (2, "p", None), (3, "z", None)]
    x = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["q"])], "g string, a int, s array<string>")
    y = spark.createDataFrame([("g", 7, ["a", "b", "c"]), ("g", 8, ["a"])], "g string, b int, t array<string>")
    assert rows(joins.set_similarity(x, y, ["g"], "a", "s", "b", "t"), "a", "best") == [(1, 2 / 3), (2, 0.0)]


LAYOUT = "book_id string, page_no int, kind string, number_candidates array<int>, quality double, loaded_at timestamp_ntz"


def book(spark, numbers):
    return spark.createDataFrame([("b", i, "text", [] if n is None else [n], 0.9, None) for i, n in enumerate(numbers, 1)], LAYOUT)


def words(make_rows, texts):
    return make_rows([(i, "b", i, 0, [0, 0, 1, 1], t) for i, t in enumerate(texts, 1)])


def own_words(i):
    return " ".join(f"word{i}x{k}" for k in range(12))


def test_misread_number_is_put_on_its_run(spark, make_rows):
    numbers = [*range(1, 12), 4, 13]
    got = {r.page_no: r for r in ordering.page_order(book(spark, numbers), words(make_rows, [own_words(i) for i in range(1, 14)])).collect()}
    assert got[4].number == 4 and got[4].status == "own"
    assert 11 < got[12].sort_key < 13
    assert all(r.status == "own" for i, r in got.items() if i != 12)


def test_second_scan_and_other_page(spark, make_rows):
    numbers = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11]
    texts = [own_words(i) for i in range(1, 13)]
    texts[4] = texts[3]
    got = ordering.page_order(book(spark, numbers), words(make_rows, texts)).collect()
    assert [r.page_no for r in got if r.status == "second_scan"] in ([4], [5])
    texts[4] = own_words(99)
    got = ordering.page_order(book(spark, numbers), words(make_rows, texts)).collect()
    assert not [r for r in got if r.status == "second_scan"] and len([r for r in got if r.status == "apart"]) == 1


def test_reversed_and_missing(spark):
    lay = book(spark, [1, 2, 3, 4, 5, 6, 13, 14, 15, 16, 17, 30, 29, 28, 27, 26, 25])
    assert (12, 17, 30) in rows(ordering.reversed_runs(lay), "first_page", "last_page", "first_number")
    assert rows(ordering.missing_numbers(lay), "first", "last") == [(7, 12), (18, 24)]
    none = ordering.numbered(book(spark, [None, None])).collect()
    assert sorted(r.number for r in none) == [1, 2]


def test_notes():
    assert notes.split_page_notes(["rest of a note", "۱- first", "goes on", "۲- second"]) == (["rest of a note"], [(1, "first goes on"), (2, "second")])
    assert notes.split_page_notes(["* a", "b", "** c"]) == ([], [(1, "a b"), (2, "c")])
    assert notes.split_page_notes(["۴۷۹ is text"]) == (["۴۷۹ is text"], [])
    assert notes.split_page_notes(["۵- next"], before=4) == ([], [(5, "next")])
    assert notes.split_page_notes([]) == ([], [])
    assert (6, "همان.", 0.8) in notes.note_candidates("۶۰ -همان.")


def test_columns():
    right, left = [(600, 0, 1000, 10), (610, 20, 990, 30)], [(0, 0, 400, 10), (10, 20, 390, 30)]
    assert columns.column_numbers(left + right) == [1, 1, 0, 0]
    assert columns.row_numbers([(0, 0, 5, 10), (9, 2, 15, 12), (0, 30, 5, 40)]) == [0, 0, 1]
    assert columns.column_numbers([]) == []


def test_doubt(spark):
    df = spark.createDataFrame([(99.5,), (72.0,), (None,)], "w double")
    assert [r.d for r in df.select(issues.text_doubt(F.col("w")).alias("d")).collect()] == [0.0, 1.0, None]
    lev = spark.createDataFrame([(0.6,), (0.3,), (0.05,), (None,)], "d double").select(issues.level(F.col("d")).alias("x")).collect()
    assert [r.x for r in lev] == ["unsure", "check", "sure", None]


def test_answer_problems(spark):
    good = '{"page": {"type": "text"}, "lines": [{"i": 0, "r": "body"}, {"i": 1, "r": "heading", "l": 2}]}'
    cases = {
        "Well: " + good: [],
        "nothing": ["not the expected JSON"],
        '{"lines": [{"i": 0, "r": "body"}, {"i": 0, "r": "body"}]}': ["no page", "duplicate index: 0", "missing index: 1"],
        '{"page": {"type": "odd"}, "lines": [{"i": 0, "r": "king"}, {"i": 1, "r": "heading"}, {"i": 7, "r": "body"}]}': ["unknown page type", "unknown index: 1", "unknown role: 0", "heading level: 1"],
    }
    df = spark.createDataFrame([(t, 2) for t in cases], "t string, n int")
    for r in labels.problems(labels.parsed(df, "t"), "n").collect():
        assert r.problems == cases[r.t]


def test_line_features_on_empty_table(spark, make_rows):
    empty = lines.text_lines(make_rows([(1, None, None, 0, None, None)]))
    for f in (lines.page_quality, lines.block_metrics, lines.zones, lines.repeat_share, lines.indent_mode, lines.word_stats):
        assert f(empty).count() == 0
    assert lines.small_runs(lines.placed(empty)).count() == 0


@pytest.mark.parametrize("box", [None, [], [1, 2]])
def test_null_boxes(make_rows, box):
    got = lines.text_lines(make_rows([(1, "b", 1, 0, box, "text")]))
    assert got.count() == 1 and lines.placed(got).count() == 1


def test_answers_over_the_labels_of_review_files(spark):
    from leafwork.operators.labels import ROLES, PAGE_TYPES, cost, label_plan, to_retry

    assert len(set(ROLES)) == 17 and len(set(PAGE_TYPES)) == 17
    df = spark.createDataFrame([(10, 20, 1.0, 2.0, None), (10, 20, None, None, 0.5), (10, 20, None, None, None)], "i int, o int, p double, q double, c double")
    got = [r.x for r in df.select(cost(F.col("i"), F.col("o"), F.col("p"), F.col("q"), F.col("c")).alias("x")).collect()]
    assert got == [5e-05, 0.5, None]
    errors = spark.createDataFrame([("blocked: x",), ("finish reason",), ("HTTP 500",), (None,)], "e string")
    assert [r.x for r in errors.select(to_retry(F.col("e")).alias("x")).collect()] == [False, False, True, True]
    lines = spark.createDataFrame([("b", 1, "abcd"), ("b", 2, "x"), ("b", 2, "y")], "book_id string, page_no int, text string")
    done = lines.filter("page_no = 1")
    assert tuple(label_plan(lines, done).first()) == ("b", 1, 8000 + 545 + int(18 / 2.74), 3000 + 94 + int(2 * 16.9))
