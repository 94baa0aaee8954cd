import json

from leafwork.operators import nested

SCHEMA = "review_id bigint, book_id string, review string, n_bytes bigint, received_at timestamp"


def files(spark, texts):
    from datetime import datetime

    return spark.createDataFrame([(i, "b", t, None, None if at is None else datetime(2024, 1, at)) for i, t, at in texts], SCHEMA)


LINE = {"i": 3, "h": ["r", None, "t"], "b": [1, 2, 3, 4], "was": {"r": "x"}}


def test_fields(spark):
    doc = {"pages": {"0006": {"lines": [LINE, None, {"i": 4}]}, "۱۲": {"lines": [{"i": 0, "h": ["n"]}]}, "p-3": {"lines": [LINE]}, "7": {"lines": None}}, "history": [None, {"pdf": 9, "before": {"lines": [LINE]}}, {"pdf": 2, "before": None}]}
    got = {tuple(r) for r in nested.review_fields(files(spark, [(1, json.dumps(doc), 1)])).collect()}
    assert got == {(1, "pages", -1, 6, 3, "r"), (1, "pages", -1, 6, 3, "t"), (1, "pages", -1, 12, 0, "n"), (1, "history", 1, 9, 3, "r"), (1, "history", 1, 9, 3, "t")}


def test_deliveries_and_broken_files(spark):
    old, new = ({"pages": {"1": {"lines": [{"i": 0, "h": [f]}]}}} for f in ("a", "b"))
    rows = [(1, json.dumps(old), 1), (1, json.dumps(new), 2), (1, '{"pages": ', 3), (2, None, 1), (3, "", 1), (4, "[1]", 1), (5, '{"pages": NaN}', 1), (6, json.dumps(old), None), (6, json.dumps(old), None)]
    got = {(r.review_id, r.field) for r in nested.review_fields(files(spark, rows)).collect()}
    assert got == {(1, "b"), (6, "a")}
    assert nested.review_fields(files(spark, [(1, None, 1)])).count() == 0


def test_inlining_by_repetition_sharing_and_recursion(spark):
    docs = [{"one": {"x": 1, "deep": {"y": "z"}}, "many": [{"v": 1}, {"v": 2}], "tree": {"kids": [{"tree": {"kids": []}}]}, "a": {"shared": {"s": 1}}, "b": {"shared": {"s": 2}}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id bigint, j string")
    tables = nested.inlining([tuple(r) for r in nested.schema_graph(df, "j").collect()])
    assert {"many", "tree", "kids", "shared"} <= set(tables) and "one" not in tables
    assert "one_x" in tables[""] and "one_deep_y" in tables[""] and tables["many"] == ["v"]


def test_links_lead_back_to_the_record(spark):
    doc = {"pages": {"1": {"lines": [LINE]}}}
    rows, tables = nested.shredded(files(spark, [(1, json.dumps(doc), 1)]), "review_id", "received_at", "review", nested.REVIEW_TABLES)
    by = {r.row_id: r for r in rows.collect()}
    h = next(r for r in by.values() if r.tbl == "h")
    line = by[h.parent_id]
    page = by[line.parent_id]
    assert (h.parent_tbl, line.tbl, page.tbl, page.key, by[page.parent_id].tbl) == ("lines", "lines", "*", "1", "")
    assert nested.flat_table(rows, "lines", tables["lines"]).first().c_i == "3"


def test_extra_columns_with_clashing_names(spark):
    doc = json.dumps({"pages": {"1": {"lines": [LINE]}}})
    df = files(spark, [(1, doc, 1)]).selectExpr("*", "1 AS record_id", "2 AS version", "3 AS json")
    assert nested.review_fields(df).count() == 2


def test_any_depth(spark):
    deep = lambda n: '{"pages": {"1": {"lines": [{"i": 5, "h": ["r"], "x": ' + "[" * n + "1" + "]" * n + "}]}}}"
    objects = '{"pages": {"1": {"lines": [{"i": 6, "h": ["s"], "x": ' + '{"x": ' * 20_000 + "null" + "}" * 20_000 + "}]}}}"
    rows = [(1, deep(2_000), 1), (2, deep(20_000), 1), (3, objects, 1), (4, deep(20_000)[:-1], 1)]
    got = {(r.review_id, r.line_i, r.field) for r in nested.review_fields(files(spark, rows)).collect()}
    assert got == {(1, 5, "r"), (2, 5, "r"), (3, 6, "s")}


def test_iterative_parser_agrees():
    texts = ["[]", "{}", "[1, -2.5e3, true, false, null]", ' {"a" : [ {} , [ ] ], "b": "x\\u06f1\\n"} ', '"\\ud800"', "7", '[1,]', '{"a":}', '{"a" 1}', "[1 2]", "[", "{", '{"a":1,}', "nul", "01", "[1]]", '{"a":1}x', "", " ", "-", '"a', "[tru]"]
    for t in texts:
        try:
            want = json.loads(t)
        except ValueError:
            want = None
        assert nested._deep(t) == want, t
    assert str(nested.parsed('{"i": ' + "9" * 5000 + "}")["i"]) == "9" * 5000


def test_strings_no_column_can_hold_and_names_that_are_data(spark, monkeypatch):
    doc = '{"pages": {"1": {"lines": [{"i": 1, "h": ["a\\ud800b"]}]}}}'
    assert {r.field for r in nested.review_fields(files(spark, [(1, doc, 1)])).collect()} == {"a\ufffdb"}
    monkeypatch.setattr(nested, "EDGES", 40)
    monkeypatch.setattr(nested, "NAMES", 20)
    wide = json.dumps({"pages": {f"k{i}": {"v": i} for i in range(50)}})
    rows, tables = nested.shredded(files(spark, [(1, wide, 1)]), "review_id", "received_at", "review")
    assert nested.ENTRY in tables and rows.filter("tbl = '*'").count() == 50


def test_what_a_person_set_for_pages(spark):
    doc = {"pages": {"4": {"page": {"type": "cover", "pn": "۱۲."}, "h": ["type", "pn"]}, "5": {"page": {"type": "blank", "pn": "7"}, "h": ["type"]}, "6": {"page": {"type": "figure", "pn": "x1"}, "h": ["pn"]}, "7": {"page": {"pn": "3"}}}}
    got = {(r.page_no, r.kind, r.number) for r in nested.review_pages(files(spark, [(1, json.dumps(doc), 1), (2, None, 1)])).collect()}
    assert got == {(4, "figure", 12), (5, "blank", None), (6, None, None)}


def test_numbers_set_by_hand_come_first(spark):
    from leafwork.operators import ordering

    lay = spark.createDataFrame([("b", p, [n], "text", q, None) for p, n, q in [(1, 1, 0.9), (2, 2, 0.9), (3, 3, 0.9), (4, 4, 0.9), (5, 5, 0.5)]], "book_id string, page_no int, number_candidates array<int>, kind string, quality double, loaded_at timestamp")
    rows = spark.createDataFrame([("b", p, f"{w} " * 9) for p, w in ((2, "alpha"), (5, "other"))], "book_id string, page_no int, text string")
    hand = spark.createDataFrame([("b", 5, 2), ("b", 77, 9), ("b", 1, None)], "book_id string, page_no int, number int")
    got = {r.page_no: (r.number, r.status) for r in ordering.page_order(lay, rows, hand).collect()}
    assert got[5] == (2, "own") and got[2][1] != "own" and got[1] == (1, "own")
