import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from leafwork.kernels import pixels as P
from leafwork.operators import contents as C
from leafwork.operators import corrections as R


def test_contents_lines(spark):
    df = spark.createDataFrame([("فصل اول ........ ۱۲",), ("فصل دوم | ۱۰۳",), ("بی شماره",), ("مقدمه - ۳.۹",)], "t string")
    got = [tuple(r) for r in df.select(C.entry_title(F.col("t")), C.entry_number(F.col("t"))).collect()]
    assert got == [("فصل اول", 12), ("فصل دوم", 103), ("بی شماره", None), ("مقدمه", 309)]


def entries(spark, numbers, titles=None):
    return spark.createDataFrame([("b", "contents", i, n, titles[i] if titles else f"title {i}") for i, n in enumerate(numbers)], "book_id string, list string, pos int, number int, title string")


def test_numbers_put_right(spark):
    e = entries(spark, [5, 1800, 200, 9, None, 250])
    got = {r.pos: r.number for r in C.drop_unordered(C.read_zeros(e, 300)).collect()}
    assert got == {0: 5, 1: 180, 2: 200, 3: None, 4: None, 5: 250}


def test_labels_are_numbered(spark):
    got = {r.pos: r.title for r in C.numbered_labels(entries(spark, [1, 2, 3], ["فصل", "فصل ۲", "پایان"])).collect()}
    assert got == {0: "فصل ۱", 1: "فصل ۲", 2: "پایان"}


def test_longest_chain():
    assert C.longest_chain([[3, 9], [5], [4, 8]], [None, None, None]) == {0: 3, 1: 5, 2: 8}
    assert C.longest_chain([[3, 7], []], [7, None]) == {0: 7}
    assert C.longest_chain([], []) == {}


def test_alignment(spark):
    e = entries(spark, [3, 9, None], ["The northern garden", "Rivers and markets", "A letter"])
    heads = spark.createDataFrame([("b", 4, "The nothern garden"), ("b", 11, "Rivers and markets"), ("b", 2, "Rivers and markets"), ("b", 12, "A letter to the town")], "book_id string, page int, text string")
    assert {r.pos: r.page for r in C.align(e, heads).collect()} == {0: 4, 1: 11, 2: 12}
    assert C.align(e.limit(0), heads).count() == 0


def test_corrections(spark):
    log = spark.createDataFrame([(1, 0, "r", "note", 1), (1, 0, "n", "4", 1), (1, 0, "r", "body", 2), (1, 0, "n", None, 3), (1, 9, "r", "x", 3), (1, 1, "zz", "q", 4)], "page int, row int, field string, value string, seq int")
    decided = spark.createDataFrame([(1, 0, {"r": "quote", "p": "true"}), (1, 1, None)], "page int, row int, fields map<string,string>")
    got = {r.row: (r.fields, r.h) for r in R.overlaid(decided, log).collect()}
    assert got == {0: ({"r": "body", "p": "true"}, ["r"]), 1: ({}, [])}
    got = {r.row: r.h for r in R.overlaid(decided, R.undone(log, 2)).collect()}
    assert got[0] == ["n", "r"]
    assert R.kept_history(log.withColumn("book_id", F.lit("b")), 2).count() == 3


def test_kernels():
    ink = np.zeros((100, 200), bool)
    ink[50:52, 20:180] = True
    ink[10:30, 10:190] = True
    (y, a, b, thick), *rest = P.rules(ink, [(5, 5, 195, 35)])
    assert not rest and 49 <= y <= 52 and (a, b) == (20, 180) and thick <= 3
    assert P.ink_share(ink, (10, 10, 190, 30)) == (1.0, 1.0) and P.ink_share(ink, (300, 0, 310, 5)) == (0.0, 0.0)
    line = np.ones((10, 100), bool)
    line[:, 45:60] = False
    assert P.widest_gap(line) == (45, 60)
    rows = np.zeros((90, 50), bool)
    rows[5:25] = rows[35:55] = rows[65:85] = True
    assert P.row_pieces(rows) == [(5, 25), (35, 55), (65, 85)] and P.row_pieces(np.zeros((4, 4), bool)) == []
    assert P.dense_blocks(rows).sum() > 0
    spots = np.array([[1, 0, 1, 0, 0], [0, 1, 0, 0, 1], [0, 0, 0, 0, 1], [1, 0, 0, 0, 0]], bool)
    numbers, n = P.labelled(spots)
    assert n == 3 and numbers[0, 0] == numbers[0, 2] == numbers[1, 1] != numbers[1, 4] and (numbers > 0).sum() == spots.sum()


def png(grey):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = grey.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_page_images(spark, tmp_path):
    grey = np.full((80, 160), 255, np.uint8)
    grey[40:43, 10:150] = 0
    (tmp_path / "a.png").write_bytes(png(grey))
    r = P.page_ink(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.n_rules) == (160, 80, 1) and abs(r.ink - 420 / 12800) < 1e-9


def test_markers_and_their_notes(spark, make_rows):
    from leafwork.operators import lines as L
    from leafwork.operators import markers as M

    texts = ["کتاب۱ را خواند.", "در سال ۱۳۰۰ بود و خانه ۲، رفت", "سه* و چهار**", "باز هم۱ نوشت"]
    rows = L.text_lines(make_rows([(i, "b", 1, i, [0, 30 * i, 90, 30 * i + 20], t) for i, t in enumerate(texts)]))
    marks = M.markers(rows)
    got = {(r.row_no, r.number, r.weak) for r in marks.collect()}
    assert {(0, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (3, 1, False)} == got
    notes = spark.createDataFrame([("b", 1, 1, 1), ("b", 1, 2, 2), ("b", 1, 3, 9), ("b", 1, 0, None)], "book_id string, page_no int, pos int, number int")
    links = M.linked(marks, notes)
    assert {(r.pos, r.row_no) for r in links.collect()} == {(1, 0), (2, 2), (3, None)}
    assert [r.pos for r in M.unlinked(links).collect()] == [3]
    assert {(r.row_no, r.number) for r in M.stray(marks, links).collect()} == {(2, 1), (3, 1)}
    heads = spark.createDataFrame([("b", 1, 30, "h1"), ("b", 1, 60, "h2")], "book_id string, page_no int, y0 int, head string")
    assert {r.row_no: r.head for r in M.owners(rows, heads).collect()} == {0: None, 1: "h1", 2: "h2", 3: "h2"}
