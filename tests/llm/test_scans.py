import random

import pytest

from leafwork.llm import scans

WORDS = ["garden", "river", "market", "letter", "harbour", "mirror", "teacher", "window", "lantern", "orchard", "remembered", "painted", "followed", "abandoned", "measured", "instrument", "carpenter", "beautiful", "mountain", "children"]


@pytest.fixture(scope="module")
def book(spark, make_rows):
    """A book with running headers, page numbers, stamps, broken words and misread characters, and what they are."""
    r = random.Random(1)
    rows, truth, line = [], set(), 0
    pairs = [("e", "c"), ("n", "u"), ("a", "o")]

    def add(page, box, text, *defects):
        nonlocal line
        line += 1
        rows.append((line, "b", page, line, box, text))
        truth.update((line, d) for d in defects)

    carry = ""
    for page in range(1, 121):
        title = "The history of the northern garden" if page % 2 else "Chapter of rivers and markets"
        x = r.randrange(120, 300)
        add(page, [x, 60, x + 300, 90], f"{title} {page}", "furniture")
        for k in range(24):
            words = [r.choice(WORDS) for _ in range(7)]
            if carry:
                words[0] = carry
                carry = ""
            defects = []
            if r.random() < 0.03:
                i = r.randrange(1, 6)
                a, b = r.choice(pairs)
                if a in words[i]:
                    words[i] = words[i].replace(a, b, 1)
                    defects.append("misread")
            if r.random() < 0.05 and k < 23:
                whole = r.choice([w for w in WORDS if len(w) > 7])
                words[-1], carry = whole[:4] + r.choice(["-", "¬", " -", "\xad"]), whole[4:]
                defects.append("split")
            add(page, [100, 140 + 50 * k, 900 - (0 if k % 6 != 5 else 400), 176 + 50 * k], " ".join(words), *defects)
        if page % 3:
            add(page, [480, 1400, 510, 1424], f"- {page} -", "furniture")
        else:
            add(page, [480, 1400, 900, 1424], "www.some-library.example", "furniture")
    rows += [(line + 1, "b", 1, 900, None, None), (line + 2, "b", 1, 901, [5, 5, 9, 9], ""), rows[5]]
    books = spark.createDataFrame([("b", "site"), ("other", None)], "book_id string, source string")
    return make_rows(rows), books, truth, rows


def test_defects(book):
    rows, books, truth, _ = book
    got = {tuple(r) for r in scans.scan_defects(rows, books).collect()}
    for defect, share in (("furniture", 1.0), ("split", 0.97), ("misread", 0.9)):
        want, have = ({x for x in s if x[1] == defect} for s in (truth, got))
        assert len(want & have) >= share * len(want), defect
        assert len(want & have) >= 0.97 * len(have), (defect, sorted(have - want)[:5])


def test_paragraphs(book):
    rows, books, _, raw = book
    paras = scans.book_paragraphs(rows, books).orderBy("para_no").collect()
    text = " ".join(p.text for p in paras)
    assert [p.para_no for p in paras] == list(range(1, len(paras) + 1))
    assert "some-library" not in text and "history of the northern" not in text and "¬" not in text and "\xad" not in text
    known = sum(w in WORDS for w in text.split())
    assert known / len(text.split()) > 0.995
    assert 300 < len(paras) < 700


def test_degenerate_tables(spark, make_rows):
    books = spark.createDataFrame([(None, "s")], "book_id string, source string")
    empty = make_rows([(1, "b", 1, 0, None, None)]).limit(0)
    assert scans.scan_defects(empty, books).count() == 0 and scans.book_paragraphs(empty, books).count() == 0
    odd = make_rows([(1, None, None, 0, None, "only text"), (2, "b", 1, 0, [1, 2], "wo-"), (3, "b", 1, 1, None, "rd"), (4, "b", 1, 1, [0, 0, 5, 5], "x" * 10_000), (None, "b", 1, 0, None, "no id")])
    assert scans.scan_defects(odd.selectExpr("*", "1 AS furniture", "'z' AS lh"), books).filter("line_id = 1").count() == 0
    assert scans.book_paragraphs(odd, books).count() >= 2


@pytest.mark.parametrize("times", [1, 12])
def test_unknown_words_are_broken_at_every_size(spark, times):
    """Six of 60 rows end in a part whose join is unknown; one of 300 in a word before a dash."""
    text = []
    for _ in range(times):
        text += [x for k in range(6) for x in ("the garden of carpen-", "ter" + "abcdefghijkl"[_] + "stuvwx"[k] + " in the market")]
        text += ["old river and window"] * 60 + ["over the river -", "market of mirrors"] + ["by the river"] * 300
    rows = [(i, "b", i // 30, 0, i % 30, t, False) for i, t in enumerate(text)]
    at = spark.createDataFrame(rows, "line_id bigint, book_id string, page_no int, col_no int, y0 int, text string, furniture boolean")
    got = {r.line_id for r in scans.broken_words(at, scans.vocabulary(at)).collect()}
    assert got == {i for i, t in enumerate(text) if t.endswith("carpen-")}


def test_lost_accents_are_misread_on_the_same_evidence(spark):
    words = [("préfet", 3000), ("théâtre", 3000), ("siècle", 3000), ("été", 3000), ("sévère", 3000), ("prefet", 2), ("theâtre", 2), ("sevère", 2), ("marché", 40), ("marche", 30)]
    got = {r.word: r.meant for r in scans.misread_words(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert got == {"prefet": "préfet", "theâtre": "théâtre", "sevère": "sévère"}


LAYOUT = "book_id string, page_no int, kind string, header struct<row_no:int,text:string>, footer struct<row_no:int,text:string>, number_candidates array<int>, quality double, loaded_at timestamp"


def test_paragraphs_of_latest_deliveries_without_second_scans(spark):
    from datetime import datetime

    from conftest import ROW

    def row(line, page, k, text, at=1):
        return (line, "b", page, None, k, 0, [100, 140 + 50 * k, 900, 176 + 50 * k], text, 95.0, None, None, datetime(2024, 1, at))

    filler = [f"the {a} gardener of the {b} river remembered every lantern" for a in ("old", "kind", "tall") for b in ("wide", "long", "cold")]
    rows, line, page_text = [], 0, {}
    for page in range(1, 9):
        # page 5 is page 4 scanned again, page 7 is a picture
        source = 4 if page == 5 else page
        for k in range(9):
            if page == 7:
                continue
            line += 1
            text = filler[(k + source) % 9] + f" {'abcdefgh'[source - 1] * 4}"
            if page == 6 and k == 8:
                text = text[:-4] + "moun-"
            if page == 8 and k == 0:
                text = "tain " + text
            page_text.setdefault(page, []).append(text)
            rows.append(row(line, page, k, text, 2))
            if page == 2 and k == 3:
                rows.append(row(line, page, k, "an earlier delivery of this row", 1))
    line += 1
    rows += [row(900 + i, 1, 20 + i, "a mountain stood behind the mountain", 2) for i in range(2)]
    df = spark.createDataFrame(rows, ROW)
    layouts = spark.createDataFrame([("b", p, "text", None, None, [p - (p >= 5)], 0.9 - p / 100, datetime(2024, 1, 1)) for p in range(1, 9)], LAYOUT)
    books = spark.createDataFrame([("b", "s")], "book_id string, source string")
    got = scans.book_paragraphs(df, books, layouts).orderBy("para_no").collect()
    text = " ".join(r.text for r in got)
    assert "earlier delivery" not in text
    assert text.count("dddd") == 9, "the second scan adds nothing"
    assert "mountain " + page_text[8][0][5:] in text, "a word goes on over a page without text"
    assert [r.para_no for r in got] == sorted({r.para_no for r in got})


def test_long_words_meet_by_halves(spark):
    word = "abcdefghij" * 8
    other = word[:50] + "c" + word[51:]
    words = spark.createDataFrame([(word, 500), (other, 1), (word + "x", 1), (word[:10] + "zz" + word[12:], 1)], "word string, n bigint").selectExpr("*", "false AS unsure")
    got = [tuple(r) for r in scans._long_pairs(words).collect()]
    assert got == [(other, 1, False, "c", word, "a", 500)]


def test_unsure_words_need_less_evidence(spark):
    often = [(w, 4000, 10) for w in ("garden", "carpenter", "harbour", "reader", "market")] + [("rivers", 40, 1)]
    wrong = [(w.replace("a", "o"), 3, 0) for w in ("garden", "carpenter", "harbour", "reader", "market")]
    words = spark.createDataFrame(often + wrong + [("rivors", 1, 0), ("rivcrs", 1, 1)] + [(w.replace("e", "c", 1), 3, 2) for w in ("garden", "carpenter", "reader", "market")], "word string, n bigint, n_unsure bigint")
    got = {r.word: r.meant for r in scans.misread_words(words).collect()}
    assert got["gorden"] == "garden" and got["gardcn"] == "garden" and got["rivcrs"] == "rivers" and "rivors" not in got
