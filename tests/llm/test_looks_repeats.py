import random
import unicodedata

import pytest

from leafwork.llm import repeats
from leafwork.llm.lookpairs import look_alike_pairs
from leafwork.llm.looks import one_form

SAME = [
    ("www.likеdеn ｔｅｘｔ", "www.likeden text"), ("été", "été"), ("ﬁn", "fin"), ("a b c　d", "a b c d"), ("  a   b ", "a b"), ("ab​‏﻿­", "ab"), ("كردن", "کردن"), ("ميان", "میان"), ("ﺭﺩ", "رد"),
    ("آب", "آب"), ("هٔ", "ۀ"), ("کاغذ‌ها", "کاغذها"), ("نامه‌‌ای", "نامه‌ای"), ("نامه‌ ای", "نامه ای"), ("١٢٣", "۱۲۳"), ("ạ̇", "ạ̇"), ("​", ""), ("１２", "12"),
]
OTHER = [("نامه‌ای", "نامهای"), ("آب", "اب"), ("été", "ete"), ("کتاب", "کِتاب"), ("٤", "۴"), ("a b", "ab"), ("a, b", "a b"), ("بازي", "بازی"), ("كوچك", "کوچک"), ("6", "8")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r.one_form for r in one_form(df, ["id"], "text").collect()}


def test_same_and_other_looks(spark):
    got = forms(spark, [t for pair in SAME + OTHER for t in pair])
    for k, (a, b) in enumerate(SAME):
        assert got[2 * k] == got[2 * k + 1], (a, b)
    for k, (a, b) in enumerate(OTHER, len(SAME)):
        assert got[2 * k] != got[2 * k + 1], (a, b)


def test_null_empty_long_and_astral(spark):
    got = forms(spark, [None, "", "é" * 5000, "😀é𝒳"])
    assert got == {0: None, 1: "", 2: "é" * 5000, 3: "😀é𝒳"}


def test_composition_is_that_of_unicode(spark):
    random.seed(4)
    marks = "̧̣̀́̂̈"
    texts = ["".join(random.choice("aeoucsABC xy") + "".join(random.choice(marks) for _ in range(random.choice([0, 0, 1, 2]))) for _ in range(30)) for _ in range(60)]
    got = forms(spark, texts)
    for i, t in enumerate(texts):
        assert unicodedata.normalize("NFD", got[i]) == unicodedata.normalize("NFD", " ".join(t.split(" "))).strip() or "  " in t


def test_pairs(spark, make_rows):
    base = "این یک سطر بلند است که سی حرف بیشتر دارد و تمام"
    other = base.replace(" ", " ", 1)
    rows = [(1, "b", 1, 0, None, base), (2, "b", 2, 0, None, other), (3, "b", 3, 0, None, base), (4, "c", 1, 0, None, other), (5, "b", 4, 0, None, "short"), (6, "b", 5, 0, None, None), (7, None, 1, 0, None, base), (2, "b", 2, 0, None, other), (8, "b", 9, 0, None, base.replace("بلند", "بلنذ"))]
    got = sorted(tuple(r) for r in look_alike_pairs(make_rows(rows)).collect())
    assert got == [(1, 2), (2, 3)]
    assert look_alike_pairs(make_rows(rows).limit(0)).count() == 0


def brute(docs, share, least, letters):
    key = lambda line: "".join(c for c in line.lower() if c.isalpha())
    n, texts = {}, {}
    for d, text, source in docs:
        if source is None:
            continue
        texts[source] = texts.get(source, 0) + 1
        for k in {key(x) for x in (text or "").split("\n")}:
            n[source, k] = n.get((source, k), 0) + 1
    return {(d, i) for d, text, source in docs if source is not None for i, x in enumerate((text or "").split("\n")) if len(key(x)) >= letters and n[source, key(x)] >= max(least, share * texts[source])}


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_repeats_against_counting(make_docs, share):
    random.seed(5)
    pool = [f"notice number {w} of this reading site" for w in ("one", "two", "three", "four", "five", "six")]
    docs = []
    for d in range(400):
        lines = ["".join(random.choice("abcdefgh ") for _ in range(30)) for _ in range(random.randrange(4))]
        lines += [p.upper() if random.random() < 0.2 else f" {p}, {d}" for k, p in enumerate(pool) if random.random() < 0.02 * (k + 1) ** 2]
        random.shuffle(lines)
        docs.append((d, "\n".join(lines), random.choice(["hot", "hot", "cold", None])))
    docs += [(900, None, "cold"), (901, "", "hot"), (902, "one line that stands only here", "rare"), (902, "one line that stands only here", "rare")]
    got = {tuple(r) for r in repeats.repeated_in_documents(make_docs(docs), share=share).collect()}
    assert got == brute(docs, share, 3, 15) and got


def test_summaries_lose_nothing_when_small(make_docs):
    # far more distinct lines than counters
    docs = [(d, "\n".join([f"unique {chr(97 + d % 26)}{'abcdefghij'[d // 26 % 10]} line {'xyzuvw'[k]} words words {'q' * (d % 50)}" for k in range(6)] + (["the line that is repeated here"] if d % 10 == 0 else [])), "s") for d in range(600)]
    got = {tuple(r) for r in repeats.repeated_in_documents(make_docs(docs), share=0.09).collect()}
    assert got == brute(docs, 0.09, 3, 15)


def test_books_count_once_each(spark, make_rows):
    stamp = "pages scanned by the library of the town"
    rows = [(100 * b + k, f"b{b}", k, 0, None, stamp if k < 3 and b < 2 else f"text of page {'abcdefgh'[k]} in book {'abcdefgh'[b]}") for b in range(6) for k in range(6)]
    books = spark.createDataFrame([(f"b{b}", "src") for b in range(6)], "book_id string, source string")
    assert repeats.repeated_in_books(make_rows(rows), books).count() == 0
    rows += [(900 + b, f"b{b}", 9, 0, None, stamp.upper()) for b in range(2, 3)]
    assert sorted(r.item_id for r in repeats.repeated_in_books(make_rows(rows), books).collect()) == [0, 1, 2, 100, 101, 102, 902]


def test_clean_texts(make_docs):
    note = "this notice stands in all the texts"
    docs = make_docs([(i, f"{note}\nown {i}", "s") for i in range(5)] + [(9, None, "s"), (10, note, "s"), (11, f"{note}\nx", None)])
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert got[0] == "own 0" and got[9] is None and got[10] == "" and got[11] == f"{note}\nx"
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_clean_rows_of_books(spark, make_rows):
    from leafwork.llm.queries import QUERIES
    from leafwork.llm.repeats import rows_without_repeats

    assert "p2_clean_rows" in QUERIES
    rows = [(10 * b + k, f"b{b}", 1, k, [0, 0, 1, 1], t) for b in range(4) for k, t in enumerate(["Scanned by the library of texts", "own line of " + "abcd"[b] * 15, None, ""])]
    rows += [rows[1], (99, "lost", 1, 0, [0, 0, 1, 1], "Scanned by the library of texts")]
    books = spark.createDataFrame([(f"b{b}", "site") for b in range(4)], "book_id string, source string")
    got = sorted((r.line_id, r.text) for r in rows_without_repeats(make_rows(rows), books).collect())
    assert got == sorted({(r[0], r[5]) for r in rows if r[0] % 10 or r[0] == 99}, key=lambda x: x[0])


def test_texts_that_skip_the_explosion_are_their_own_form(spark):
    """Over all code points: where no explosion is asked for, the exploded form is the same."""
    from pyspark.sql import functions as F

    from leafwork.llm import looks

    chars = [chr(n) for n in range(1, 0x30000) if not 0xD800 <= n < 0xE000]
    texts = spark.createDataFrame([(ord(c), f"a{c}b") for c in chars], "n int, t string")
    plain = texts.filter(~looks.needs_explosion(F.col("t")))
    full = looks._joined(looks._rebuild(plain, ["n"], "t"), "__base")
    short = looks._joined(plain.select("n", F.col("t").alias("__base")), "__base").withColumnRenamed("__base", "quick")
    both = full.join(short, "n")
    assert both.count() == plain.count() > 20_000
    assert both.filter("__base <> quick").count() == 0


def test_words_of_one_form_by_distinct_words(spark):
    from leafwork.llm.looks import one_form, one_form_shared

    words = ["سلام", "ﺳﻼم", "cafe\u0301", "café", "ｗｉｄｅ", "wide", "", " x ", "豈"] * 3
    df = spark.createDataFrame(list(enumerate(words)), "k int, t string")
    a = {r.k: r.one_form for r in one_form(df, ["k"], "t").collect()}
    b = {r.k: r.one_form for r in one_form_shared(df, ["k"], "t").collect()}
    assert a == b and a[2] == a[3] and a[4] == a[5] and a[0] == a[1] and a[8] == "豈"


def test_groups_hold_all_pairs(spark, make_rows):
    from leafwork.llm import lookpairs

    line = "the very long line of a printed book that says little"
    odd = line.replace("e", "е")
    rows = make_rows([(i, "b", 1, i, None, line if i % 2 else odd) for i in range(40)] + [(90, "b", 1, 90, None, line.upper()), (91, None, 1, 91, None, odd)])
    old, lookpairs.PER_SALT = lookpairs.PER_SALT, 7
    try:
        pairs = {tuple(r) for r in lookpairs.look_alike_pairs(rows).collect()}
        members = lookpairs.group_members(lookpairs.look_alike_groups(rows)).collect()
    finally:
        lookpairs.PER_SALT = old
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 2}
    assert {r.line_id for r in members} == set(range(40)) and {r.first_line for r in members} == {0}


def test_joins_beyond_the_broadcast(spark):
    from leafwork.llm.repeats import join_keys

    lines = spark.createDataFrame([(s, k, i, 0) for i, (s, k) in enumerate([(1, 1)] * 50 + [(1, 2)] * 5 + [(2, 1)] * 3)], "src bigint, key bigint, item_id bigint, line_no int")
    keys = spark.createDataFrame([(1, 1), (2, 1), (9, 9)], "src bigint, key bigint")
    got = [sorted(r.item_id for r in join_keys(lines, keys, ["src", "key"], n).collect()) for n in (0, 100)]
    assert got[0] == got[1] and len(got[0]) == 53
