"""Noise in text from scanned pages (problem 1): page furniture, words broken over two rows, misread characters, and the
books' text as whole paragraphs.

Furniture: each book's column edges, text height and top of the text come from its rows; rows above the text or off the
column edges may be furniture. They are where their letters are repeated at the page edges of the book or source, up to
misread ones (sets of n-grams), where their number makes a sequence with those of other pages, and where they hold no
letter or digit. What is left above the text, or is taken for header or footer by the layout step off the edges, is told by
its place. Broken words: a row of text that ends in a word part and a sign of division, with the part that goes on in the
next row of text, perhaps on the next page with text; the division is undone by the corpus vocabulary. Misread characters:
a rare word that differs from a much more frequent one by a pair of characters which the whole corpus shows to be confused
again and again (less often a word read with low confidence), or that has digits among its letters.

Vocabulary, confusions and repetitions are counted over all rows. Book and source statistics are pre-aggregated, so that
a book or source of a third of all rows is no task of its own.

Defined cases: null and empty texts are no case of anything and add no text; rows delivered several times count once per
text, and their latest delivery is what the paragraphs take; null boxes are never off the edges; null books are one book
without a source; pages scanned a second time add no text to the paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.llm.looks import INVISIBLE, _tables, needs_explosion
from leafwork.operators.delivery import latest
from leafwork.operators.ordering import page_order
from leafwork.operators.sequences import last_known, running_sum
from leafwork.session import cut, small_enough

# Signs of division at the end of a row; characters that are read for digits in page numbers.
DIVISION = r"\x{2D}\x{2010}\x{2011}\x{AD}\x{AC}\x{3D}\x{640}"
READ_AS_DIGITS = "اوoOlIiSsZzBbgq|"
READS = dict(zip(READ_AS_DIGITS, "1500111552288991"))
# Letters read for others of another number.
DOUBLED = [("cl", "d"), ("vv", "w"), ("rn", "m"), ("m", "rn"), ("n", "ri")]

#: Times a word must be as frequent as the rare word that is taken for a misreading of it, and its least count.
RATIO = 20
LEAST_COUNT = 10
#: The same for the words that tell which characters are confused, and how often.
RATE_RATIO = 200
#: The same for a word with several misread characters.
SEVERAL_RATIO = 150
#: Confidence under which a word is unsure; a word that is unsure in half of its places needs less evidence: so many times its
#: count for the word it is taken for, and for the same with several misread characters.
UNSURE = 75
UNSURE_RATIO, UNSURE_SEVERAL = 3, 20
#: Share of all the evidence a pair of characters needs, and least number of different rare words, to be a confusion.
PAIR_SHARE = 0.002
PAIR_WORDS = 3
#: Share of the evidence from which a pair also counts in words with several misread characters.
CLASS_SHARE = 0.004
#: A part of an unknown word is broken off when it stands less than so many times as often as at row ends before a sign of
#: division, whatever the number of rows.
PART_TIMES = 50
#: N-grams of a row's sketch (those of the least hashes), their letters, and the share of them that must be repeated.
SKETCH, GRAM, REPEATED = 8, 4, 0.5
#: Pages of a book, and of a source, that a repetition needs; pages of a book whose numbers make a sequence.
BOOK_PAGES, SOURCE_PAGES, SEQUENCE_PAGES = 2, 3, 3
#: Letters of a word beyond which words meet by their halves.
LONG_WORD = 60
BROADCAST_ROWS = 500_000

BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HIDDEN = "".join(f"\\x{{{n:X}}}" for n in INVISIBLE if n not in (0xAD, 0x34F) and n < 0x10000)


def _hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def quick_form(text: Column) -> Column:
    """The one form of problem 3 for the comparison of words, by single characters and the commonest marks."""
    rows, compose, _ = _tables()
    parts: dict[int, str] = {}
    for n, _, part, _ in rows:
        parts[n] = parts.get(n, "") + part
    own = {chr(n): p for n, p in parts.items() if n < 0x10000 and len(p) == 1 and p != chr(n)} | {"ي": "ی", "ك": "ک", "ى": "ی"}
    gone = "".join(chr(n) for n in INVISIBLE if n < 0x10000)
    form = F.translate(text, "".join(own) + gone, "".join(own.values()))
    for pair, whole in compose:
        if whole in "éèêëàâîïôûùçÉÈÀÇآأإؤئۀ":
            form = F.replace(form, F.lit(pair), F.lit(whole))
    # most texts are in this form
    return F.when(needs_explosion(text) | text.contains("ي") | text.contains("ك") | text.contains("ى"), form).otherwise(text)


def laid_out(rows: DataFrame, books: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The rows that hold text: line_id, book_id, source, page_no, col_no, x0, y0, x1, y1, text, unsure (its words of low
    confidence) and guess (whether a layout of the page takes the row for its header or footer)."""
    src = rows.select(
        F.col("line_id").cast("bigint").alias("line_id"), F.coalesce(F.col("book_id").cast("string"), F.lit("")).alias("book_id"), F.col("page_no").cast("int").alias("page_no"), F.col("row_no").cast("int").alias("row_no"), F.coalesce(F.col("col_no").cast("int"), F.lit(0)).alias("col_no"),
        *[F.try_element_at("bbox", F.lit(i + 1)).cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("text").cast("string").alias("text"),
        F.transform(F.filter("words", lambda w: w["conf"] < UNSURE), lambda w: w["text"]).alias("unsure"),
    ).filter(F.col("text").rlike(r"\S"))
    own = books.select(F.col("book_id").cast("string").alias("book_id"), F.col("source").cast("string").alias("source")).filter("book_id IS NOT NULL").dropDuplicates(["book_id"])
    src = src.join(_hint(own), "book_id", "left")
    if layouts is None:
        return src.withColumn("guess", F.lit(False))
    sides = layouts.select(F.coalesce(F.col("book_id").cast("string"), F.lit("")).alias("book_id"), F.col("page_no").cast("int").alias("page_no"), F.explode(F.array("header.row_no", "footer.row_no")).alias("row_no")).filter("row_no IS NOT NULL").distinct()
    return src.join(_hint(sides.withColumn("guess", F.lit(True))), ["book_id", "page_no", "row_no"], "left").withColumn("guess", F.col("guess").isNotNull())


def book_shapes(rows: DataFrame) -> DataFrame:
    """book_id, col_no, edge, rtl, top, lh: the column edge that the rows keep to, the side it is on, the top of the text
    and the height of a row."""
    long = rows.filter("length(text) >= 12")
    modes = long.groupBy("book_id", "col_no").agg(F.mode("x0").alias("left"), F.mode("x1").alias("right"))
    modes = cut(modes)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 8
    at = long.join(_hint(modes), ["book_id", "col_no"])
    per = at.groupBy("book_id").agg(
        F.count_if(near("x0", "left")).alias("n_left"), F.count_if(near("x1", "right")).alias("n_right"), F.percentile_approx(F.when(near("x0", "left"), F.col("y0")), 0.02, 1000).alias("top_left"),
        F.percentile_approx(F.when(near("x1", "right"), F.col("y0")), 0.02, 1000).alias("top_right"), F.percentile_approx(F.col("y1") - F.col("y0"), 0.5, 1000).alias("lh"),
    )
    per = per.select("book_id", (F.col("n_right") > F.col("n_left")).alias("rtl"), F.when(F.col("n_right") > F.col("n_left"), F.col("top_right")).otherwise(F.col("top_left")).alias("top"), "lh")
    return modes.join(per, "book_id").select("book_id", "col_no", F.when(F.col("rtl"), F.col("right")).otherwise(F.col("left")).alias("edge"), "rtl", "top", "lh")


def with_furniture(rows: DataFrame) -> DataFrame:
    """The rows of laid_out with ``furniture`` and the shape of their book."""
    shapes = cut(book_shapes(rows))
    at = rows.join(_hint(shapes), ["book_id", "col_no"], "left")
    kept = F.abs(F.when(F.col("rtl"), F.col("x1")).otherwise(F.col("x0")) - F.col("edge")) <= 0.4 * F.col("lh")
    at = at.withColumn("off", F.coalesce(~kept, F.lit(False))).withColumn("above", F.coalesce(F.col("y1") <= F.col("top") + 0.2 * F.col("lh"), F.lit(False)))
    at = at.select("*", F.explode_outer(F.array(F.when(F.col("off") | F.col("above"), F.regexp_replace("text", r"[^\p{L}\p{Nd}]+", "")))).alias("core"))
    number = (F.length("core") <= 5) & (F.col("core").rlike(rf"^[\p{{Nd}}{READ_AS_DIGITS}]+$") | F.col("core").rlike(r"^\p{L}?\p{Nd}+\p{L}?$"))
    edge = at.filter("above OR off").select("line_id", "book_id", "source", "page_no", "off", "above", "guess", "core", number.alias("number"), F.lower(F.regexp_replace(quick_form(F.col("text")), r"[^\p{L}]+", "")).alias("w"))
    told = cut(told_furniture(cut(edge.distinct())))
    at = at.join(_hint(told.select(F.col("line_id").alias("told_id"), "furniture_by").dropDuplicates(["told_id"])), F.col("line_id") == F.col("told_id"), "left")
    return at.withColumn("furniture", F.col("furniture_by").isNotNull()).drop("told_id", "above", "core", "edge", "guess")


def told_furniture(edge: DataFrame) -> DataFrame:
    """line_id and furniture_by (repetition, sequence, speck, place) of the rows above the text or off the column edges that
    are furniture. Keys of a row: the first and last 8 letters, each enough where it is repeated, and its sketch."""
    strong = lambda of, c: F.struct(F.xxhash64(F.lit(of), c).alias("key"), F.lit(1.0).alias("weight"))
    grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - GRAM + 1), lambda i: F.xxhash64(F.substring("w", i, F.lit(GRAM))))))
    long = edge.filter("length(w) >= 6").select("line_id", "book_id", "source", "page_no", "above", "w", F.slice(grams, 1, SKETCH).alias("sketch"))
    sketch = F.transform("sketch", lambda h: F.struct(h.alias("key"), (1 / F.size("sketch")).alias("weight")))
    keys = cut(long.select("line_id", "book_id", "source", "page_no", "above", F.inline(F.concat(F.array(strong("^", F.left("w", F.lit(8))), strong("$", F.right("w", F.lit(8)))), sketch))))
    # counted by pages, and a book's keys only where one of them stands above its text
    in_book = keys.groupBy("book_id", "key").agg(F.count_distinct("page_no").alias("n"), F.max("above").alias("above")).filter(f"n >= {BOOK_PAGES} AND above").select(F.xxhash64("book_id", F.lit("b"), "key").alias("h"))
    in_source = keys.filter("source IS NOT NULL").groupBy("source", "key").agg(F.count_distinct("book_id", "page_no").alias("n")).filter(f"n >= {SOURCE_PAGES}").select(F.xxhash64("source", F.lit("s"), "key").alias("h"))
    asked = keys.select("line_id", "key", "weight", F.explode(F.array(F.xxhash64("book_id", F.lit("b"), "key"), F.xxhash64("source", F.lit("s"), "key"))).alias("h"))
    hits = asked.join(_hint(cut(in_book.unionByName(in_source))), "h", "left_semi").select("line_id", "key", "weight").distinct()
    repeated = hits.groupBy("line_id").agg(F.sum("weight").alias("weight")).filter(f"weight >= {REPEATED} - 1e-9").select("line_id", F.lit("repetition").alias("by"))

    # a number less (scanned backwards: plus) its page is the same all through a sequence
    digits = "".join(chr(z + d) for z in (0x6F0, 0x660) for d in range(10))
    value = F.translate("core", digits + READ_AS_DIGITS, "0123456789" * 2 + "".join(READS[c] for c in READ_AS_DIGITS)).try_cast("int")
    numbers = edge.filter("number").select("line_id", "book_id", "page_no", value.alias("v")).filter("v IS NOT NULL")
    numbers = numbers.select("line_id", "book_id", "page_no", F.explode(F.array(F.struct(F.lit(-1).alias("way"), (F.col("v") - F.col("page_no")).alias("x")), F.struct(F.lit(1).alias("way"), (F.col("v") + F.col("page_no")).alias("x")))).alias("run"))
    in_run = numbers.groupBy("book_id", "run").agg(F.count_distinct("page_no").alias("n")).filter(f"n >= {SEQUENCE_PAGES}").select("book_id", "run")
    sequence = numbers.join(_hint(in_run), ["book_id", "run"], "left_semi").select("line_id", F.lit("sequence").alias("by"))

    short = F.length("core") <= 1
    rest = edge.select("line_id", F.when(F.col("off") & short, F.lit("speck")).when(F.col("above") | (F.col("off") & (F.col("number") | F.col("guess"))), F.lit("place")).alias("by")).filter("by IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(x) for x in ("repetition", "sequence", "speck", "place")]), F.col("by"))
    # a repeated row keeps to the column edges only above the text
    return repeated.unionByName(sequence).unionByName(rest).groupBy("line_id").agg(F.min_by("by", order).alias("furniture_by"))


_ENDS_BROKEN = rf"([\p{{L}}\p{{M}}\x{{200C}}]*\p{{L}}[\p{{M}}\x{{200C}}]*)[{_HIDDEN}]*\s?[{DIVISION}]$"


def broken_part(text: Column) -> Column:
    """The part of a word that a row ends in before a sign of division, else null."""
    end = F.rtrim(text, F.lit(BLANKS + "".join(chr(n) for n in INVISIBLE if n not in (0xAD, 0x34F) and n < 0x10000)))
    return F.when(F.right(end, F.lit(1)).rlike(f"[{DIVISION}]"), F.nullif(F.regexp_extract(end, _ENDS_BROKEN, 1), F.lit("")))


def words_of(form: Column) -> Column:
    """Words of a text in quick_form: letters, marks and joiners, lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(form), r"[^\p{L}\p{M}\x{200C}]+", " "), " "), lambda w: w != "")


def vocabulary(rows: DataFrame) -> DataFrame:
    """word, n and n_unsure of all words of the rows that are text: how often they stand, and how often with low confidence; the
    parts of broken words are words of their own."""
    text = rows.filter("NOT furniture")
    seen = text.select(F.explode_outer(words_of(quick_form(F.col("text")))).alias("word"), F.lit(0).alias("low"))
    if "unsure" not in rows.columns:
        text = text.withColumn("unsure", F.array().cast("array<string>"))
    low = text.select(F.explode("unsure").alias("w")).filter("w IS NOT NULL").select(F.explode(words_of(quick_form(F.col("w")))).alias("word"), F.lit(1).alias("low"))
    both = seen.filter("word IS NOT NULL").unionByName(low).groupBy("word").agg(F.count_if(F.col("low") == 0).alias("n"), F.sum("low").alias("n_unsure"))
    return both.filter("n > 0")


def page_sequence(rows: DataFrame) -> DataFrame:
    """book_id, page_no and next_page, the next page of the book with text (null after the last)."""
    pages = rows.filter("NOT furniture").select("book_id", "page_no").distinct().withColumn("own", F.col("page_no"))
    return last_known(cut(pages), ["book_id"], "page_no", "own", "next_page", back=True, strictly=True).drop("own")


def broken_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """line_id, head, tail, whole of each broken word: the part at the end of the row, the part in the next row of text,
    and whether the vocabulary knows them joined. A part whose join is unknown, and that is a word which mostly
    stands elsewhere, isn't broken off."""
    parts = rows.filter("NOT furniture").select("line_id", "book_id", "page_no", "col_no", "y0", broken_part(F.col("text")).alias("head")).filter("head IS NOT NULL").distinct()
    parts = cut(parts.join(_hint(cut(page_sequence(rows))), ["book_id", "page_no"], "left"))
    wanted = parts.select("line_id", "book_id", F.explode(F.array("page_no", "next_page")).alias("page_no"), F.struct("page_no", "col_no", "y0").alias("after")).filter("page_no IS NOT NULL")
    text = rows.filter("NOT furniture").select("book_id", "page_no", F.struct("page_no", "col_no", "y0").alias("at"), "text")
    following = text.join(_hint(wanted), ["book_id", "page_no"]).filter("at > after").groupBy("line_id").agg(F.min_by("text", "at").alias("text"))
    following = following.select("line_id", F.regexp_extract(quick_form(F.col("text")), r"^[^\p{L}]*([\p{L}\p{M}\x{200C}]+)", 1).alias("tail"))
    got = parts.select("line_id", F.lower(F.replace(quick_form(F.col("head")), F.lit("ـ"), F.lit(""))).alias("head")).join(following, "line_id", "left").withColumn("whole", F.concat("head", F.lower("tail")))
    known = words.filter("n >= 2").select("word", "n")
    got = got.join(known.withColumnsRenamed({"word": "whole", "n": "n_whole"}), "whole", "left").join(words.select(F.col("word").alias("head"), F.col("n").alias("n_head")), "head", "left")
    at_ends = got.groupBy("head").agg(F.count_distinct("line_id").alias("n_ends"))
    got = got.join(at_ends, "head", "left")
    return got.filter(f"n_whole IS NOT NULL OR coalesce(n_head, 0) < {PART_TIMES} * n_ends").select("line_id", "head", F.lower("tail").alias("tail"), (F.col("n_whole").isNotNull()).alias("known")).distinct()


def _enough(ratio: int, unsure_ratio: int) -> str:
    """Whether the word meant is frequent enough, as a condition on n, m and unsure."""
    return f"(m >= {ratio} * n OR (unsure AND m >= {unsure_ratio} * n))"


def _long_pairs(words: DataFrame) -> DataFrame:
    """As the pairs of misread_words for long words, whose places would be many: of two words with one other character, one
    half is the same."""
    half = F.floor(F.length("word") / 2).cast("int")
    keys = words.select("word", "n", "unsure", F.explode(F.array(F.xxhash64(F.lit(1), F.length("word"), F.left("word", half)), F.xxhash64(F.lit(2), F.length("word"), F.substring("word", half + 1, F.length("word"))))).alias("key"))
    often = keys.filter(f"n >= {LEAST_COUNT}").select("key", F.col("word").alias("meant"), F.col("n").alias("m"))
    both = keys.join(often, "key").filter(f"word <> meant AND length(word) = length(meant) AND {_enough(RATIO, UNSURE_RATIO)}").drop("key").distinct()
    apart = F.filter(F.zip_with(F.split("word", ""), F.split("meant", ""), lambda a, b: F.struct(a.alias("ch"), b.alias("right"))), lambda x: x["ch"] != x["right"])
    return both.withColumn("apart", apart).filter("size(apart) = 1").select("word", "n", "unsure", F.col("apart")[0]["ch"].alias("ch"), "meant", F.col("apart")[0]["right"].alias("right"), "m")


def misread_words(words: DataFrame) -> DataFrame:
    """word and meant: rare words and the frequent words they were misread from. ``words``: word, n, n_unsure. Words meet through
    their places: a word less one of its characters, with the place, is a key shared by at most as many words as there are
    characters."""
    unsure = F.col("n_unsure") * 2 >= F.col("n") if "n_unsure" in words.columns else F.lit(False)
    words = words.filter("length(word) >= 2").select("word", "n", unsure.alias("unsure"))
    doubled = None
    for two, one in DOUBLED:
        w = words.filter(F.col("word").contains(two)).select("word", "n", "unsure", F.regexp_replace("word", two, one).alias("meant"))
        doubled = w if doubled is None else doubled.unionByName(w)
    frequent = words.filter(f"n >= {LEAST_COUNT}")
    doubled = doubled.join(frequent.select(F.col("word").alias("meant"), F.col("n").alias("m")), "meant").filter(_enough(RATIO, UNSURE_RATIO)).select("word", "meant")

    spots = words.filter(f"length(word) BETWEEN 3 AND {LONG_WORD}").select("word", "n", "unsure", F.posexplode(F.split("word", "")).alias("i", "ch"))
    spots = spots.select("word", "n", "unsure", "ch", F.xxhash64("i", F.concat(F.expr("left(word, i)"), F.lit("\0"), F.expr("substring(word, i + 2)"))).alias("key"))
    rare, often = spots, spots.filter(f"n >= {LEAST_COUNT}").select("key", F.col("word").alias("meant"), F.col("n").alias("m"), F.col("ch").alias("right"))
    pairs = rare.join(often, "key").filter(f"ch <> right AND {_enough(RATIO, UNSURE_RATIO)}").select("word", "n", "unsure", "ch", "meant", "right", "m")
    pairs = cut(pairs.unionByName(_long_pairs(words.filter(f"length(word) > {LONG_WORD}"))))
    # one row per pair of characters, whatever the number of rows; a letter less its mark is another letter, as it looks different
    evidence = pairs.filter(f"length(word) >= 4 AND m >= {RATE_RATIO} * n").groupBy("right", "ch").agg(F.count_distinct("word").alias("k"), F.sum("n").alias("n"))
    # how often the right character stands in frequent words, for the rate at which it is misread
    stands = frequent.select(F.explode(F.split("word", "")).alias("right"), "n").groupBy("right").agg(F.sum("n").alias("all"))
    found = [(r.right, r.ch, r.k, r.n, r["all"]) for r in evidence.filter(f"k >= {PAIR_WORDS}").join(stands, "right").collect()]
    total = sum(x[3] for x in found)
    found = [(a, b, n, n / every) for a, b, k, n, every in found if n >= PAIR_SHARE * total]
    confused = words.sparkSession.createDataFrame([(a, b, rate) for a, b, _, rate in found], "right string, ch string, rate double")
    # a word much more frequent than its misreading would be is a word of its own
    told = pairs.join(F.broadcast(confused), ["right", "ch"]).filter("unsure OR n <= 3 + 4 * m * rate").groupBy("word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))

    # words with several misread characters: equal when each character stands for its class
    leader: dict[str, str] = {}

    def lead(c: str) -> str:
        while leader.get(c, c) != c:
            c = leader[c]
        return c

    for a, b, n, _ in found:
        if n >= CLASS_SHARE * total:
            leader[lead(b)] = lead(a)
    chars = sorted({c for a, b, *_ in found for c in (a, b)})
    shape = F.translate("word", "".join(chars), "".join(lead(c) for c in chars)) if chars else F.col("word")
    shaped = words.filter("length(word) >= 5").withColumn("shape", shape)
    best = shaped.filter(f"n >= {LEAST_COUNT}").groupBy("shape").agg(F.max(F.struct(F.col("n").alias("m"), F.col("word").alias("meant"))).alias("best")).select("shape", "best.*")
    known = F.array(*[F.lit(a + b) for a, b, *_ in found]) if found else F.array().cast("array<string>")
    each = F.zip_with(F.split("meant", ""), F.split("word", ""), lambda a, b: F.when(a != b, F.concat(a, b)))
    several = shaped.join(best, "shape").filter(f"meant <> word AND {_enough(SEVERAL_RATIO, UNSURE_SEVERAL)} AND (unsure OR n <= 2 + m / 5000)").withColumn("each", F.filter(each, lambda x: x.isNotNull()))
    several = several.filter((F.size("each") <= 4) & (F.size(F.array_except("each", known)) == 0)).select("word", "meant")
    every = told.withColumn("way", F.lit(0)).unionByName(doubled.withColumn("way", F.lit(1))).unionByName(several.withColumn("way", F.lit(2)))
    return every.groupBy("word").agg(F.min_by("meant", F.struct("way", "meant")).alias("meant"))


#: Latin letters and digits in one word, which printed words don't mix.
DIGIT_IN_WORD = r"[A-Za-zÀ-ɏ][0-9]+[A-Za-zÀ-ɏ]|(?<![\p{L}\p{Nd}.,/\-])[0-9][A-Za-zÀ-ɏ]{2,}|[A-Za-zÀ-ɏ]{2,}[0-9](?![\p{L}\p{Nd}])"


def misread_rows(rows: DataFrame, wrong: DataFrame) -> DataFrame:
    """line_id of the rows of text with a misread word."""
    text = rows.filter("NOT furniture").select("line_id", quick_form(F.col("text")).alias("form"))
    by_word = text.select("line_id", F.explode(words_of(F.col("form"))).alias("word")).join(_hint(wrong.select("word")), "word", "left_semi").select("line_id")
    return by_word.unionByName(text.filter(F.col("form").rlike(DIGIT_IN_WORD)).select("line_id")).distinct()


def scan_defects(rows: DataFrame, books: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """line_id and defect (furniture, split, misread)."""
    at = cut(with_furniture(laid_out(rows, books, layouts)).select("line_id", "book_id", "page_no", "col_no", "x0", "y0", "x1", "rtl", "lh", "text", "unsure", "furniture"))
    words = cut(vocabulary(at))
    wrong = cut(misread_words(words))
    named = lambda df, name: df.select("line_id", F.lit(name).alias("defect"))
    out = named(at.filter("furniture"), "furniture").unionByName(named(broken_words(at, words), "split")).unionByName(named(misread_rows(at, wrong), "misread"))
    return out.filter("line_id IS NOT NULL").distinct()


def repairs(rows: DataFrame, wrong: DataFrame) -> DataFrame:
    """line_id, was and now: the misread words of each row of text by their places, and the words that were meant, in their
    case. One row per row with a misread word."""
    text = rows.filter("NOT furniture").select("line_id", "text")
    # most rows hold none
    hit = text.select("line_id", F.explode_outer(words_of(quick_form(F.col("text")))).alias("word")).join(_hint(wrong.select("word")), "word", "left_semi").select("line_id").distinct()
    pieces = text.join(_hint(cut(hit)), "line_id", "left_semi").select("line_id", F.posexplode_outer(F.split("text", r"\s+")).alias("i", "piece"))
    pieces = pieces.select("line_id", "i", F.explode_outer(F.array(F.regexp_extract("piece", r"[\p{L}\p{M}\x{200C}]+", 0))).alias("bare")).withColumn("word", F.lower(quick_form(F.col("bare"))))
    hit = pieces.join(_hint(wrong), "word").select("line_id", "i", F.when(F.initcap("bare") == F.col("bare"), F.initcap("meant")).otherwise(F.col("meant")).alias("meant"), "bare")
    return hit.groupBy("line_id").agg(F.map_from_entries(F.collect_set(F.struct("i", "bare"))).alias("was"), F.map_from_entries(F.collect_set(F.struct("i", "meant"))).alias("now"))


def latest_rows(rows: DataFrame) -> DataFrame:
    """rows with the latest delivery of each line_id only; only rows delivered more than once are ranked."""
    many = rows.filter("line_id IS NOT NULL").groupBy("line_id").agg(F.count("*").alias("n")).filter("n > 1").select("line_id", F.lit(True).alias("again"))
    at = rows.join(_hint(cut(many)), "line_id", "left")
    return at.filter("again IS NULL").unionByName(latest(at.filter("again"), ["line_id"], "loaded_at", F.col("text"))).drop("again")


#: Share of a column's width that the last row of a paragraph leaves free, at least.
SHORT = 0.12


def book_paragraphs(rows: DataFrame, books: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """book_id, para_no, page_no (where it begins) and text of the paragraphs of each book: pages by their printed numbers
    without second scans (without layouts: in the order of the file), no furniture, misread words repaired, words broken over
    rows joined. A paragraph ends with a row that leaves its column free, and goes on over the end of a page or column
    otherwise."""
    last = latest_rows(rows)
    at = laid_out(last, books, layouts)
    if layouts is None:
        at = at.withColumn("sort_key", F.lit(None).cast("double"))
    else:
        placed = page_order(layouts, last).withColumn("book_id", F.coalesce("book_id", F.lit("")))
        placed = _hint(cut(placed.select("book_id", "page_no", "sort_key", (F.col("status") == "second_scan").alias("again")).dropDuplicates(["book_id", "page_no"])))
        at = at.join(placed, ["book_id", "page_no"], "left").filter("again IS NULL OR NOT again").drop("again")
    at = cut(with_furniture(at))
    # pages in order, one row each: those without a layout stand where the file has them
    pages = at.filter("NOT furniture").groupBy("book_id", "page_no").agg(F.first("sort_key").alias("sort_key")).withColumn("sort_key", F.coalesce("sort_key", F.col("page_no").cast("double")))
    by_book = W.partitionBy("book_id").orderBy("sort_key", "page_no")
    pages = cut(pages.withColumn("seq", F.row_number().over(by_book)))
    at = cut(at.drop("sort_key").join(_hint(pages.select("book_id", "page_no", "seq")), ["book_id", "page_no"], "left").withColumn("page", F.col("page_no")).withColumn("page_no", F.coalesce("seq", F.lit(0))))
    words = cut(vocabulary(at))
    wrong = cut(misread_words(words))
    heads = broken_words(at, words).select("line_id", F.lit(True).alias("broken")).distinct()
    marks = cut(repairs(at, wrong).join(heads, "line_id", "full"))
    again = F.array_join(F.transform(F.split("text", r"\s+"), lambda p, i: F.when(F.try_element_at("was", i).isNotNull(), F.replace(p, F.try_element_at("was", i), F.try_element_at("now", i))).otherwise(p)), " ")
    text = at.filter("NOT furniture").join(_hint(marks), "line_id", "left").withColumn("text", F.when(F.col("was").isNotNull(), again).otherwise(F.col("text"))).drop("was", "now")
    free = F.when(F.col("rtl"), F.col("x0")).otherwise(-F.col("x1"))
    far = _hint(cut(text.filter("length(text) >= 12").groupBy("book_id", "col_no").agg(F.percentile_approx(free, 0.1).alias("far"), F.mode(F.when(F.col("rtl"), F.col("x1")).otherwise(-F.col("x0"))).alias("near"))))
    text = text.join(far, ["book_id", "col_no"], "left").withColumn("short", F.coalesce(free - F.col("far") > SHORT * (F.col("near") - F.col("far")), F.lit(True)))
    clean = F.trim(F.regexp_replace("text", rf"[\s{_HIDDEN}]+", " "))
    piece = F.when(F.col("broken"), F.regexp_replace(clean, rf"\s?[{DIVISION}]\s*$", "")).otherwise(F.concat(clean, F.lit(" ")))
    # the one shuffle of all texts: rows to their page, where they become pieces of paragraphs
    page = W.partitionBy("book_id", "page_no").orderBy("col_no", "y0", "line_id")
    text = text.withColumn("k", F.row_number().over(page)).withColumn("starts", F.coalesce(F.lag("short").over(page), F.lit(False)).cast("int")).withColumn("part", F.sum("starts").over(page))
    parts = text.groupBy("book_id", "page_no", "part").agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"), F.max_by("short", "k").alias("closed"))
    parts = cut(parts)
    ends = parts.groupBy("book_id", "page_no").agg(F.max("part").alias("last"), F.max_by("closed", "part").alias("closed"))
    before = ends.select("book_id", (F.col("page_no") + 1).alias("page_no"), F.col("closed").alias("done"))
    ends = ends.join(before, ["book_id", "page_no"], "left").withColumn("opens", F.coalesce("done", F.lit(True)).cast("int")).withColumn("n", F.col("last") + F.col("opens"))
    ends = running_sum(cut(ends), ["book_id"], "page_no", "n", "upto")
    ends = _hint(cut(ends.select("book_id", "page_no", "last", "opens", (F.col("upto") - F.col("n") + F.col("opens")).alias("first"), F.col("closed").alias("page_closed"))))
    placed = parts.join(ends, ["book_id", "page_no"]).withColumn("para_no", F.col("first") + F.col("part"))
    # only what goes on over the end of a page meets again
    over = ((F.col("part") == 0) & (F.col("opens") == 0)) | ((F.col("part") == F.col("last")) & ~F.col("page_closed"))
    whole = placed.filter(~over).select("book_id", "para_no", F.col("page").alias("page_no"), "text")
    joined = placed.filter(over).groupBy("book_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "part", "page", "text"))).alias("rows"))
    joined = joined.select("book_id", "para_no", F.col("rows")[0]["page"].alias("page_no"), F.array_join(F.transform("rows", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined).withColumn("text", F.trim("text"))
