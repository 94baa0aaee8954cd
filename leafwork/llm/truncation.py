"""Texts cut off by a limit or in transfer (problem 8), by the counts of final n-grams inside texts and at ends, in SQL.

A text's end is told apart: the site's own repeated lines (problem 2) are taken off from the end upwards, then a mark put
after the cut. Where the rest has no end mark, its last three words are looked up in counts over all places of all texts:
how often they stand there and how often a sentence (or a line that stands alone) ends with them. Most trigrams of a text
stand nowhere else, so the counts back off to two words and to one; the longest n-gram seen often enough decides: frequent
inside but almost never at an end means cut. What else speaks for a cut (the source's texts pile up at this length, a
comma before the mark) moves the share of ends that is asked for, and decides alone only where no n-gram is known. A last
word that is rare but begins more frequent words was cut within. Scripts without blanks count characters, two for each
word. A full stop after an abbreviation that never ends a paragraph is no end mark.

Defined cases: null, empty and blank texts aren't cut; a null source is a source of its own in the report; copies of a
text get the same answer; a text of nothing but its site's lines has no end of its own and isn't cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.llm.repeats import keyed_lines, once, repeated_keys
from leafwork.session import cut, small_enough

# Marks that end sentences; what sources put after a cut; blanks and characters that show nothing.
END_MARKS = "!?؟۔。！？"
CUT_MARK = r"[\s、，،,;؛]*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|…+|\.{2,}|\x{FFFD}+)\s*$"
HARD_MARK = r"(?:[\[(]\s*(?:\.{2,}|…)\s*[\])]|\x{FFFD})\s*$"
PAUSED_MARK = r"[،,;؛:、，；：]\s*(?:\.{2,}|…+)\s*$"
CLOSERS = r"[\"'»”’)\]」』）】\s]*"
CHARS = r"\x{E00}-\x{E7F}\x{3040}-\x{9FFF}"
BLANKS = " \t\n\r\x0b\x0c\x85\xa0                　​‎‏⁠﻿"

#: Least number of times an n-gram of one, two, three words must have been seen to decide, and the share of ends under
#: which it is taken for cut. A quarter of the fitting n-grams end a sentence, so ten without an end are no chance; names
#: end headings more rarely, so single words need more.
LEAST_SEEN = (100, 10, 10)
END_SHARE = (0.015, 0.04, 0.04)
#: The same share where the source's limit or a comma before the mark speaks for a cut.
LIKELY_SHARE = 0.5
#: A single word seen so often and ending so rarely decides before longer n-grams.
NEVER_LAST = (200, 0.005)
#: A rare last word was cut within where the longer words it begins are so many times as frequent.
PREFIX_TIMES = 8
#: Share of a source's texts that the site's own lines stand in.
SITE_SHARE = 0.02
#: Lines at a text's end looked at first; where all of them are the site's, so many times as many are.
TAIL_LINES = 4
#: Times an abbreviation must have been seen with its full stop.
LEAST_DOTTED = 20
#: A limit is a pile-up of lengths in a window as wide as a word (the last of LIMIT_WIDTHS): at least so many texts more
#: than so many times the mean of the four windows below it, with at most so large a part of them above it. The pile is as
#: wide as the narrowest width that holds most of it.
LIMIT_LEAST = 5
LIMIT_TIMES = 3
LIMIT_ABOVE = 0.25
LIMIT_WIDTHS = (1, 4, 20)
LIMIT_PILE = 0.8
#: Tables of numbers are broadcast up to so many rows (16 bytes each), words up to a tenth of it.
BROADCAST_ROWS = 500_000


def _hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def _tails(documents: DataFrame, begin: int, stop: int) -> DataFrame:
    """doc_id, source, printed, full_chars, full_bytes, tail of each text that isn't blank. ``tail`` holds its lines from the last but ``stop`` to the
    last but ``begin`` that aren't blank, the last one first: the line, the blanks before it, and the characters and bytes
    of the text from its start to the line's end."""
    src = documents.select("doc_id", "source", "printed", F.length("text").alias("full_chars"), F.octet_length("text").alias("full_bytes"), once(F.rtrim(F.col("text"), F.lit(BLANKS)), "text")).filter("text <> ''")
    src = src.select("*", once(F.split("text", "\n", -1), "all"))
    src = src.select("*", once(F.filter(F.transform("all", lambda x, i: F.when(F.trim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull()), "full"))
    size = F.size("full")
    # one line more, which goes before the last of them
    at = F.transform(F.sequence(F.lit(begin), F.least(F.lit(stop), size - 1)), lambda k: F.get("full", size - 1 - k))
    rest = lambda i: F.concat(F.when(i + 1 < F.size("all"), "\n").otherwise(""), F.array_join(F.slice("all", i + 2, F.size("all")), "\n"))
    gap = lambda i: (i > 0) & (F.trim(F.get("all", i - 1), F.lit(BLANKS)) == "")
    each = lambda i: F.struct(F.get("all", i).alias("line"), F.coalesce(gap(i), F.lit(False)).alias("apart"), (F.length("text") - F.length(rest(i))).alias("n_chars"), (F.octet_length("text") - F.octet_length(rest(i))).alias("n_bytes"))
    return src.filter(size > begin).select("doc_id", "source", "printed", "full_chars", "full_bytes", F.transform(at, each).alias("tail"))


def _ends(documents: DataFrame) -> DataFrame:
    """doc_id, source, printed, before, apart, line, n_chars, n_bytes, all_chars and all_bytes of every text with an end of its
    own: its last line that isn't the site's and the line before it, with the text's length up to the line, and with the
    blanks after it. A site's line is one of
    problem 2 that stands among the last lines of its source's texts; as many lines are looked at as it takes."""
    begin, stop = 0, TAIL_LINES
    counted = documents.filter("source IS NOT NULL").groupBy(F.xxhash64("source").alias("src")).agg(F.count("*").alias("n_texts"))
    open_docs, parts, keyed = documents, [], None
    while True:
        part = cut(_tails(open_docs, begin, stop))
        parts.append((begin, stop, part))
        lines = part.filter("source IS NOT NULL").select("source", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("item_id"), F.posexplode(F.slice("tail", 1, stop - begin)).alias("k", "x"))
        lines = keyed_lines(lines.select("source", "text_id", "item_id", (F.col("k") + begin).alias("line_no"), F.col("x.line").alias("line")))
        keyed = lines if keyed is None else keyed.unionByName(lines)
        own = _hint(cut(repeated_keys(keyed, counted, SITE_SHARE)))
        gone = keyed.join(own, ["src", "key"], "left_semi").groupBy(F.col("item_id").alias("doc_id")).agg(F.collect_set("line_no").alias("gone"))
        # lines at the end that are the site's without one between
        run = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(stop)), "gone"))
        runs = cut(gone.select("doc_id", run.alias("run")).filter("run > 0"))
        wide = part.filter(F.size("tail") > stop - begin).select("doc_id")
        more = cut(runs.filter(F.col("run") == stop).join(wide, "doc_id", "left_semi"))
        if more.isEmpty():
            break
        open_docs, begin, stop = documents.join(_hint(more.select("doc_id")), "doc_id", "left_semi"), stop, stop * TAIL_LINES
    out, runs = None, _hint(runs)
    for begin, stop, part in parts:
        at = part.join(runs, "doc_id", "left").withColumn("run", F.coalesce("run", F.lit(0))).filter((F.col("run") >= begin) & (F.col("run") < stop))
        x, b = F.get("tail", F.col("run") - begin), F.get("tail", F.col("run") - begin + 1)
        at = at.select("doc_id", "source", "printed", b["line"].alias("before"), x["apart"].alias("apart"), x["line"].alias("line"), x["n_chars"].alias("n_chars"), x["n_bytes"].alias("n_bytes"), *[F.when(F.col("run") == 0, F.col(f"full_{c}")).otherwise(x[f"n_{c}"]).alias(f"all_{c}") for c in ("chars", "bytes")])
        out = at if out is None else out.unionByName(at)
    return out.filter("line IS NOT NULL")


def _tokens(text: str, printed: str) -> Column:
    """The words of a text and, between them, its end marks, full stops, ends of paragraphs and blanks between Thai letters.
    A number is the empty word; characters of scripts without blanks are words."""
    marks = rf"(?:\.{{3}}|[…{END_MARKS}])+|\.(?=[\"'»”’)\]]*(?:\s|$))"
    plain = r"[\p{L}\p{M}\x{200C}]+"
    chars = rf"[{CHARS}&&[\p{{L}}\p{{M}}]]|[\p{{L}}\p{{M}}\x{{200C}}&&[^{CHARS}]]+|(?<=[\x{{E00}}-\x{{E7F}}]) +(?=[\x{{E00}}-\x{{E7F}}])"
    of = lambda word, end: F.regexp_extract_all(text, F.lit(rf"({word}|{end}|{marks})|\p{{Nd}}+"), F.lit(1))
    by = lambda end: F.when(F.col(text).rlike(f"[{CHARS}]"), of(chars, end)).otherwise(of(plain, end))
    return F.when(F.col(printed), by(r"\n[^\S\n]*\n\s*")).otherwise(by(r"\n"))


STOPS = [*END_MARKS, "…", ".", "\n", " "]


def _by_char(c: str) -> Column:
    """Whether a word is a character of a script without blanks, by code points, which order as their bytes do."""
    return ((F.col(c) >= "\u0e00") & (F.col(c) < "\u0e80")) | ((F.col(c) >= "\u3040") & (F.col(c) < "\ua000"))


def _gram(p: str, i: Column, n: int) -> Column:
    """Hash of the ``n`` words that end at ``i``."""
    return F.xxhash64(F.lit(n), *[F.get(p, i + d) for d in range(1 - n, 1)])


def _is_word(c: str) -> Column:
    return ~F.left(c, F.lit(1)).isin(STOPS)


def _limits(own: DataFrame) -> DataFrame:
    """source, kind (n_chars or n_pairs), limit and wide: the length in characters or pairs of bytes at whose lower side the
    source's texts pile up, and the width of the pile; of both kinds the one with more texts."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("size")) for k in ("n_chars", "n_pairs")]))
    sizes = own.filter("source IS NOT NULL").select("source", each).groupBy("source", "kind", "size").agg(F.count("*").alias("n"))
    # one row per source and length, whatever the number of texts
    by = W.partitionBy("source", "kind").orderBy("size")
    near = lambda a, b: F.coalesce(F.sum("n").over(by.rangeBetween(a, b)), F.lit(0))
    most = LIMIT_WIDTHS[-1]
    held = sizes.select("source", "kind", "size", *[near(1 - k, 0).alias(f"in{k}") for k in LIMIT_WIDTHS], (near(1 - 5 * most, -most) / 4).alias("below"), near(1, W.unboundedFollowing).alias("above"))
    held = held.filter((F.col(f"in{most}") >= LIMIT_LEAST + LIMIT_TIMES * F.col("below")) & (F.col("above") <= LIMIT_ABOVE * F.col(f"in{most}")))
    excess = lambda k: F.col(f"in{k}") - F.col("below") * k / most
    wide = F.coalesce(*[F.when(excess(k) >= LIMIT_PILE * excess(most), F.lit(k)) for k in LIMIT_WIDTHS])
    held = held.groupBy("source").agg(F.max(F.struct(F.col(f"in{most}").alias("n"), (F.col("kind") == "n_chars").alias("chars"), "in1", F.col("size").alias("limit"), wide.alias("wide"), "kind")).alias("top"))
    return held.select("source", "top.kind", "top.limit", "top.wide")


def _own(documents: DataFrame) -> DataFrame:
    """doc_id, source, text and whether its lines are printed lines."""
    kind = F.coalesce(F.col("line_kind").cast("string"), F.lit(""))
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), ((kind == "printed_lines") | ((kind != "paragraphs") & text.contains("\n\n"))).alias("printed"), text.alias("text")).filter("text IS NOT NULL")


def _told(own: DataFrame) -> DataFrame:
    """The ends of the texts with their length without a mark of the cut, what speaks for a cut and, where in doubt, the words at the end."""
    at = _ends(own).select("*", once(F.rtrim("line", F.lit(BLANKS)), "end"))
    # the end without the mark of a cut, where one of its signs stands last
    at = at.select("*", once(F.right("end", F.lit(1)).isin("…", "]", ")", "\ufffd") | F.endswith("end", F.lit("..")), "signed"))
    at = at.select("*", once(F.when(F.col("signed"), F.regexp_replace("end", CUT_MARK, "")).otherwise(F.col("end")), "rest"))
    lost = lambda of: of("line") - of("rest")
    mark = lambda of: F.col("signed") & F.col("end").rlike(of)
    at = at.select(
        "doc_id", "source", "printed", (F.col("n_chars") - lost(F.length)).alias("n_chars"), F.floor((F.col("n_bytes") - lost(F.octet_length)) / 2).alias("n_pairs"), "all_chars", F.ceil(F.col("all_bytes") / 2).alias("all_pairs"), "before", "apart", "rest",
        F.inline_outer(F.array(F.struct(mark(HARD_MARK).alias("hard"), mark(PAUSED_MARK).alias("paused"), F.col("rest").rlike(rf"[{END_MARKS}]{CLOSERS}$").alias("ended"), F.col("rest").rlike(rf"\.{CLOSERS}$").alias("dotted")))),
    ).withColumn("doubt", ~F.col("ended") & ~(F.col("hard") & ~F.col("dotted")))
    bare = F.regexp_replace("rest", r"[^\p{L}\p{M}\p{N}\x{200C}]+$", "")
    words = F.when(F.col("doubt"), F.concat(F.coalesce(F.concat("before", F.when(F.col("apart"), "\n\n").otherwise("\n")), F.lit("")), bare))
    return at.select("*", once(words, "words")).withColumn("p", _tokens("words", "printed")).drop("words", "before", "apart", "rest")


def ends(documents: DataFrame) -> DataFrame:
    """doc_id, source, is_cut, decided_by (mark, three_words, two_words, one_word, never_last, abbreviation, within_word, limit; null
    where nothing speaks for a cut) of every text with an end of its own."""
    own = _own(documents)
    told = cut(_told(own))
    end = F.size("p") - 1
    last = told.filter("doubt").withColumn("last", F.get("p", end)).filter(_is_word("last")).withColumn("by_char", _by_char("last"))
    last = last.select("doc_id", "dotted", "last", "by_char", *[F.when(F.col("by_char"), _gram("p", end, 2 * k)).when(F.lit(k > 1), _gram("p", end, k)).alias(f"g{k}") for k in (1, 2, 3)])
    last = cut(last)

    # n-grams that texts in doubt end in; places are told by the shortest of them, two words or two characters
    first = cut(last.select(F.when(F.col("by_char"), F.col("g1")).otherwise(F.col("g2")).alias("two")).distinct())
    wanted = cut(last.select(F.explode(F.array(F.when(F.col("by_char"), F.col("g1")), "g2", "g3")).alias("g")).filter("g IS NOT NULL").distinct())
    small = small_enough(wanted, BROADCAST_ROWS)

    # one pass over all places: words, how often they stand, stand before an end, before a full stop, before one that ends a
    # paragraph; and the n-grams. Beyond the size of a broadcast all n-grams are counted before they meet the wanted ones.
    # Outer, as the filter that goes with the other generator takes the words twice.
    at = own.select(_tokens("text", "printed").alias("p")).select("p", F.posexplode_outer("p").alias("i", "last")).filter(F.col("last").isNotNull() & _is_word("last"))
    nxt, nxt2 = F.get("p", F.col("i") + 1), F.get("p", F.col("i") + 2)
    flag = lambda c, name: c.cast("int").alias(name)
    stops = [flag(nxt.isNull() | F.left(nxt, F.lit(1)).isin(STOPS), "e"), flag(F.coalesce(nxt == ".", F.lit(False)), "d"), flag(F.coalesce((nxt == ".") & (nxt2.isNull() | F.startswith(nxt2, F.lit("\n"))), F.lit(False)), "f")]
    at = at.select("p", "i", "last", _by_char("last").alias("by_char"), _gram("p", F.col("i"), 2).alias("two"), *stops)
    known = F.lit(True)
    if small:
        at, known = at.join(F.broadcast(first.withColumn("known", F.lit(True))), "two", "left"), F.col("known").isNotNull()
    item = lambda w, g: F.struct(w.alias("word"), g.cast("bigint").alias("g"))
    word, three = F.when(~F.col("by_char"), F.col("last")), F.when(F.col("by_char"), _gram("p", F.col("i"), 4)).otherwise(_gram("p", F.col("i"), 3))
    each = F.when(known, F.array(item(word, F.lit(None)), item(F.lit(None), F.col("two")), item(F.lit(None), three), item(F.lit(None), F.when(F.col("by_char"), _gram("p", F.col("i"), 6))))).otherwise(F.array(item(word, F.lit(None))))
    at = at.select("e", "d", "f", F.inline_outer(each)).filter("word IS NOT NULL OR g IS NOT NULL")
    if small:
        at = at.join(F.broadcast(wanted.withColumn("asked", F.lit(True))), "g", "left").filter("word IS NOT NULL OR asked")
    counts = cut(at.groupBy("word", "g").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("e", "d", "f")]))
    words = counts.filter("word IS NOT NULL").select(F.col("word").alias("last"), F.col("n").alias("n1"), F.col("e").alias("e1"), F.col("d").alias("n0"), F.col("f").alias("e0"))
    grams = counts.filter("g IS NOT NULL").select("g", "n", "e").join(_hint(wanted), "g", "left_semi")

    # each end in doubt stands in the counts as an end, which it isn't known to be
    minus = lambda key: last.groupBy(F.col(key).alias("g")).agg(F.count_if(~F.col("dotted")).alias("own"))
    got = last.join(words, "last", "left").join(minus("last").withColumnsRenamed({"g": "last", "own": "own1"}), "last")
    for k in (1, 2, 3):
        seen = grams.join(minus(f"g{k}").filter("g IS NOT NULL"), "g").select(F.col("g").alias(f"g{k}"), (F.col("n") - F.col("own")).alias(f"m{k}"), (F.col("e") - F.col("own")).alias(f"f{k}"))
        got = got.join(seen, f"g{k}", "left")
    got = got.select(
        "doc_id", "dotted", "last", "by_char", *[F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c) for c in ("m2", "f2", "m3", "f3")], *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(a) for a, c in (
            ("n0", F.col("n0")), ("e0", F.col("e0")), ("n1", F.when(F.col("by_char"), F.col("m1")).otherwise(F.col("n1") - F.col("own1"))), ("e1", F.when(F.col("by_char"), F.col("f1")).otherwise(F.col("e1") - F.col("own1"))))],
    ).withColumnsRenamed({"m2": "n2", "f2": "e2", "m3": "n3", "f3": "e3"})

    # rare last words against the words they begin
    rare = cut(got.filter(F.col("last").rlike(r"\p{L}") & ~F.col("by_char") & (F.col("n1") < LEAST_SEEN[0])).select("last").distinct())
    begun = words.filter("length(last) >= 2").select(F.col("last").alias("word"), F.col("n1").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("last"), "n")
    begun = begun.join(_hint(rare, BROADCAST_ROWS // 10), "last", "left_semi").groupBy("last").agg(F.sum("n").alias("longer"))
    got = got.join(begun, "last", "left").withColumn("within", F.coalesce(F.col("longer") >= PREFIX_TIMES * (F.col("n1") + 1), F.lit(False)))

    limits = _limits(told)
    out = told.drop("p").join(got.drop("dotted", "by_char"), "doc_id", "left").join(_hint(limits), "source", "left")
    of = lambda a: F.when(F.col("kind") == "n_chars", F.col(f"{a}_chars")).otherwise(F.col(f"{a}_pairs"))
    out = out.withColumn("at_limit", F.coalesce((of("n") <= F.col("limit")) & (of("all") > F.col("limit") - F.col("wide")), F.lit(False)))
    plain = ~F.col("dotted")
    likely = plain & (F.col("at_limit") | F.col("paused"))
    rarely = lambda k, most: F.col(f"e{k}") < most * F.col(f"n{k}")
    # an abbreviation's full stop is no end: without one, a text that stops there was cut
    short = (F.col("n0") >= LEAST_DOTTED) & rarely(0, 0.02)
    no, by = F.lit(""), F.when(F.col("ended"), F.lit("")).when(F.col("hard") & plain, F.lit("mark"))
    by = by.when(F.col("dotted"), F.when(short, F.lit("abbreviation")).otherwise(no)).when(short & (F.col("n0") > 0.9 * F.col("n1")), F.lit("abbreviation"))
    by = by.when((F.col("n1") >= NEVER_LAST[0]) & rarely(1, NEVER_LAST[1]), F.lit("never_last"))
    # words that mostly stand at ends together are an end, however rare
    for k in (3, 2):
        by = by.when(~likely & (F.col(f"e{k}") >= 3) & (2 * F.col(f"e{k}") >= F.col(f"n{k}")), no)
    for k, name in ((3, "three_words"), (2, "two_words"), (1, "one_word")):
        by = by.when(F.col(f"n{k}") >= LEAST_SEEN[k - 1], F.when(rarely(k, F.when(likely, LIKELY_SHARE).otherwise(END_SHARE[k - 1])), F.lit(name)).when(likely, F.lit("limit")).otherwise(no))
    by = by.when(F.col("within"), F.lit("within_word")).when(likely, F.lit("limit")).otherwise(no)
    return out.withColumn("decided_by", F.nullif(F.coalesce(by, no), no)).withColumn("is_cut", F.col("decided_by").isNotNull())


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that were cut off."""
    return ends(documents).filter("is_cut").select("doc_id").distinct()


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """source, docs (all its rows), cut_docs and the share of its rows that were cut off."""
    flags = ends(documents).filter("is_cut").select("doc_id").distinct()
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source").join(flags.withColumn("flag", F.lit(1)), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count("flag").alias("cut_docs")).withColumn("share", F.col("cut_docs") / F.col("docs"))
