"""One form for texts that look the same in print (problem 3).

Texts with a character that may change are exploded to positioned code points; two broadcast tables of fixed size (made
by rule from the Unicode character database, plus the listed look-alikes) give each code point its decomposition and the
combining class of its parts; marks are ordered by class within their cluster, clusters are recomposed by a third fixed
table and the string is rebuilt in order. Rules that depend on the neighbours (letters that look alike only when joined,
zero-width marks that part letters) run on the rebuilt string. Texts without any such character skip the explosion; for
them it is the identity.

What doesn't change the look: width forms, presentation forms, ligatures, kinds and numbers of blanks and blanks at the
ends, invisible characters, composed or decomposed marks, look-alike letters of other scripts, digits of the same shape,
initial and medial Arabic yeh and kaf. What does: vowel signs and other marks, digits and letters of another shape,
parted or joined letters, punctuation.

Defined cases: null stays null, empty stays empty, a text of blanks becomes empty. Texts of any length are handled whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Letters of other scripts with the look of a Latin letter, digits of the same shape, hyphens.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹",
    "‐": "-", "‑": "-", "ۀ": "هٔ", "ۓ": "ۓ",
}
# Arabic letters that join only to the letter before them.
RIGHT_JOINING = "اآأإٱٲٳٵدذڈډڊڋڌڍڎڏڐۮرزڑڒړڔڕږڗژڙۯوؤۄۅۆۇۈۉۊۋۏٶٷةۃۀےۓە"
NOT_JOINING = "ءٴۀ"
# Kinds of Unicode decomposition that keep the look.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>"}
# Code points that show nothing. The two zero-width joiners are not among them.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
BLANK = r"[ \t\n\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple[int, int, str, int]], list[tuple[str, str]], str]:
    """Parts (code point, number, part, class) of every code point that changes or is a mark; compositions; the pattern
    of a text that needs the explosion. Their size is that of Unicode, whatever the data."""
    parts: dict[int, str] = {c: "" for c in INVISIBLE}
    parts |= {ord(a): b for a, b in LOOK_ALIKES.items()}

    def spread(c: str, depth: int = 0) -> str:
        if ord(c) in parts and depth < 9:
            return "".join(spread(x, depth + 1) for x in parts[ord(c)])
        raw = unicodedata.decomposition(c).split()
        if not raw:
            return c
        if raw[0].startswith("<"):
            body = "".join(chr(int(x, 16)) for x in raw[1:])
            if raw[0] not in SAME_LOOK_TAGS or (body.startswith(" ") and len(body) > 1) or body.startswith(".") or body == c:
                return c
        else:
            body = "".join(chr(int(x, 16)) for x in raw)
        return "".join(spread(x, depth + 1) for x in body)

    rows, compose = [], {}
    for n in range(0x110000):
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        c = chr(n)
        whole = spread(c)
        rank = unicodedata.combining(c)
        if whole == c and not rank:
            continue
        rows += [(n, k, x, unicodedata.combining(x)) for k, x in enumerate(whole)] or [(n, 0, "", 0)]
        canonical = unicodedata.normalize("NFD", c)
        # A composed letter that recomposes to itself is settled as it stands.
        if len(canonical) == 2 and unicodedata.normalize("NFC", canonical) == c and whole == canonical:
            compose[canonical] = c
    compose["هٔ"], compose["ۓ"] = "ۀ", "ۓ"
    for base in "یى":
        compose[base + "ٔ"] = "ئ"
    # Most texts hold none but these; nested, so that the commonest are tested first. Some of the others don't change
    # either: for them the explosion is the identity.
    plain = "[ء-ي[ \\x21-\\x7E[ی[ٹ-ھ[‌[۰-۹،.؟«»[一-鿿[ぁ-んァ-ヾ[ก-ัิ-ืเ-ๆ[¿-ıĴ-ľŁ-ňŊ-ž[؛٤-٦٫٬ۀہے۔[\t\n¡-§¶·–—‘-‟…、-】]]]]]]]]]]]]"
    needs = rf"\A{plain}*+[\s\S]"
    return rows, sorted(compose.items()), needs


_MARKS = r"\p{Mn}*"
_JOINS = rf"(?:[ؠ-يٮ-ۓۺ-ۿ&&\p{{L}}&&[^{NOT_JOINING}]])"
_DUAL = rf"(?:[ؠ-يٮ-ۓۺ-ۿ&&\p{{L}}&&[^{NOT_JOINING}{RIGHT_JOINING}]])"


def joined_letters(text: Column) -> Column:
    """Letters that look alike only where they are joined, or only where they aren't, in one form."""
    look = text
    for a, ahead, b in (("ي", "=", "ی"), ("ك", "=", "ک"), ("ى", "!", "ی"), ("ە", "!", "ه")):
        look = F.regexp_replace(look, rf"{a}(?{ahead}{_MARKS}{_JOINS})", b)
    return F.when(text.contains("ي") | text.contains("ك") | text.contains("ى") | text.contains("ە"), look).otherwise(text)


def _joined(df: DataFrame, col: str) -> DataFrame:
    """The rules that depend on the neighbours, in JVM patterns; each is applied only where its characters occur."""
    text = F.col(col)
    part = F.regexp_replace(text, "‌{2,}", "‌")
    # a joiner parts only letters that would else join
    part = F.regexp_replace(part, rf"‌(?:(?<!{_DUAL}\p{{Mn}}{{0,4}}‌)|(?!{_MARKS}{_JOINS})|(?=\p{{Mn}}))", "")
    df = df.withColumn(col, F.when(text.contains("‌"), part).otherwise(text)).withColumn(col, joined_letters(text))
    odd = text.contains("  ") | text.rlike(BLANK.replace("[ ", "[", 1))
    return df.withColumn(col, F.trim(F.when(odd, F.regexp_replace(text, BLANK + "+", " ")).otherwise(text)))


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows, compose, _ = _tables()
    parts: dict[str, list[tuple[int, str, int]]] = {}
    for n, k, part, rank in rows:
        parts.setdefault(chr(n), []).append((k, part, rank))
    return F.broadcast(spark.createDataFrame(list(parts.items()), "__ch string, __parts array<struct<__k: int, __part: string, __rank: int>>")), F.broadcast(spark.createDataFrame(compose, "__to_pair string, __whole string"))


def needs_explosion(text: Column) -> Column:
    return F.coalesce(text.rlike(_tables()[2]), F.lit(False))


def _rebuild(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and __base, the text of decomposed, ordered and recomposed code points."""
    spark = df.sparkSession
    parts, compose = _frames(spark)
    # a last code point of its own keeps rows whose every code point shows nothing
    points = df.select(*keys, F.posexplode(F.split(F.concat(F.col(text), F.lit("\0")), "")).alias("__pos", "__ch"))
    points = points.join(parts, "__ch", "left")
    own = F.array(F.struct(F.lit(0).alias("__k"), F.col("__ch").alias("__part"), F.lit(0).alias("__rank")))
    points = points.select(*keys, "__pos", F.inline(F.coalesce("__parts", own))).filter("__part <> ''")
    order = W.partitionBy(*keys).orderBy("__pos", "__k")
    points = points.withColumn("__head", F.max(F.when(F.col("__rank") == 0, F.col("__pos") * 32 + F.col("__k"))).over(order))
    clusters = points.groupBy(*keys, "__head").agg(F.array_sort(F.collect_list(F.struct("__rank", "__pos", "__k", "__part"))).alias("__c"))
    first = F.concat(F.element_at("__c", 1)["__part"], F.coalesce(F.try_element_at("__c", F.lit(2))["__part"], F.lit("")))
    clusters = clusters.withColumn("__pair", F.when(F.size("__c") > 1, first))
    clusters = clusters.join(compose, F.col("__pair") == compose["__to_pair"], "left")
    rest = lambda n: F.array_join(F.transform(F.slice("__c", n, F.greatest(F.size("__c") - n + 1, F.lit(0))), lambda x: x["__part"]), "")
    done = F.when(F.col("__whole").isNotNull(), F.concat("__whole", rest(3))).otherwise(rest(1))
    clusters = clusters.select(*keys, F.coalesce("__head", F.lit(-1)).alias("__head"), done.alias("__s"))
    return clusters.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__head", "__s"))), lambda x: x["__s"]), "").alias("__base")).withColumn("__base", F.expr("substring(__base, 1, length(__base) - 1)"))


def one_form_shared(df: DataFrame, keys: list[str], text: str, to: str = "one_form") -> DataFrame:
    """As one_form for short texts that recur, such as words: each different text that needs the explosion is exploded once and
    joined back by its hashes; the others don't travel."""
    hard = needs_explosion(F.col(text))
    simple = _joined(df.filter(~hard).select(*keys, F.col(text).alias("__base")), "__base")
    hashes = [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(7), text).alias("__h2")]
    own = df.filter(hard).select(*keys, text, *hashes)
    forms = _joined(_rebuild(own.select("__h1", "__h2", text).dropDuplicates(["__h1", "__h2"]), ["__h1", "__h2"], text), "__base")
    return simple.unionByName(own.join(forms, ["__h1", "__h2"]).select(*keys, "__base")).withColumnRenamed("__base", to)


def one_form(df: DataFrame, keys: list[str], text: str, to: str = "one_form", where: Column | None = None) -> DataFrame:
    """keys and ``to``, the one form of ``text``, of the rows that meet ``where`` (tested last). ``keys`` identify a text;
    rows that share them are equal, and are returned once where they need the explosion."""
    where = F.lit(True) if where is None else where
    hard = needs_explosion(F.col(text))
    simple = df.filter(~hard).filter(where).select(*keys, F.col(text).alias("__base"))
    rebuilt = _rebuild(df.filter(hard).filter(where).dropDuplicates(keys), keys, text)
    return _joined(simple.unionByName(rebuilt), "__base").withColumnRenamed("__base", to)
