"""Deeply nested JSON records as related flat tables (problem 5), by shared inlining.

The graph of element names is read from the records: an edge for each (parent, field) with the largest number of values
a parent holds and the kinds of value found. Elements under keys that are data (page numbers) share one element. An
element gets a table of its own when it repeats, is shared by several parents or is recursive; a descendant that occurs
at most once is inlined into its nearest table as columns. Every row has its id, its parent's table, row id and a
position, so links hold in both directions.

Defined cases: a record that isn't valid JSON (null and empty ones included) gives no rows, so does a record of another
type than an object where an object is wanted; null members and array items keep their position but give no row; a
record delivered several times gives its rows once, from its latest valid delivery. Records are nested to any depth; halves
of surrogate pairs are shown as U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.session import cut, small_enough

#: Element of members whose names are data. A map's entries are told by their keys, which consist of decimal digits.
ENTRY = "*"
#: Edges of the element graph that the driver analyses at most; members from which an element of a wider graph is a map.
EDGES, NAMES = 50_000, 1_000


def _strict(name: str):
    raise ValueError(name)


def parsed(text: str | None):
    """The value of a JSON text, or None where it isn't valid JSON (NaN and Infinity aren't)."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_strict)
    except RecursionError:
        return _deep(text)
    except ValueError as e:
        # a whole number of thousands of digits is valid too
        return _deep(text) if "digits" in str(e) else None


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_CONSTANTS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """The value of a JSON text nested to any depth, or None where it isn't valid. A number of more than 4000 digits is kept
    as a decimal."""
    stack: list = []  # open arrays and objects, each object with its pending key
    at = _BLANK.match(text).end()
    try:
        while True:
            c = text[at]
            if c in "[{":
                end = _BLANK.match(text, at + 1).end()
                value = [] if c == "[" else {}
                if text[end] != ("]" if c == "[" else "}"):
                    if c == "{":
                        key, at = _key(text, end)
                    else:
                        key, at = None, end
                    stack.append((value, key))
                    continue
                at = end + 1
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                n, at = m.group(), m.end()
                value = Decimal(n) if len(n) > 4000 else int(n) if n.lstrip("-").isdecimal() else float(n)
            else:
                name = next(k for k in _CONSTANTS if text.startswith(k, at))
                value, at = _CONSTANTS[name], at + len(name)
            # a value is whole: it goes into what is open, which may be whole then as well
            while True:
                at = _BLANK.match(text, at).end()
                if not stack:
                    return value if at == len(text) else None
                held, key = stack[-1]
                if isinstance(held, list):
                    held.append(value)
                else:
                    held[key] = value
                at += 1
                if text[at - 1] == ",":
                    at = _BLANK.match(text, at).end()
                    if key is not None:
                        key, at = _key(text, at)
                        stack[-1] = held, key
                    break
                if text[at - 1] != ("]" if isinstance(held, list) else "}"):
                    return None
                value = stack.pop()[0]
    except (IndexError, StopIteration, ValueError):
        return None


def _key(text: str, at: int) -> tuple[str, int]:
    """The key that starts at ``at`` and where its value starts."""
    if text[at] != '"':
        raise ValueError(text[at])
    key, at = scanstring(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if text[at] != ":":
        raise ValueError(text[at])
    return key, _BLANK.match(text, at + 1).end()


def _kind(value) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", Decimal: "number"}.get(type(value), "null")


def _members(name: str, value: dict, maps: frozenset[str] = frozenset()):
    """(element, key, value) of the members of an object of element ``name``; members keyed by digits, and all members of
    ``maps``, share the element ENTRY."""
    every = name in maps
    for k, v in value.items():
        yield (ENTRY, k, v) if every or k.isdecimal() else (k, None, v)


def schema_graph(records: DataFrame, json_col: str, maps: frozenset[str] = frozenset()) -> DataFrame:
    """parent, element, kind, most: each edge of the element graph, each kind of its values, and the most values that one
    parent holds. One row per edge and kind, whatever the number of records. ``maps``: elements whose members' names are data."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, str], int] = {}

        def walk(value) -> None:
            todo = [("", value)]
            while todo:
                name, value = todo.pop()
                if isinstance(value, dict):
                    count: dict[str, int] = {}
                    for element, _, v in _members(name, value, maps):
                        count[element] = count.get(element, 0) + 1
                        at = (name, element, _kind(v))
                        found[at] = max(found.get(at, 0), count[element])
                        if isinstance(v, (dict, list)):
                            todo.append((element, v))
                elif isinstance(value, list):
                    for v in value:
                        at = (name, name, _kind(v)) if isinstance(v, list) else (name, "[]", _kind(v))
                        found[at] = max(found.get(at, 0), len(value))
                        if isinstance(v, (dict, list)):
                            todo.append((name, v))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                walk(parsed(text))
        rows = list(found.items())
        yield pa.RecordBatch.from_pydict({"parent": [_shown(k[0]) for k, _ in rows], "element": [_shown(k[1]) for k, _ in rows], "kind": [k[2] for k, _ in rows], "most": pa.array([n for _, n in rows], pa.int64())})

    return records.select(F.col(json_col).cast("string")).mapInArrow(edges, "parent string, element string, kind string, most bigint").groupBy("parent", "element", "kind").agg(F.max("most").alias("most"))


def inlining(edges: list[tuple[str, str, str, int]]) -> dict[str, list[str]]:
    """Tables and the names of their inlined columns. ``edges``: rows of schema_graph; their number is that of distinct
    element names, so the graph is analysed on the driver."""
    parents: dict[str, set[str]] = {}
    scalars: set[str] = set()
    objects: set[str] = set()
    arrays: set[str] = set()
    for parent, element, kind, most in edges:
        if element == "[]":
            arrays.add(parent)
            (objects if kind == "object" else scalars).add(parent)
            continue
        parents.setdefault(element, set()).add(parent)
        {"object": objects, "array": arrays}.get(kind, scalars).add(element)
        if most > 1:
            arrays.add(element)

    def recursive(name: str, seen: frozenset = frozenset()) -> bool:
        todo, done = [c for c, ps in parents.items() if name in ps], set()
        while todo:
            c = todo.pop()
            if c == name:
                return True
            if c not in done:
                done.add(c)
                todo += [d for d, ps in parents.items() if c in ps]
        return False

    own = {""} | {e for e in parents if e in arrays or (e in objects and len(parents[e]) > 1) or (e in objects and recursive(e))}
    tables: dict[str, list[str]] = {t: [] for t in sorted(own)}

    def inline(table: str, name: str, prefix: str) -> None:
        for child in sorted(c for c, ps in parents.items() if name in ps and c not in own):
            column = f"{prefix}{child}"
            if child in objects:
                inline(table, child, column + "_")
            if child in scalars:
                tables[table].append(column)

    for t in tables:
        inline(t, t, "")
        if t in scalars:
            tables[t].append("value")
    return tables


ROWS = "record_id bigint, version string, tbl string, row_id int, parent_tbl string, parent_id int, via string, pos int, key string, cols map<string,string>"
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _shown(text: str) -> str:
    """text without halves of surrogate pairs, which no column can hold."""
    return text if text.isascii() or not _HALF.search(text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_HALF = re.compile("[\ud800-\udfff]")


def _scalar(value) -> str:
    return _shown(value) if isinstance(value, str) else str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


class _Record:
    """Rows of one record, in the order of the text. What is nested waits on a stack, so depth is no bound."""

    def __init__(self, record: int, version: str, own: set[str], maps: frozenset[str]):
        self.record, self.version, self.own, self.maps, self.out = record, version, own, maps, []

    def rows(self, value: dict) -> list[tuple]:
        todo: list[tuple] = [(self.put, "", value, None, None, "", 0, None)]
        while todo:
            step, *how = todo.pop()
            todo += reversed(list(step(*how)))
        return self.out

    def put(self, child: str, value, table: str | None, parent: int | None, via: str, pos: int, key: str | None):
        """A row of table ``child`` for the value, or for each item of an array."""
        if isinstance(value, list):
            for i, x in enumerate(value):
                yield self.put, child, x, table, parent, via, i, key
        elif value is not None:
            me, cols = len(self.out), []
            self.out.append((self.record, self.version, _shown(child), me, table and _shown(table), parent, _shown(via), pos, key and _shown(key), cols))
            if isinstance(value, dict):
                yield self.fill, child, child, me, value, cols, ""
            else:
                cols.append(("value", _scalar(value)))

    def fill(self, name: str, table: str, me: int, value: dict, cols: list[tuple[str, str]], prefix: str):
        """Columns of row ``me`` from the members of an object of element ``name``, inlined under ``prefix``."""
        for pos, (child, key, v) in enumerate(_members(name, value, self.maps)):
            if child in self.own:
                yield self.put, child, v, table, me, prefix, pos, key
            elif isinstance(v, dict):
                yield self.fill, child, table, me, v, cols, f"{prefix}{child}_"
            elif v is not None:
                cols.append((_shown(f"{prefix}{child}"), _scalar(v)))


def shred(records: DataFrame, key: str, at: str, json_col: str, tables: dict[str, list[str]], maps: frozenset[str] = frozenset()) -> DataFrame:
    """The rows of all tables: record_id and version (a delivery of the record), tbl, row_id (unique in the delivery),
    parent_tbl and parent_id (the foreign key), via (names of the inlined elements between), pos (position in the
    parent's array or object), key (of a map entry) and the inlined columns as a map. No shuffle."""
    own = set(tables)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                part = batch.slice(start, 64)
                for record, version, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    value = parsed(text)
                    if isinstance(value, dict):
                        out += _Record(record, version, own, maps).rows(value)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _NAMES)

    src = records.select(F.col(key).cast("bigint").alias("record_id"), F.col(json_col).cast("string").alias("json"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).filter("record_id IS NOT NULL")
    version = F.concat(F.lpad(F.coalesce("at", F.lit(0)).cast("string"), 20, "0"), F.lit("-"), F.hex(F.xxhash64("json")))
    return src.select("record_id", version.alias("version"), "json").mapInArrow(rows, ROWS)


def shredded(records: DataFrame, key: str, at: str, json_col: str, always: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """All rows of the records and the tables with their columns. ``always``: elements that get a table in any case. Where
    there are more than EDGES edges, elements with more than NAMES members are maps, whose names are data."""
    edges, maps = cut(schema_graph(records, json_col)), frozenset()
    if not small_enough(edges, EDGES):
        wide = edges.filter(f"element <> '[]' AND element <> '{ENTRY}'").groupBy("parent").agg(F.count_distinct("element").alias("n")).filter(f"n > {NAMES}")
        maps = frozenset(r[0] for r in wide.orderBy(F.desc("n"), "parent").limit(EDGES).collect())
        edges = cut(schema_graph(records, json_col, maps))
        if not small_enough(edges, EDGES):
            raise ValueError(f"{json_col}: more than {EDGES} kinds of elements")
    tables = inlining([tuple(r) for r in edges.collect()])
    for t in always:
        tables.setdefault(t, [])
    return shred(records, key, at, json_col, tables, maps), tables


def flat_table(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One of the tables with its inlined columns as columns (prefixed c_, so that they clash with no key)."""
    return rows.filter(F.col("tbl") == name).select("record_id", "version", "row_id", "parent_tbl", "parent_id", "via", "pos", "key", *(F.try_element_at("cols", F.lit(c)).alias(f"c_{c}") for c in columns))


@F.pandas_udf(T.IntegerType())
def page_number(keys: pd.Series) -> pd.Series:
    """Number of a key of decimal digits of any script; null for other keys and beyond 31 bits."""
    own = {k: int(k) for k in keys.dropna().unique() if k.isdecimal() and len(k) < 4000}
    return keys.map(lambda k: own[k] if k in own and own[k] < 2**31 else None).astype("Int32")


REVIEW_TABLES = (ENTRY, "lines", "history", "before", "h")


def review_fields(reviews: DataFrame) -> DataFrame:
    """review_id, place, entry_no, pdf, line_i, field: one row per field name in ``h`` of a line item, joined from the
    flat tables along their foreign keys."""
    rows, _ = shredded(reviews, "review_id", "received_at", "review", REVIEW_TABLES)
    rows = cut(rows.filter(F.col("tbl").isin("", *REVIEW_TABLES)))
    valid = rows.filter("tbl = ''").groupBy("record_id").agg(F.max("version").alias("version"))
    rows = rows.join(valid, ["record_id", "version"], "left_semi")
    link = ["record_id", "version"]

    def of(name: str, as_id: str, *more) -> DataFrame:
        return rows.filter(F.col("tbl") == name).select(*link, F.col("row_id").alias(as_id), *more)

    parent = lambda p: [F.col("parent_id").alias(f"{p}_id"), F.col("parent_tbl").alias(f"{p}_tbl")]
    fields = of("h", "h_id", F.col("parent_id").alias("line_id"), F.try_element_at("cols", F.lit("value")).alias("field")).filter("field IS NOT NULL")
    line = of("lines", "line_id", *parent("page"), F.expr("try_cast(try_element_at(cols, 'i') AS INT)").alias("line_i"), F.col("parent_tbl").isin(ENTRY, "before").alias("placed")).filter("placed")
    page = rows.filter((F.col("tbl") == ENTRY) & (F.col("parent_tbl") == "") & (F.col("via") == "pages_")).select(*link, F.col("row_id").alias("page_id"), F.lit("pages").alias("place"), F.lit(-1).alias("entry_no"), page_number("key").alias("pdf"))
    entry = of("history", "entry_id", F.col("pos").alias("entry_no"), F.expr("try_cast(try_element_at(cols, 'pdf') AS INT)").alias("pdf"), F.col("parent_tbl").alias("top")).filter("top = ''").drop("top")
    before = of("before", "page_id", F.col("parent_id").alias("entry_id")).join(entry, [*link, "entry_id"]).select(*link, "page_id", F.lit("history").alias("place"), "entry_no", "pdf")
    places = page.unionByName(before).filter("pdf IS NOT NULL")
    found = fields.join(line, [*link, "line_id"]).join(places, [*link, "page_id"])
    return found.select(F.col("record_id").alias("review_id"), "place", "entry_no", "pdf", "line_i", "field").distinct()


def review_boxes(reviews: DataFrame) -> DataFrame:
    """review_id, book_id, page_no, i, old_box: the lines with boxes that the correction files' pages store."""
    rows, _ = shredded(reviews, "review_id", "received_at", "review", REVIEW_TABLES)
    rows = cut(rows.filter(F.col("tbl").isin("", ENTRY, "lines", "b")))
    valid = rows.filter("tbl = ''").groupBy("record_id").agg(F.max("version").alias("version"))
    rows = rows.join(valid, ["record_id", "version"], "left_semi")
    link = ["record_id", "version"]
    page = rows.filter((F.col("tbl") == ENTRY) & (F.col("via") == "pages_")).select(*link, F.col("row_id").alias("page_id"), page_number("key").alias("page_no")).filter("page_no IS NOT NULL")
    line = rows.filter("tbl = 'lines'").select(*link, F.col("row_id").alias("line_id"), F.col("parent_id").alias("page_id"), F.expr("try_cast(try_element_at(cols, 'i') AS INT)").alias("i"))
    sides = rows.filter("tbl = 'b' AND parent_tbl = 'lines'").select(*link, F.col("parent_id").alias("line_id"), "pos", F.expr("try_cast(try_element_at(cols, 'value') AS INT)").alias("v"))
    boxes = sides.groupBy(*link, "line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("old_box")).filter("size(old_box) = 4")
    book = reviews.select(F.col("review_id").alias("record_id"), "book_id").filter("book_id IS NOT NULL").dropDuplicates(["record_id"])
    at = boxes.join(line, [*link, "line_id"]).join(page, [*link, "page_id"]).join(book, "record_id").filter("i IS NOT NULL")
    return at.select(F.col("record_id").alias("review_id"), "book_id", "page_no", "i", "old_box").dropDuplicates(["review_id", "book_id", "page_no", "i"])


def review_pages(reviews: DataFrame) -> DataFrame:
    """review_id, book_id, page_no, kind and number: what a person set for whole pages in each file's latest valid delivery: the
    kind (figure, also for covers, or blank) and the printed number of at most four digits; null where it wasn't set."""
    rows, _ = shredded(reviews, "review_id", "received_at", "review", (ENTRY, "page", "h"))
    rows = cut(rows.filter(F.col("tbl").isin("", ENTRY, "page", "h")))
    valid = rows.filter("tbl = ''").groupBy("record_id").agg(F.max("version").alias("version"))
    rows = rows.join(valid, ["record_id", "version"], "left_semi")
    link = ["record_id", "version", "page_id"]
    page = rows.filter((F.col("tbl") == ENTRY) & (F.col("via") == "pages_")).select("record_id", "version", F.col("row_id").alias("page_id"), page_number("key").alias("page_no")).filter("page_no IS NOT NULL")
    own = rows.filter((F.col("tbl") == "page") & (F.col("parent_tbl") == ENTRY)).select("record_id", "version", F.col("parent_id").alias("page_id"), F.try_element_at("cols", F.lit("type")).alias("type"), F.try_element_at("cols", F.lit("pn")).alias("pn"))
    by_hand = rows.filter((F.col("tbl") == "h") & (F.col("parent_tbl") == ENTRY)).groupBy("record_id", "version", F.col("parent_id").alias("page_id")).agg(F.collect_set(F.try_element_at("cols", F.lit("value"))).alias("h"))
    at = page.join(own, link).join(by_hand, link)
    digits = F.translate(F.trim("pn", F.lit(" -–—.()[]")), "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "0123456789" * 2)
    kind = F.when(F.array_contains("h", "type"), F.when(F.col("type").isin("figure", "cover"), "figure").when(F.col("type") == "blank", "blank"))
    number = F.when(F.array_contains("h", "pn") & digits.rlike("^[0-9]{1,4}$"), digits.try_cast("int"))
    book = reviews.select(F.col("review_id").alias("record_id"), "book_id").filter("book_id IS NOT NULL").dropDuplicates(["record_id"])
    return at.join(book, "record_id").select(F.col("record_id").alias("review_id"), "book_id", "page_no", kind.alias("kind"), number.alias("number"))
