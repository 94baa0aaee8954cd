"""Files to DataFrames. Readers are lazy and keep to Spark's own sources; a row's number is its place among the lines of
its file that aren't blank, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE = "page STRING, column INT, bbox ARRAY<INT>, text STRING, conf DOUBLE, words ARRAY<STRUCT<text: STRING, bbox: ARRAY<INT>, conf: DOUBLE>>"


def inputs(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf")) -> DataFrame:
    """id, path, bytes of the page files below some paths, by name; raises where two files have one id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(paths).select("path", F.col("length").alias("bytes"))
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), "path", "bytes")
    twice = [r[0] for r in files.groupBy("id").count().filter("count > 1").select("id").limit(20).collect()]
    if twice:
        raise ValueError(f"several files have one id: {', '.join(twice)}")
    return files.orderBy("id")


def ocr_rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """page, row_no, column, bbox, text, conf, words of JSON-lines page files. Blank lines are no rows; rows of blank text are
    dropped after numbering; a line that isn't JSON keeps its number and is dropped. One file is one page, read whole by a
    task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, number, line = [], [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                for text in content.decode("utf-8", "replace").splitlines():
                    if text.strip():
                        name.append(path)
                        number.append(n)
                        line.append(text)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(number, pa.int32()), pa.array(line, pa.string())], ["path", "row_no", "line"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    raw = files.mapInArrow(rows, "path string, row_no int, line string").withColumn("x", F.from_json("line", LINE))
    page = F.coalesce("x.page", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return raw.filter(r"x.text RLIKE '\\S'").select(page.alias("page"), "row_no", *[F.col(f"x.{c}").alias(c) for c in ("column", "bbox", "text", "conf", "words")])


def tsv_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, line_no, text, conf, bbox, words of tab-separated recognition output: word rows (level 5, twelve fields) are
    grouped to lines by block, paragraph and line; boxes come as x, y, width, height."""
    fields = ["level", "page_num", "block", "par", "line", "word", "x", "y", "w", "h", "conf", "text"]
    raw = spark.read.text(paths).select("*", F.input_file_name().alias("path"), F.split("value", "\t").alias("f")).filter(F.size("f") >= 12)
    at = raw.select("path", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(fields)]).filter(r"level = '5' AND text RLIKE '\\S'")
    ints = {c: F.col(c).try_cast("int") for c in fields[1:10]}
    at = at.withColumns(ints | {"conf": F.col("conf").try_cast("double")})
    word = F.struct(F.col("word").alias("k"), F.trim("text").alias("text"), F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox"), "conf")
    lines = at.groupBy("path", "page_num", "block", "par", "line").agg(F.array_sort(F.collect_list(word)).alias("v"))
    side = lambda f, i: f(F.transform("v", lambda w: w["bbox"][i]))
    lines = lines.select(
        "path", F.row_number().over(W.partitionBy("path").orderBy("page_num", "block", "par", "line")).alias("line_no"), F.array_join(F.transform("v", lambda w: w["text"]), " ").alias("text"),
        (F.aggregate("v", F.lit(0.0), lambda a, w: a + F.coalesce(w["conf"], F.lit(0.0))) / F.size("v")).alias("conf"), F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3)).alias("bbox"),
        F.transform("v", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), w["conf"].alias("conf"))).alias("words"),
    )
    return lines


def image_list(listing: DataFrame, column: str = "value") -> DataFrame:
    """page, num, type, width, height of the text rows of an image listing: at least five fields, the first two numbers."""
    f = F.split(F.trim(column), r"\s+")
    rows = listing.select(f.alias("f")).filter((F.size("f") >= 5) & F.col("f")[0].rlike(r"^\d{1,9}$") & F.col("f")[1].rlike(r"^\d{1,9}$"))
    return rows.select(F.col("f")[0].cast("int").alias("page"), F.col("f")[1].cast("int").alias("num"), F.col("f")[2].alias("type"), F.col("f")[3].try_cast("int").alias("width"), F.col("f")[4].try_cast("int").alias("height"))


def best_images(images: DataFrame) -> DataFrame:
    """page, num, type, width, height: the image of each page, real images first, then the largest, then the first."""
    rank = F.struct((F.col("type") == "image").alias("real"), (F.col("width").cast("bigint") * F.col("height")).alias("area"), (-F.col("num")).alias("first"))
    return images.groupBy("page").agg(F.max_by(F.struct("num", "type", "width", "height"), rank).alias("x")).select("page", "x.*")


def scan_mode(images: DataFrame, n_pages: int, least_width: int = 600, share: float = 0.9) -> DataFrame:
    """wide, pages, mode: "extract" where nearly every page carries a wide image, else "render"."""
    wide = images.filter((F.col("type") == "image") & (F.col("width") >= least_width)).select("page").distinct()
    return wide.agg(F.count("*").alias("wide")).select("wide", F.lit(n_pages).alias("pages"), F.when(F.col("wide") >= share * n_pages, "extract").otherwise("render").alias("mode"))


def labels(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """page_no, valid and the members of page label files (one JSON object each); a file that isn't JSON has none."""
    from leafwork.operators.labels import ANSWER

    raw = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).try_cast("int").alias("page_no"), F.from_json("value", ANSWER + ", valid BOOLEAN, error STRING").alias("x"))
    return raw.select("page_no", F.coalesce("x.valid", F.lit(False)).alias("valid"), "x.page", "x.lines", "x.missing", "x.toc", "x.error")


def marks(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """page_no, kind, title of mark files: entries of known kinds under keys that are numbers, titles with blanks
    collapsed."""
    raw = spark.read.text(paths, wholetext=True).select(F.from_json("value", "pages MAP<STRING, STRUCT<kind: STRING, title: STRING>>").alias("x"))
    rows = raw.select(F.explode("x.pages").alias("k", "v")).filter(F.col("k").rlike(r"^[0-9]{1,9}$") & F.col("v.kind").isin("part", "chapter", "section", "figure"))
    return rows.select(F.col("k").cast("int").alias("page_no"), F.col("v.kind").alias("kind"), F.trim(F.regexp_replace(F.coalesce("v.title", F.lit("")), r"\s+", " ")).alias("title"))


def jobs(records: DataFrame, column: str = "value") -> DataFrame:
    """id, kind, name, status of job records (JSON text); a job that was queued or running when it was stored was
    interrupted."""
    x = records.select(F.from_json(column, "id STRING, kind STRING, name STRING, status STRING").alias("x")).select("x.*")
    return x.filter("id IS NOT NULL").withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


