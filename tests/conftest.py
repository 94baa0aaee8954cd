import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ROW = "line_id bigint, book_id string, page_no int, page string, row_no int, col_no int, bbox array<int>, text string, conf double, words array<struct<text:string,bbox:array<int>,conf:double>>, ord_no int, loaded_at timestamp_ntz"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, line_kind string, fetched_at timestamp_ntz"


@pytest.fixture(scope="session")
def make_rows(spark):
    """Rows of ocr_rows from (line_id, book_id, page_no, row_no, bbox, text) with optional further fields."""

    def make(rows):
        full = [(r[0], r[1], r[2], None, r[3], 0, r[4], r[5], 95.0, None, None, None) for r in rows]
        return spark.createDataFrame(full, ROW)

    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of documents from (doc_id, text, source, line_kind)."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, None, None, r[3] if len(r) > 3 else None, None) for r in rows], DOC)

    return make
