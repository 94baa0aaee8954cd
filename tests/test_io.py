import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.models.forest import Forest, TextModel, score, text_probabilities
from leafwork.operators import lines
from leafwork.sinks import pages as sinks
from leafwork.sources import readers
from leafwork.streaming import progress


def test_json_lines_round_trip(spark, make_rows, tmp_path):
    rows = make_rows([(1, "b", 1, 0, [0, 0, 9, 9], "سلام"), (2, "b", 1, 1, [0, 20, 9, 29], "two words")])
    out = sinks.page_json(lines.text_lines(rows)).orderBy("pos")
    (tmp_path / "p-001.jsonl").write_text("\n\n".join([*(r.value for r in out.collect()), "not json", '{"text": " "}', '{"text": "last"}']))
    got = {r.row_no: r for r in readers.ocr_rows(spark, str(tmp_path / "*.jsonl")).collect()}
    assert sorted(got) == [0, 1, 4] and got[0].text == "سلام" and got[1].bbox == [0, 20, 9, 29] and got[4].page == "p-001"


def test_tsv(spark, tmp_path):
    words = [(1, 1, 1, 1, "a", 10), (1, 1, 1, 2, "b", 30), (1, 1, 2, 1, "c", 10)]
    text = "level\tpage\n" + "\n".join(f"5\t1\t{b}\t{p}\t{ln}\t{w}\t{x}\t5\t10\t8\t90\t{t}" for b, p, ln, w, t, x in words) + "\n5\t1\t1\t1\t3\t1\t0\t0\t1\t1\t5\t \n"
    (tmp_path / "x.tsv").write_text(text)
    got = sorted((r.line_no, r.text, r.bbox) for r in readers.tsv_lines(spark, str(tmp_path / "x.tsv")).collect())
    assert got == [(1, "a b", [10, 5, 40, 13]), (2, "c", [10, 5, 20, 13])]


def test_image_list(spark):
    listing = spark.createDataFrame([("page num type width height",), ("1 0 image 800 900",), ("1 1 smask 900 900",), ("2 2 image 10 10",), ("2 3 image 700 700",), ("x",)], "value string")
    images = readers.image_list(listing)
    assert sorted((r.page, r.num) for r in readers.best_images(images).collect()) == [(1, 0), (2, 3)]
    assert readers.scan_mode(images, 2).first().mode == "extract" and readers.scan_mode(images, 3).first().mode == "render"


def test_inputs_refuse_equal_ids(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    (tmp_path / "sub").mkdir()
    assert readers.inputs(spark, [str(tmp_path)]).count() == 1
    (tmp_path / "sub" / "a.jpg").write_bytes(b"1")
    with pytest.raises(ValueError):
        readers.inputs(spark, [str(tmp_path)])


def test_marks_and_labels(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"pages": {"3": {"kind": "part", "title": " a  b "}, "x": {"kind": "part"}, "4": {"kind": "odd"}}}))
    assert [tuple(r) for r in readers.marks(spark, str(tmp_path / "m.json")).collect()] == [(3, "part", "a b")]
    (tmp_path / "p-007.json").write_text('{"valid": true, "page": {"type": "text"}, "lines": [{"i": 0, "r": "body"}]}')
    r = readers.labels(spark, str(tmp_path / "p-007.json")).first()
    assert (r.page_no, r.valid, r.lines[0].r) == (7, True, "body")
    jobs = spark.createDataFrame([('{"id": "1", "status": "running"}',), ("broken",)], "value string")
    assert [r.status for r in readers.jobs(jobs).collect()] == ["interrupted"]


def test_hocr_and_text(make_rows):
    rows = lines.text_lines(make_rows([(1, "b", 1, 1, [0, 20, 9, 29], "b<"), (2, "b", 1, 0, [0, 0, 9, 9], "a")]))
    assert sinks.page_text(rows).first().text == "a\nb<\n"
    html = sinks.hocr(rows).first().html
    assert html.count("ocr_line") == 2 and 'title="bbox 0 0 9 29"' in html
    assert "missing numbers: none" in sinks.report(rows, lines.page_quality(rows), rows.selectExpr("book_id", "1 AS first", "1 AS last").limit(0)).first().report


def test_tree_with_missing_values(spark):
    tree = Forest(np.array([[0, -1, -1]]), np.array([[0.5, 0, 0]]), np.array([[1, 0, 0]]), np.array([[2, 0, 0]]), np.array([[0, 0, 0]]), np.array([[0.0, -2.0, 2.0]]), np.array([0.5]))
    df = spark.createDataFrame([(0.2,), (0.9,), (None,)], "x double")
    assert [r.s[0] for r in df.select(score(tree, F.col("x"), raw=True).alias("s")).collect()] == [-1.5, 2.5, 2.5]
    p = df.select(score(tree, F.col("x")).alias("s")).first().s
    assert p[1] == pytest.approx(1 / (1 + np.exp(1.5))) and sum(p) == pytest.approx(1)


def test_text_model(spark):
    model = TextModel(np.array([[0.0, 2.0], [2.0, 0.0]]), np.array([0.0, 0.0]))
    df = spark.createDataFrame([([0],), ([0, 1],), (None,)], "t array<int>")
    got = [r.p for r in df.select(text_probabilities(model, F.col("t")).alias("p")).collect()]
    assert got[0][1] > 0.8 and got[1] == [0.5, 0.5] and got[2] == [0.5, 0.5]


EVENT = "job_id string, stage string, done int, total int, sent_at timestamp"


def test_stage_state(spark):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("j", "ocr", 1, 10, at(1)), ("j", "ocr", 5, None, at(2)), ("j", "ocr", 5, None, at(2)), ("j", "ocr", None, None, at(3)), ("j", "ocr", 9, None, None), ("k", None, 1, 1, at(1))]
    got = progress.stage_state(spark.createDataFrame(rows, EVENT)).collect()
    assert [tuple(r) for r in got] == [("j", "ocr", 5, 10, at(3), 4)]
    assert progress.unfinished(spark.createDataFrame(rows, EVENT)).count() == 1


def test_progress_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("j", "ocr", d, 10, datetime(2024, 1, 1 + d, 1)) for d in range(1, 6)] * 2
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.progress_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT n_events FROM progress").collect()
    assert got and all(r.n_events == 1 for r in got)
