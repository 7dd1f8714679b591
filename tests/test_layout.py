import json

from pyspark.sql import functions as F

from quittance.functions import json_text
from quittance.operators import layout


def box(x, y, h=10):
    return [[float(x), float(y)], [x + 30.0, float(y)], [x + 30.0, y + float(h)], [float(x), y + float(h)]]


def test_reading_order(spark):
    lines = [(1, 0, "right", 0.9, box(100, 2)), (1, 1, "left", 0.9, box(0, 0)), (1, 2, "below", 0.8, box(0, 40)), (2, 0, "b", 0.0, None), (2, 1, "a", 0.0, box(0, 0))]
    df = spark.createDataFrame(lines, "page_id long, line_no long, text string, confidence double, bbox array<array<double>>")
    ordered = layout.reading_order(df)
    assert [r["text"] for r in ordered.orderBy("page_id", "place").collect()] == ["left", "right", "below", "b", "a"]
    assert [r["text"] for r in layout.row_texts(ordered).orderBy("page_id", "row").collect()] == ["left   right", "below", "b", "a"]


def test_headings_and_confidence(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "ANNUAL REPORT"), (1, 1, 1, "a long running sentence of text that goes on and on for long"), (1, 2, 0, "Summary")], "doc_id long, page int, block int, text string")
    assert [(r["text"], r["level"]) for r in layout.headings(blocks).orderBy("page").collect()] == [("ANNUAL REPORT", 1), ("Summary", 2)]
    lines = spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.5), (1, 2, 0.0), (2, 1, 0.0)], "doc_id long, page int, confidence double")
    assert dict(layout.document_confidence(lines).collect()) == {1: 0.75, 2: 0.85}
    pages = spark.range(1, 26).select(F.lit(1).alias("doc_id"), F.col("id").alias("page"))
    assert [tuple(r) for r in layout.page_parts(pages).orderBy("part").collect()] == [(1, 1, 1, 10), (1, 2, 11, 20), (1, 3, 21, 25)]


def test_json_repair(spark):
    cases = {
        '{"a": 1}': {"a": 1}, '```json\n{"a": [1, 2,],}\n```': {"a": [1, 2]}, '<think>{no}</think> Sure: {"a": "http://x"} ': {"a": "http://x"}, '{"a": 1, // note\n "b": 2}': {"a": 1, "b": 2},
        '{"a": {"b": "cut of': {"a": {"b": "cut of"}}, '{"a": [{"b": 1}, {"b"': {"a": [{"b": 1}]}, "no json": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(json_text.repaired(F.col("t"))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == list(cases.values())


def test_manifest(spark):
    manifest = spark.createDataFrame([(1, "a", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), (1, "b", "0"), (1, "c", "0")], "archive_id long, name string, sha256 string")
    stored = spark.createDataFrame([(1, "a", bytearray(b"abc")), (1, "b", bytearray(b"x"))], "archive_id long, name string, content binary")
    assert [r["state"] for r in layout.manifest_check(manifest, stored).orderBy("name").collect()] == ["ok", "changed", "missing"]
