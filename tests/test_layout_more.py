"""Columns, classes, tagged text and blocks of pages; views; isolation of failures."""

from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.operators import layout as L
from sieverank.operators import views as V
from sieverank.sources import tables
from sieverank.streaming import progress


def test_layout(spark):
    words = spark.createDataFrame([(1, 0, "a", 10.0, 5.0, True, 18.0), (1, 0, "b", 12.0, 20.0, False, 9.0), (1, 0, "c", 300.0, 5.0, False, 9.0), (2, 0, "d", 1.0, 1.0, False, 9.0)], "doc_id long, page int, text string, x0 double, top double, bold boolean, size double")
    assert {r.doc_id: r.band for r in L.header_band(words).collect()} == {1: 125.0, 2: None}
    split = spark.createDataFrame([(1, 0, 100.0)], "doc_id long, page int, split double")
    assert {r.text: r.column for r in L.columns_of(words, split).collect()} == {"a": "left", "b": "left", "c": "right", "d": "full"}
    lines = spark.createDataFrame(
        [(1, 0, 0, "EDUCATION", "header", "left", True, 12.0), (1, 0, 1, "Lund", "body", "left", False, 9.0), (1, 0, 2, "References available", "body", "right", False, 9.0), (1, 0, 3, "x", "body", "right", True, 12.0), (2, 0, 0, "a | b", "body", "full", True, 8.0)],
        "doc_id long, page int, line int, text string, role string, column string, bold boolean, size double",
    )
    assert {r.doc_id: r["size"] for r in L.bold_size(lines).collect()} == {1: 12.0, 2: 8.0}
    assert {r.doc_id: r.layout for r in L.layout_class(lines).collect()} == {1: "two_column", 2: "table"}
    assert {(r.doc_id, r.column): r.text for r in L.tagged_text(lines).collect()}[1, "left"] == "[HEADER]EDUCATION[/HEADER]\nLund"
    assert [(r.doc_id, r.section, r.text) for r in L.section_blocks(lines, R.section_headers(spark)).collect()] == [(1, "education", "Lund")]


def test_views_and_failures(spark, tmp_path):
    r = spark.range(1).select(
        V.knockout_checks(F.array(F.lit("Python")), F.array(F.lit("Insufficient experience: 1yr")), F.lit(1.0), F.lit("")).alias("k"), V.weights_are_whole(F.create_map(F.lit("a"), F.lit(60.0), F.lit("b"), F.lit(40.005))).alias("w"),
    ).first()
    assert [(x.passed, x.detail) for x in r.k] == [(False, "Missing: Python"), (False, "1.0 years (insufficient)"), (True, "Not specified")] and r.w
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    notes = spark.createDataFrame([(1, 1, "seen", "x"), (1, 2, "kept", "y")], "id int, at int, status string, note string")
    assert {x.id: x.status for x in V.with_notes(rows, notes).collect()} == {1: "kept", 2: None}
    docs = spark.createDataFrame([("a", 1), ("b", 0)], "document_id string, n int")
    got = {x.document_id: x for x in progress.isolated(docs, lambda row: {"v": 1 // row["n"]}, "v int").collect()}
    assert got["a"].ok and got["a"].record.v == 1 and not got["b"].ok and got["b"].error.startswith("ZeroDivisionError")
    assert tables.read_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    tables.write_ranking(rows, str(tmp_path / "r"), "j1")
    assert tables.read_ranking(spark, str(tmp_path / "r"), "j1", rows.schema).count() == 2


def test_lines_are_made_of_whole_spans(spark):
    """Spans go to their lines without a row for each word, and no page leaves the JVM."""
    spans = spark.createDataFrame(
        [
            (1, 0, 0, "b  c", 100.0, 10.0, 140.0, 20.0, "Serif", 10.0),
            (1, 0, 1, "a", 10.0, 12.0, 20.0, 22.0, "Serif-Bold", 12.0),
            (1, 0, 2, "xx y", 110.0, 13.0, 126.0, 23.0, "Serif", 10.0),
            (1, 0, 3, "anchor moves", 10.0, 14.0, 130.0, 24.0, "Serif-Bold", 10.0),
            (1, 0, 4, "flat flat b a", 50.0, 40.0, 50.0, 50.0, None, None),
            (1, 0, 5, " ", 0.0, 60.0, 9.0, 70.0, "Serif", 10.0),
            (1, 1, 6, "no top", 0.0, None, 60.0, None, "Serif", 10.0),
            (1, 1, 7, " ".join(f"w{i}" for i in range(40)), 0.0, 5.0, 900.0, 15.0, "Serif-Bold", 8.0),
            (1, 2, 10, "pp q", 5.0, 1.0, None, 15.0, "Serif", 8.0),
            (None, 0, 8, None, 0.0, 5.0, 9.0, 15.0, "Serif", 8.0),
            (None, 0, 9, "one", None, 5.0, None, 15.0, "Serif", 8.0),
        ],
        "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double",
    )
    whole = L.lines_of_spans(spans)
    key = lambda r: (r.doc_id or 0, r.page, r.line)
    got = sorted(whole.collect(), key=key)
    assert got == sorted(L.page_lines(L.words_of_spans(spans)).collect(), key=key)
    long = "no " + " ".join(f"w{i}" for i in range(2)) + " top " + " ".join(f"w{i}" for i in range(2, 40))
    assert [(r.doc_id, r.page, r.line, r.text, r.top, r.x0, r.bold) for r in got] == [
        (None, 0, 0, "one", 5.0, None, False),
        (1, 0, 0, "a b xx y c", 10.0, 10.0, False),
        (1, 0, 1, "anchor moves", 14.0, 10.0, True),
        (1, 0, 2, "flat flat b a", 40.0, 50.0, False),
        (1, 1, 0, long, 5.0, 0.0, False),
        (1, 2, 0, "pp q", 1.0, None, False),
    ]
    assert "Pandas" not in whole._jdf.queryExecution().toString()
