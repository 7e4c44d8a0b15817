"""CSV, JSON and text tables."""

import json

import pytest
from pyspark.sql import functions as F

from lingomark.plans import request
from lingomark.sources import tables

TRICKY = ['plain', 'a, "quoted" one', "two\nlines", "O'Neil", "tab\there", "ends with quote\"", "é, ü", " blanks "]


def test_csv_round_trip(spark, tmp_path):
    rows = [(f"{i}.wav", t, float(i)) for i, t in enumerate(TRICKY)]
    table = tables.rows_to_table(spark, rows, tables.TRANSCRIPTS)
    tables.write_csv(table, str(tmp_path / "t"))
    back = tables.read_transcripts(spark, str(tmp_path / "t")).orderBy("label").collect()
    assert [tuple(r) for r in back] == rows


def test_empty_cells_are_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,transcript,label\na.wav,,\n,hi,2.5\n")
    first, second = tables.read_transcripts(spark, str(tmp_path / "m.csv")).collect()
    assert tuple(first) == ("a.wav", None, None) and tuple(second) == (None, "hi", 2.5)


def test_manifest(spark, tmp_path):
    (tmp_path / "train.csv").write_text("filename,label\naudio_1.wav,3.5\naudio_2.wav,x\n")
    rows = tables.read_manifest(spark, str(tmp_path / "train.csv")).collect()
    assert [tuple(r) for r in rows] == [("audio_1.wav", 3.5), ("audio_2.wav", None)]


def test_canonical_names(spark):
    old = spark.createDataFrame([("a", "b")], "file_name string, transcription string")
    assert tables.canonical_names(old).columns == ["filename", "transcript"]
    both = spark.createDataFrame([("a", "b")], "filename string, file string")
    assert tables.canonical_names(both).columns == ["filename", "file"]


def test_results_and_submission(spark, tmp_path):
    results = spark.createDataFrame([("a.wav", "t, u", 3.25, 'c "d"')], tables.RESULTS).coalesce(1)
    tables.write_results(results, str(tmp_path / "detail"), str(tmp_path / "sub"))
    assert tuple(tables.read_csv(spark, str(tmp_path / "detail"), tables.RESULTS).first()) == ("a.wav", "t, u", 3.25, 'c "d"')
    text = "".join(p.read_text() for p in (tmp_path / "sub").glob("*.csv"))
    assert text == "filename,label\na.wav,3.25\n"
    assert tables.label_table(results).columns == ["filename", "transcript", "label"]


def test_feature_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", 1.5, [0.25, -1.0])], "filename string, duration double, e array<double>")
    tables.write_features(rows, str(tmp_path / "p"))
    assert tuple(spark.read.parquet(str(tmp_path / "p")).first()) == ("a.wav", 1.5, [0.25, -1.0])
    tables.write_features(rows.coalesce(1), str(tmp_path / "c"), vector="e", size=2)
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text == "filename,duration,emb_0,emb_1\na.wav,1.5,0.25,-1.0\n"


def test_error_lines(spark, tmp_path):
    lines = spark.createDataFrame([("a: bad",), ("b: worse",)], "value string")
    tables.write_lines(lines, str(tmp_path / "log"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a: bad", "b: worse"]


def test_sentinel_row_and_reraise(spark, tmp_path):
    def job():
        raise RuntimeError("no manifest")

    with pytest.raises(RuntimeError, match="no manifest"):
        tables.with_sentinel(spark, job, str(tmp_path / "err"))
    row = tables.read_csv(spark, str(tmp_path / "err"), tables.RESULTS).first()
    assert tuple(row) == ("ERROR", "Error: no manifest", 0.0, "Processing failed due to an error")
    tables.with_sentinel(spark, lambda: None, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_metrics_json(spark, tmp_path):
    record = spark.createDataFrame([(0.0, 0.0, [3.0], 1)], "mse double, mae double, val_predictions array<double>, n_samples int")
    tables.write_json(record, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.json"))
    assert json.loads(text) == {"mse": 0.0, "mae": 0.0, "val_predictions": [3.0], "n_samples": 1}


def test_responses(spark):
    rows = spark.createDataFrame(
        [
            (1, "i know", None, None),
            (2, "", None, None),
            (3, None, "u heard", None),
            (4, None, None, "Audio file not found: x.wav"),
            (5, "", "", None),
            (6, "typed", "heard", None),
        ],
        "id int, typed string, heard string, lost string",
    )
    answered = request.respond(rows, F.col("typed"), F.col("heard"), F.col("lost"))
    got = {r["id"]: json.loads(r["j"]) for r in answered.select("id", request.response_json().alias("j")).collect()}
    assert got[1] == {"transcription": "", "originalText": "i know", "correctedText": "I know", "grammarScore": 2.5}
    refused = {"transcription": "", "originalText": "", "correctedText": "", "grammarScore": 0.0}
    assert got[2] == {**refused, "error": "Please provide either an audio file or text input."}
    assert got[3]["correctedText"] == "you heard" and got[3]["transcription"] == "u heard"
    assert got[4] == {**refused, "error": "Audio file not found: x.wav"}
    assert got[5] == {**refused, "error": "No text to process."}
    assert got[6]["originalText"] == "typed" and got[6]["transcription"] == "heard"


def test_request_field(spark):
    rows = spark.createDataFrame([('{"text": "a \\"b\\""}',), ("{}",), ("not json",), (None,)], "j string")
    assert [r[0] for r in rows.select(request.request_text(F.col("j"))).collect()] == ['a "b"', "", "", ""]
