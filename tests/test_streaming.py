"""Streams against their batch equivalents, with restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lingomark.operators import ordering
from lingomark.plans.request import FIELDS, respond
from lingomark.sources import audio
from lingomark.streaming import history, scoring
from wavs import lookup_recogniser, save, tone


def drop_requests(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_text_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    first = [{"id": i, "text": f"i am number {i}. u r y"} for i in range(20)] + [{"id": 20}, {"id": 21, "text": ""}]
    drop_requests(inbox, "a.json", first)

    def run():
        answered = scoring.score_requests(scoring.text_requests(spark, str(inbox), files_per_batch=1))
        scoring.append_results(answered.select("id", *FIELDS), out, mark)

    run()
    assert spark.read.parquet(out).count() == 22
    run()
    assert spark.read.parquet(out).count() == 22
    drop_requests(inbox, "b.json", [{"id": 30, "text": "late u"}])
    run()
    got = {r["id"]: r for r in spark.read.parquet(out).collect()}
    batch = respond(
        spark.read.schema("id bigint, text string").json(str(inbox)), F.col("text"), no_input="No text provided"
    ).select("id", *FIELDS)
    assert {k: tuple(v) for k, v in got.items()} == {r["id"]: tuple(r) for r in batch.collect()}
    assert got[30]["correctedText"] == "late you"
    assert got[21]["error"] == "No text provided"


def test_a_running_stream_picks_up_new_files(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    drop_requests(inbox, "a.json", [{"id": 1, "text": "u"}])
    answered = scoring.score_requests(scoring.text_requests(spark, str(inbox))).select("id", "correctedText")
    query = scoring.append_results(answered, out, mark, interval="1 second")
    try:
        query.processAllAvailable()
        drop_requests(inbox, "b.json", [{"id": 2, "text": "y"}])
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r["id"]: r["correctedText"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "you", 2: "why"}


def test_killed_run_leaves_no_gap_and_no_duplicate(spark, tmp_path):
    """A batch that fails half-way is repeated whole by the next run."""
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(4):
        drop_requests(inbox, f"{i}.json", [{"id": i * 10 + j, "text": "u"} for j in range(10)])
    state = {"fail": True}

    save_batch = scoring.batch_folder(out)

    def write(df, batch_id):
        save_batch(df, batch_id)
        if batch_id == 2 and state["fail"]:
            raise RuntimeError("lost")

    def run():
        requests = scoring.text_requests(spark, str(inbox), files_per_batch=1)
        scoring.append_results(scoring.score_requests(requests), out, mark, per_batch=write)

    with pytest.raises(Exception, match="lost"):
        run()
    state["fail"] = False
    run()
    ids = [r["id"] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == list(range(40))


def test_audio_stream_equals_batch(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    save(inbox, "a.wav", tone(440))
    (inbox / "bad.wav").write_bytes(b"RIFF")
    limit = (inbox / "a.wav").stat().st_size

    def run():
        scored = scoring.upload_features(scoring.audio_uploads(spark, str(inbox)), limit)
        scoring.append_results(scored, out, mark)

    run()
    save(inbox, "big.wav", tone(440, seconds=2.0))
    run()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=lambda r: r[0])
    same = audio.feature_table(audio.scan(spark, str(inbox)), limit).collect()
    assert [str(r) for r in got] == [str(tuple(r)) for r in sorted(same, key=lambda r: r[0])]
    assert "exceeds maximum allowed size" in got[-1][-1]


def test_uploads_are_answered(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    save(inbox, "a.wav", tone(440))
    save(inbox, "b.wav", tone(440))
    (inbox / "bad.wav").write_bytes(b"RIFF")
    recogniser = lookup_recogniser({"a.wav": "u r fine", "bad.wav": "x"})
    answered = scoring.answer_uploads(scoring.audio_uploads(spark, str(inbox)), recogniser, "filename")
    scoring.append_results(answered, out, mark)
    got = {r["filename"]: r for r in spark.read.parquet(out).collect()}
    assert got["a.wav"]["correctedText"] == "you are fine" and got["a.wav"]["error"] is None
    assert got["a.wav"]["grammarScore"] == pytest.approx(5 / 3)
    assert got["bad.wav"]["error"].startswith("Invalid audio file: ") and got["bad.wav"]["transcription"] == ""
    assert "no transcript" in got["b.wav"]["error"]


def model():
    def predict(units):
        if any("bad" in unit for unit in units):
            raise ValueError("refused")
        return [unit.upper() for unit in units]

    return predict


def test_a_model_answers_streams_as_it_does_tables(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    long = "one more part. " * 80
    rows = [{"id": i, "text": t} for i, t in enumerate(["u r", "bad", long, long + "bad", "", None, "u r", long])]
    drop_requests(inbox, "a.json", rows)
    answered = scoring.score_requests(scoring.text_requests(spark, str(inbox)), load_corrector=model)
    scoring.append_results(answered.select("id", *FIELDS), out, mark)
    table = spark.read.schema("id bigint, text string").json(str(inbox))
    same = respond(table, F.col("text"), no_input="No text provided", load_corrector=model).select("id", *FIELDS)
    got = {r["id"]: tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {r["id"]: tuple(r) for r in same.collect()}
    assert got[0][3] == "U R" and got[1][3] == "bad" and got[3][3] == long + "bad" and "part" not in got[2][3]


def events(n, clears=()):
    """One user owns a third of all events."""
    order = random.Random(5)
    rows = [
        {"user_id": 0 if i % 3 == 0 else order.randrange(1, 8), "ts": order.randrange(500), "item_id": i, "cleared": False}
        for i in range(n)
    ]
    return rows + [{"user_id": u, "ts": ts, "item_id": n + i, "cleared": True} for i, (u, ts) in enumerate(clears)]


def stream_events(spark, tmp_path, rows, cuts):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    random.Random(9).shuffle(rows)
    for i in range(cuts):
        drop_requests(inbox, f"{i}.json", rows[i::cuts])
        source = spark.readStream.schema(history.ITEMS).option("maxFilesPerTrigger", 1).json(str(inbox))
        scoring.append_results(history.history_updates(source), out, mark)
    done = spark.read.parquet(out)
    return {(r["user_id"], r["rank"], r["item_id"]) for r in history.current_history(done).collect()}


def test_history_equals_batch(spark, tmp_path):
    rows = events(600)
    got = stream_events(spark, tmp_path, list(rows), 3)
    table = spark.createDataFrame(rows, history.ITEMS)
    newest = ordering.latest_rows(table, "user_id", [F.desc("ts"), F.desc("item_id")], history.HISTORY_SIZE)
    assert got == {(r["user_id"], r["rank"], r["item_id"]) for r in newest.collect()}


def test_clear_events_drop_older_items(spark, tmp_path):
    rows = events(300, clears=[(0, 490), (1, 250), (2, 600)])
    got = stream_events(spark, tmp_path, list(rows), 2)
    expected = set()
    for user in range(8):
        clear = max([(r["ts"], r["item_id"]) for r in rows if r["user_id"] == user and r["cleared"]], default=(-1, -1))
        items = [(r["ts"], r["item_id"]) for r in rows if r["user_id"] == user and not r["cleared"]]
        kept = sorted((i for i in items if i > clear), reverse=True)[:10]
        expected |= {(user, n + 1, item) for n, (_, item) in enumerate(kept)}
    assert got == expected


def test_null_users_and_compaction(spark, tmp_path):
    rows = [{"user_id": u, "ts": i, "item_id": i, "cleared": False} for i in range(60) for u in (None, 7)]
    rows += [{"user_id": 7, "ts": 100, "item_id": 100, "cleared": True}, {"user_id": 7, "ts": 90, "item_id": 90, "cleared": False}]
    got = stream_events(spark, tmp_path, list(rows), 2)
    assert got == {(None, n + 1, 59 - n) for n in range(10)}
    updates = spark.read.parquet(str(tmp_path / "out"))
    compact = history.newest_lists(updates)
    assert compact.count() == 2 and updates.count() > 2
    assert {tuple(r) for r in history.current_history(compact).collect()} == {
        tuple(r) for r in history.current_history(updates).collect()
    }
