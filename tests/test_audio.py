"""Audio scan, validation and features on synthetic clips with known answers."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingomark.functions import signal
from lingomark.functions.text import WORD_RULES
from lingomark.operators import training
from lingomark.plans import batch
from lingomark.sources import audio, tables, waveform
from wavs import RATE, clicks, lookup_recogniser, save, tone


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("audio")
    for f in (440, 1000, 2000):
        save(folder, f"tone_{f}.wav", tone(f))
    save(folder, "stereo.wav", np.stack([tone(1000), np.zeros(RATE)], axis=1))
    save(folder, "silence.wav", np.zeros(RATE))
    save(folder, "short.wav", tone(1000, seconds=0.05))
    save(folder, "empty.wav", np.zeros(0))
    (folder / "corrupt.wav").write_bytes(b"RIFFnot a wave file")
    (folder / "song.mp3").write_bytes(b"ID3" + bytes(50))
    (folder / "notes.txt").write_text("no audio")
    (folder / "UPPER.WAV").write_bytes((folder / "tone_440.wav").read_bytes())
    (folder / "sub").mkdir()
    save(folder / "sub", "inner.wav", tone(440))
    return folder


@pytest.fixture(scope="module")
def features(spark, corpus):
    return {r["filename"]: r for r in audio.feature_table(audio.scan(spark, str(corpus))).collect()}


def test_scan_by_extension(spark, corpus):
    names = {r["filename"] for r in audio.listing(audio.scan(spark, str(corpus))).collect()}
    assert names == {
        "tone_440.wav", "tone_1000.wav", "tone_2000.wav", "stereo.wav", "silence.wav", "short.wav",
        "empty.wav", "corrupt.wav", "song.mp3",
    }
    one = audio.scan(spark, str(corpus / "tone_440.wav"))
    assert [r["filename"] for r in one.select("filename").collect()] == ["tone_440.wav"]
    assert audio.scan(spark, str(corpus), ("wav",)).count() == 8


def test_listing_does_not_read_the_clips(spark, corpus, plan_of):
    listed = audio.listing(audio.scan(spark, str(corpus)))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    accepted, rejected = audio.split_by_size(audio.scan(spark, str(corpus)))
    assert "LessThanOrEqual(length,16777216)" in plan_of(accepted)
    assert "content" not in plan_of(rejected).split("ReadSchema")[1]


@pytest.mark.parametrize("frequency", [440, 1000, 2000])
def test_tones(features, frequency):
    row = features[f"tone_{frequency}.wav"]
    assert row["error"] is None and row["sr"] == RATE and row["channels"] == 1
    assert row["duration"] == 1.0
    assert row["zero_crossing_rate"] == pytest.approx(2 * frequency / RATE, rel=0.06)
    assert row["spectral_centroid"] == pytest.approx(frequency, rel=0.05)
    assert row["spectral_rolloff"] == pytest.approx(frequency, abs=40)
    assert row["rmse"] == pytest.approx(0.5 / np.sqrt(2), rel=0.05)
    assert row["mel_power_mean"] > 0


def test_stereo_is_averaged(features):
    row = features["stereo.wav"]
    assert row["channels"] == 2 and row["n_samples"] == RATE
    assert row["rmse"] == pytest.approx(features["tone_1000.wav"]["rmse"] / 2, rel=1e-3)
    assert row["mel_power_mean"] == pytest.approx(features["tone_1000.wav"]["mel_power_mean"] / 2, rel=1e-3)


def test_silence(features):
    row = features["silence.wav"]
    assert (row["zero_crossing_rate"], row["spectral_centroid"], row["rmse"]) == (0.0, 0.0, 0.0)
    assert row["mel_power_mean"] == 0.0 and row["tempo"] is None and row["error"] is None


def test_bad_clips_are_rows_with_errors(features):
    for name in ("corrupt.wav", "song.mp3", "empty.wav"):
        assert features[name]["error"] and features[name]["duration"] is None
    assert features["short.wav"]["error"] is None


def test_mel_power_grows_with_the_square(spark):
    loud = waveform.mel_power_mean(tone(1000)[:, None], RATE)
    quiet = waveform.mel_power_mean(tone(1000, level=0.25)[:, None], RATE)
    assert loud == pytest.approx(4 * quiet)
    assert waveform.mel_power_mean(tone(1000)[:200, None], RATE) is None


@pytest.mark.parametrize("per_minute", [90, 120, 150])
def test_tempo(per_minute):
    *_, flux = waveform.framed_spectrum(clicks(per_minute), RATE)
    assert waveform.tempo(flux, RATE) == pytest.approx(per_minute, abs=8)


def test_long_clip_is_cut_into_blocks():
    """Frames of all blocks together equal frames computed at once."""
    wave = np.random.default_rng(1).normal(size=RATE * 25) * 0.1
    centroid, rolloff, level, flux = waveform.framed_spectrum(wave, RATE)
    padded = np.pad(wave, 1024)
    frames = np.lib.stride_tricks.sliding_window_view(padded, 2048)[::512]
    size = np.abs(np.fft.rfft(frames * waveform.hann(2048), axis=1))
    bins = np.fft.rfftfreq(2048, 1 / RATE)
    assert len(flux) == len(frames) > waveform.FRAMES_PER_BLOCK
    assert centroid == pytest.approx(np.mean(size @ bins / size.sum(axis=1)))
    assert level == pytest.approx(np.mean(np.sqrt(np.mean(frames**2, axis=1))))
    edge = np.pad(wave, 1024, mode="edge")
    signs = np.lib.stride_tricks.sliding_window_view(edge, 2048)[::512] < 0
    crossings = np.mean(np.diff(signs, axis=1).sum(axis=1) / 2048)
    assert waveform.framed_zero_crossings(wave) == pytest.approx(crossings)


def whole_row(samples):
    """Features of a mono clip computed from all of its frames at once."""
    half = 1024
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(samples, half), 2 * half)[::512]
    size = np.abs(np.fft.rfft(frames * waveform.hann(2048), axis=1))
    bins = np.fft.rfftfreq(2048, 1 / RATE)
    signs = np.lib.stride_tricks.sliding_window_view(np.pad(samples, half, mode="edge") < 0, 2 * half)[::512]
    mirrored = np.lib.stride_tricks.sliding_window_view(np.pad(samples, 200, mode="reflect"), 400)[::200]
    power = np.abs(np.fft.rfft(mirrored * waveform.hann(400), axis=1)) ** 2 @ waveform.mel_filters(RATE)
    return [
        np.mean(np.diff(signs, axis=1).sum(axis=1) / 2048),
        np.mean(size @ bins / size.sum(axis=1)),
        np.mean(np.sqrt(np.mean(frames**2, axis=1))),
        np.mean(bins[(np.cumsum(size, axis=1) >= 0.85 * size.sum(axis=1, keepdims=True) * (1 - 1e-12)).argmax(axis=1)]),
        power.mean(),
        np.abs(np.diff(np.sign(samples))).mean(),
        np.sqrt(np.mean(samples**2)),
    ]


@pytest.mark.parametrize("block", [37, 512, 1 << 18])
@pytest.mark.parametrize("size", [201, 1023, 1025, 2048, 40_000])
def test_blocks_give_the_features_of_the_whole_clip(block, size, monkeypatch):
    monkeypatch.setattr(waveform, "BLOCK_SAMPLES", block)
    clip = waveform.write_wav(np.random.default_rng(size).normal(size=size) * 0.1, RATE)
    row = dict(zip(waveform.ROW_FIELDS, waveform.feature_row(clip), strict=True))
    names = ("zero_crossing_rate", "spectral_centroid", "rmse", "spectral_rolloff", "mel_power_mean", "zero_crossing_global", "rms_global")
    _, _, samples = waveform.read_wav(clip)
    assert [row[n] for n in names] == pytest.approx(whole_row(samples[:, 0]), rel=1e-9)
    assert row["n_samples"] == size and row["error"] is None


def test_an_hour_is_decoded_in_bounded_memory():
    import tracemalloc

    rate, seconds = 8000, 3600
    body = np.random.default_rng(3).integers(0, 255, rate * 60, np.uint8).tobytes() * (seconds // 60)
    out = io.BytesIO()
    with wave.open(out, "wb") as clip:
        clip.setparams((1, 1, rate, 0, "NONE", None))
        clip.writeframes(body)
    content = out.getvalue()
    del out, body
    tracemalloc.start()
    row = dict(zip(waveform.ROW_FIELDS, waveform.feature_row(content), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["duration"] == seconds and row["error"] is None and 0.3 < row["rms_global"] < 0.7
    # The samples alone would be 230 MB as doubles; the bytes that wave holds are the clip once more.
    assert peak < 1.5 * len(content) + (40 << 20)


def test_frames_inside_a_row(spark, plan_of):
    values = [float(k % 7 - 3) for k in range(100)]
    rows = spark.createDataFrame([(1, values), (2, values[:9]), (3, None), (4, values[:10])], "id int, samples array<double>")
    done = rows.select("id", signal.frame_mean(F.col("samples"), signal.frame_rms, 10, 4).alias("level"))
    assert "Exchange" not in plan_of(done) and "Generate" not in plan_of(done)
    frames = np.lib.stride_tricks.sliding_window_view(np.array(values), 10)[::4]
    got = {r["id"]: r["level"] for r in done.collect()}
    assert got[1] == pytest.approx(np.mean(np.sqrt(np.mean(frames**2, axis=1))))
    assert got[2] is None and got[3] is None and got[4] == pytest.approx(np.sqrt(np.mean(frames[0] ** 2)))


@pytest.mark.parametrize("width, scale", [(1, 128), (2, 32768), (3, 8388608), (4, 2147483648)])
def test_sample_widths(width, scale):
    values = np.array([0, scale // 2, -scale // 2])
    raw = (values + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(
        int(v).to_bytes(width, "little", signed=True) for v in values
    )
    out = io.BytesIO()
    with wave.open(out, "wb") as clip:
        clip.setnchannels(1)
        clip.setsampwidth(width)
        clip.setframerate(8000)
        clip.writeframes(raw)
    rate, channels, samples = waveform.read_wav(out.getvalue())
    assert (rate, channels) == (8000, 1)
    assert samples[:, 0] == pytest.approx([0, 0.5, -0.5])


def test_decode_feeds_native_features(spark, corpus):
    clips = audio.scan(spark, str(corpus / "tone_1000.wav"))
    done = clips.select(audio.decode(F.col("content")).alias("d")).select(
        signal.duration(F.col("d.samples"), F.col("d.sr")).alias("duration"),
        signal.zero_crossing_global(F.col("d.samples")).alias("zcr"),
        signal.rms_global(F.col("d.samples")).alias("rms"),
    ).first()
    assert done["duration"] == 1.0
    assert done["zcr"] == pytest.approx(4 * 1000 / RATE, rel=0.01)
    assert done["rms"] == pytest.approx(0.5 / np.sqrt(2), rel=0.01)


def test_validation(spark, corpus):
    size = (corpus / "tone_440.wav").stat().st_size
    checked = {r["filename"]: r for r in audio.validate(audio.scan(spark, str(corpus)), limit=size).collect()}
    assert checked["tone_440.wav"]["valid"] and checked["tone_440.wav"]["reason"] is None
    assert checked["stereo.wav"]["reason"] == (
        f"File size ({(corpus / 'stereo.wav').stat().st_size} bytes) exceeds maximum allowed size ({size} bytes)"
    )
    assert checked["corrupt.wav"]["reason"].startswith("Invalid or unsupported audio file format: ")
    below = {r["filename"]: r["valid"] for r in audio.validate(audio.scan(spark, str(corpus)), limit=size - 1).collect()}
    assert not below["tone_440.wav"] and below["short.wav"]


def transcripts():
    return lookup_recogniser(
        {"tone_440.wav": "i am u", "tone_1000.wav": "all is well", "silence.wav": "quiet", "short.wav": "r"}
    )


def manifest_rows(spark, labelled=True):
    names = ["tone_440.wav", "tone_1000.wav", "tone_440.wav", "gone.wav", "corrupt.wav", "tone_2000.wav"]
    return spark.createDataFrame([(n, float(i)) for i, n in enumerate(names)], tables.MANIFEST)


def test_feature_dataset(spark, corpus):
    said = {"tone_440.wav": "i am u", "tone_1000.wav": " ", "gone.wav": "x", "corrupt.wav": "y", "tone_2000.wav": "fine"}
    heard = F.create_map(*[F.lit(v) for pair in said.items() for v in pair])[F.col("filename")]
    texts = manifest_rows(spark).withColumn("transcript", heard)
    files = audio.scan(spark, str(corpus))
    rows = sorted(batch.feature_dataset(texts, files).collect(), key=lambda r: r["label"])
    assert [r["filename"] for r in rows] == [r["filename"] for r in texts.collect()]
    assert [r["error"] and r["error"][:20] for r in rows[:4]] == [None, "No transcript", None, "Audio file not found"]
    assert rows[4]["error"] and rows[5]["error"] is None
    assert rows[0]["num_words"] == 3 and rows[0]["corrected_text"] == "I am you"
    assert rows[0]["grammar_score_model"] == pytest.approx(1 / 3)
    assert rows[1]["num_words"] == 1
    assert rows[5]["zero_crossing_rate"] == pytest.approx(2 * 2000 / RATE, rel=0.06)
    other = {r["label"]: r for r in batch.feature_dataset(texts, files, variant="global").collect()}
    assert other[5.0]["zero_crossing_rate"] == pytest.approx(4 * 2000 / RATE, rel=0.01)
    assert other[5.0]["rmse"] == pytest.approx(0.5 / np.sqrt(2), rel=0.01)
    assert other[5.0]["spectral_centroid"] < 100
    with pytest.raises(ValueError, match="transcript"):
        batch.feature_dataset(manifest_rows(spark), files)


def test_transcribe(spark, corpus, tmp_path):
    from lingomark.operators import cleaning

    done = batch.transcribe(manifest_rows(spark), audio.scan(spark, str(corpus)), transcripts(), "filename")
    tables.write_csv(cleaning.drop_failed(done).select("filename", "transcript", "label"), str(tmp_path / "t"))
    tables.write_lines(cleaning.failed_lines(done, "filename"), str(tmp_path / "log"))
    good = tables.read_transcripts(spark, str(tmp_path / "t")).collect()
    assert sorted(r["label"] for r in good) == [0.0, 1.0, 2.0]
    log = sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert log[1] == "gone.wav: Audio file not found: gone.wav" and len(log) == 3


def test_batch_job_end_to_end(spark, corpus, tmp_path):
    files = audio.scan(spark, str(corpus))
    results = batch.batch_job(manifest_rows(spark), files, transcripts(), recognise="filename")
    tables.write_results(results, str(tmp_path / "detail"), str(tmp_path / "sub"))
    rows = tables.read_csv(spark, str(tmp_path / "detail"), tables.RESULTS).collect()
    assert len(rows) == 6
    got = {r["filename"]: r for r in rows}
    assert got["tone_440.wav"]["corrected_text"] == "I am you"
    assert got["tone_440.wav"]["grammar_score"] == pytest.approx(5 / 3)
    assert got["tone_1000.wav"]["grammar_score"] == 5.0
    assert got["gone.wav"]["transcript"] == "Error: Audio file not found: gone.wav"
    assert got["gone.wav"]["grammar_score"] == 0.0
    assert got["tone_2000.wav"]["corrected_text"].startswith("Error: ")
    assert tables.read_csv(spark, str(tmp_path / "sub"), tables.SUBMISSION).count() == 6


def test_batch_job_with_a_model(spark, corpus):
    def load():
        def predict(units):
            if any("quiet" in unit for unit in units):
                raise ValueError("refused")
            return [unit.replace("am", "was") for unit in units]

        return predict

    names = ["tone_440.wav", "silence.wav", "gone.wav", "corrupt.wav"]
    manifest = spark.createDataFrame([(n, 0.0) for n in names], tables.MANIFEST)
    files = audio.scan(spark, str(corpus))
    results = batch.batch_job(manifest, files, transcripts(), recognise="filename", load_corrector=load, rules=WORD_RULES)
    got = {r["filename"]: r for r in results.collect()}
    assert got["tone_440.wav"]["corrected_text"] == "I was you" and got["tone_440.wav"]["grammar_score"] == 0.0
    assert got["silence.wav"]["corrected_text"] == "quiet" and got["silence.wav"]["grammar_score"] == 5.0
    assert got["gone.wav"]["corrected_text"].startswith("Error: ") and got["corrupt.wav"]["grammar_score"] == 0.0


def test_batch_job_with_a_trained_scorer(spark, corpus):
    from lingomark.contracts import contract_columns

    columns = contract_columns("hybrid7")
    train = spark.range(60).select(
        *[(F.col("id") * (i + 1) % 10).cast("double").alias(c) for i, c in enumerate(columns)],
        (F.col("id") % 5).cast("double").alias("label"),
    )
    scorer = training.fit_scorer(train, "hybrid7", training.forest(numTrees=3))
    results = batch.batch_job(
        manifest_rows(spark), audio.scan(spark, str(corpus)), transcripts(), scorer, recognise="filename"
    )
    got = {r["filename"]: r["grammar_score"] for r in results.collect()}
    assert 0.0 <= got["tone_440.wav"] <= 4.0 and got["gone.wav"] == 0.0


def test_clip_bytes_are_not_shuffled(spark, corpus, plan_of, tmp_path):
    files = audio.scan(spark, str(corpus))
    (tmp_path / "m.csv").write_text("filename,label\ntone_440.wav,1\ntone_440.wav,1\n")
    known = batch._manifest_clips(tables.read_manifest(spark, str(tmp_path / "m.csv")), files)
    plan = plan_of(known.select("filename", "content"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["filename"] for r in known.select("filename").collect()] == ["tone_440.wav"]
    unknown = batch._manifest_clips(manifest_rows(spark), files)
    plan = plan_of(unknown.select("filename", "content"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
