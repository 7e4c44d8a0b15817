"""Audio corpora: file scan, validation and feature extraction.

Clip bytes are read late: listings and size checks never load ``content``, and decoded samples
stay inside the Python task that computes the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingomark.sources import waveform

# Accepted file extensions (case-sensitive) and the size limit in bytes.
EXTENSIONS = ("wav", "mp3", "m4a", "ogg")
SIZE_LIMIT = 16 * 1024 * 1024

FEATURE_FIELDS = (
    "duration",
    "zero_crossing_rate",
    "spectral_centroid",
    "rmse",
    "spectral_rolloff",
    "mel_power_mean",
    "tempo",
    "zero_crossing_global",
    "rms_global",
)
FEATURE_TYPE = (
    "sr int, channels int, n_samples bigint, "
    + ", ".join(f"{name} double" for name in FEATURE_FIELDS)
    + ", error string"
)
DECODED_TYPE = "sr int, channels int, samples array<float>, error string"


def scan(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Clips of a folder (not of its subfolders) or single files: ``filename`` and file columns."""
    pattern = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("filename", F.substring_index("path", "/", -1))


def listing(files: DataFrame) -> DataFrame:
    """Names, paths and sizes only; the plan does not read ``content``."""
    return files.select("filename", "path", "length")


def size_error(length: Column, limit: int = SIZE_LIMIT) -> Column:
    """Message for a clip above the limit, NULL for the others."""
    message = F.concat(
        F.lit("File size ("),
        length.cast("string"),
        F.lit(f" bytes) exceeds maximum allowed size ({limit} bytes)"),
    )
    return F.when(length > limit, message)


def split_by_size(files: DataFrame, limit: int | None = SIZE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Clips within the limit, and the others as ``filename, error`` without their bytes.

    Both filters on ``length`` reach the scan, so an oversized clip is never read. Without a limit
    all clips are accepted.
    """
    if limit is None:
        return files, files.where(F.lit(False)).select("filename", F.lit(None).cast("string").alias("error"))
    accepted = files.where(F.col("length") <= limit)
    rejected = files.where(F.col("length") > limit).select(
        "filename", size_error(F.col("length"), limit).alias("error")
    )
    return accepted, rejected


def audio_features(content: Column, with_tempo: bool = True) -> Column:
    """Struct of all audio features of a clip, or its decoding error."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for clips in series:
            rows = [waveform.feature_row(clip, with_tempo) for clip in clips]
            yield pd.DataFrame(rows, columns=waveform.ROW_FIELDS)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returnType=FEATURE_TYPE).asNondeterministic()(content)


def decode(content: Column, seconds: float | None = None) -> Column:
    """Struct of sample rate, channel count and mono samples, or the error.

    ``seconds`` limits decoding to the start of the clip, for validation.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for clips in series:
            rows = [waveform.decoded_row(clip, seconds) for clip in clips]
            yield pd.DataFrame(rows, columns=["sr", "channels", "samples", "error"])

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returnType=DECODED_TYPE).asNondeterministic()(content)


def encode(samples: Column, rate: int) -> Column:
    """16-bit mono WAV bytes of a sample array (fixtures and round trips)."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in series:
            yield arrays.map(lambda values: waveform.write_wav(values, rate))

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType="binary")(samples)


def upload_error(filename: Column, reason: Column) -> Column:
    """Message for an upload that is refused, or NULL."""
    return (
        F.when(filename.isNull(), F.lit("No audio file provided"))
        .when(filename == "", F.lit("No selected file"))
        .when(reason.isNotNull(), F.concat(F.lit("Invalid audio file: "), reason))
    )


def validate(files: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """``filename, valid, reason``: size first, then whether the first second decodes."""
    accepted, rejected = split_by_size(files, limit)
    probed = accepted.select("filename", decode(F.col("content"), 1.0).alias("_probe"))
    reason = F.concat(F.lit("Invalid or unsupported audio file format: "), F.col("_probe.error"))
    checked = probed.select("filename", reason.alias("reason"))
    failed = rejected.select("filename", F.col("error").alias("reason"))
    return checked.unionByName(failed).select("filename", F.col("reason").isNull().alias("valid"), "reason")


def feature_table(files: DataFrame, limit: int | None = None, with_tempo: bool = True) -> DataFrame:
    """One row per clip with all audio features, or with ``error`` and NULL features.

    The size limit is one of uploads; batch jobs take clips of any size.
    """
    accepted, rejected = split_by_size(files, limit)
    done = accepted.select("filename", audio_features(F.col("content"), with_tempo).alias("_f")).select(
        "filename", "_f.*"
    )
    return done.unionByName(rejected, allowMissingColumns=True)
