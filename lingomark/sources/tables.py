"""CSV, JSON and text tables in and out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingomark.contracts import widen
from lingomark.functions.text import error_text
from lingomark.session import stage

# Schemas of the manifest, transcript and result tables.
MANIFEST = "filename string, label double"
TRANSCRIPTS = "filename string, transcript string, label double"
RESULTS = "filename string, transcript string, grammar_score double, corrected_text string"
SUBMISSION = "filename string, label double"
REQUEST = "text string"

# Column names of older tables and their current names.
ALIASES = {"file_name": "filename", "file": "filename", "transcription": "transcript", "score": "label"}

# The row written when a whole batch fails.
SENTINEL_NAME = "ERROR"
SENTINEL_TEXT = "Processing failed due to an error"


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, line_breaks: bool = True
) -> DataFrame:
    """CSV with a header; fields may hold commas, quotes and line breaks. Empty cells are NULL.

    With ``line_breaks`` one file is one task, because a quoted line break hides where records
    start. Set it to False for tables whose fields have none (manifests): big files are then cut.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", line_breaks)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def canonical_names(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Rename older column names; a current name that is already there wins."""
    present = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in present and b not in present})


def read_manifest(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    return read_csv(spark, path, MANIFEST if labelled else "filename string", line_breaks=False)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TRANSCRIPTS)


def submission(results: DataFrame, name: str = "filename", score: str = "grammar_score") -> DataFrame:
    """Two-column delivery table."""
    return results.select(F.col(name).alias("filename"), F.col(score).alias("label"))


def label_table(results: DataFrame) -> DataFrame:
    return results.select("filename", "transcript", F.col("grammar_score").alias("label"))


def write_results(results: DataFrame, detail_path: str, submission_path: str, mode: str = "overwrite") -> None:
    """Detail and delivery tables, from one run of the plan."""
    detail = stage(results.select("filename", "transcript", "grammar_score", "corrected_text"), "results")
    write_csv(detail, detail_path, mode)
    write_csv(submission(detail), submission_path, mode)


def write_features(df: DataFrame, path: str, vector: str | None = None, size: int = 0, mode: str = "overwrite") -> None:
    """Feature table: Parquet as it is, or CSV with the embedding ``vector`` as scalar columns."""
    if vector is None:
        df.write.mode(mode).parquet(path)
    else:
        write_csv(widen(df, vector, size), path, mode)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Error log: one line per failed file."""
    lines.write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def rows_to_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sentinel(spark: SparkSession, message: str) -> DataFrame:
    row = spark.createDataFrame([(SENTINEL_NAME, message, 0.0, SENTINEL_TEXT)], RESULTS)
    return row.withColumn("transcript", error_text(F.col("transcript")))


def with_sentinel(spark: SparkSession, job: Callable[[], None], error_path: str) -> None:
    """Run a job; when it fails as a whole, leave one error row behind and raise again."""
    try:
        job()
    except Exception as error:
        write_csv(sentinel(spark, str(error)), error_path, "overwrite")
        raise
