"""Stateless streams: text requests, audio uploads and resumable model output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lingomark.functions.text import Rule
from lingomark.operators.apply_model import Predictor
from lingomark.operators.training import Scorer
from lingomark.plans.batch import hear_clips
from lingomark.plans.request import FIELDS, NO_REQUEST_TEXT, respond
from lingomark.sources.audio import EXTENSIONS, SIZE_LIMIT, feature_table, upload_error

# Fixed value: the schema of Spark's binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def text_requests(
    spark: SparkSession, folder: str, schema: str = "id bigint, text string", files_per_batch: int | None = None
) -> DataFrame:
    """JSON request files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def score_requests(
    requests: DataFrame,
    text: str = "text",
    scorer: Scorer | None = None,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    return respond(
        requests, F.col(text), scorer=scorer, no_input=NO_REQUEST_TEXT, load_corrector=load_corrector, rules=rules
    )


def audio_uploads(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Clips as they arrive in a landing folder."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).withColumn("filename", F.substring_index("path", "/", -1))


def upload_features(uploads: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """Features or error per uploaded clip."""
    return feature_table(uploads, limit)


def answer_uploads(
    uploads: DataFrame,
    load_recogniser: Callable[[], Predictor],
    recognise: str = "content",
    scorer: Scorer | None = None,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
    limit: int = SIZE_LIMIT,
) -> DataFrame:
    """Validate, transcribe, correct and score uploaded clips: ``filename`` and response fields."""
    heard = hear_clips(uploads, load_recogniser, recognise, limit)
    failed = F.concat(F.lit("Error processing input: "), "clip_error")
    refused = F.coalesce(upload_error(F.col("filename"), F.col("audio_error")), failed)
    answered = respond(
        heard, F.lit(None).cast("string"), F.col("transcript"), refused, scorer=scorer, load_corrector=load_corrector, rules=rules
    )
    return answered.select("filename", *FIELDS)


def append_results(
    results: DataFrame,
    output: str,
    checkpoint: str,
    file_format: str = "parquet",
    per_batch: Callable[[DataFrame, int], None] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append results of a stream; a later call goes on where this one stopped.

    Without ``interval`` it processes what has arrived and ends; with one (``"10 seconds"``) it
    keeps running and returns at once. The checkpoint records consumed files and the sink its
    committed ones, so a run that was killed leaves neither gaps nor duplicates. Replaces
    rewriting all partial results each time.
    """
    writer = results.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    if per_batch is not None:
        query = writer.foreachBatch(per_batch).start()
    else:
        query = writer.format(file_format).outputMode("append").start(output)
    if interval is None:
        query.awaitTermination()
    return query

def batch_folder(output: str) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches, one folder each: a batch that is run again replaces what its first run left."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """The rows of all folders that :func:`batch_folder` wrote."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(output)
