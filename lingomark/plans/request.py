"""Single requests, text or audio, as a table-in table-out job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.functions.text import Rule, choose_text
from lingomark.operators.apply_model import Predictor
from lingomark.operators.training import Scorer
from lingomark.plans.batch import model_score, rule_score
from lingomark.plans.correction import cascade, corrected

# Messages and field names of a response.
NO_INPUT = "Please provide either an audio file or text input."
NO_TEXT = "No text to process."
NO_REQUEST_TEXT = "No text provided"
FIELDS = ("transcription", "originalText", "correctedText", "grammarScore", "error")


def request_text(body: Column) -> Column:
    """Field ``text`` of a JSON request; empty when it is absent."""
    return F.coalesce(F.get_json_object(body, "$.text"), F.lit(""))


def request_error(
    text_input: Column, transcript: Column, has_audio: Column, audio_error: Column, no_input: str = NO_INPUT
) -> Column:
    """First reason to refuse a request, or NULL."""
    no_text = F.coalesce(F.length(text_input), F.lit(0)) == 0
    no_transcript = F.coalesce(F.length(transcript), F.lit(0)) == 0
    return (
        F.when(~has_audio & no_text, F.lit(no_input))
        .when(has_audio & audio_error.isNotNull(), audio_error)
        .when(no_text & no_transcript, F.lit(NO_TEXT))
    )


def respond(
    df: DataFrame,
    text_input: Column,
    transcript: Column | None = None,
    audio_error: Column | None = None,
    corrector: Callable[[Column], Column] = cascade,
    scorer: Scorer | None = None,
    prefer_audio: bool = False,
    no_input: str = NO_INPUT,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """Add the response fields to a request table.

    Scores with ``scorer`` when given, otherwise by the share of changed words. The same function
    serves batch tables and streams. A Python model (``load_corrector``, followed by ``rules``) sees
    each distinct chunk of a table once, and the chunks of a stream row by row; it is not asked about
    refused requests.
    """
    heard = F.lit(None).cast("string") if transcript is None else transcript
    failure = F.lit(None).cast("string") if audio_error is None else audio_error
    has_audio = heard.isNotNull() | failure.isNotNull()
    chosen = df.withColumns(
        {
            "error": request_error(text_input, heard, has_audio, failure, no_input),
            "transcription": F.coalesce(heard, F.lit("")),
            "originalText": choose_text(text_input, heard, prefer_audio),
        }
    )
    if load_corrector is None:
        fixed = chosen.withColumn("correctedText", corrector(F.col("originalText")))
    else:
        asked = chosen.withColumn("_asked", F.when(F.col("error").isNull(), F.col("originalText")))
        fixed = corrected(asked, "_asked", load_corrector=load_corrector, rules=rules, output="correctedText").drop("_asked")
    if scorer is None:
        score = rule_score(F.col("originalText"), F.col("correctedText"))
        scored = fixed.withColumn("grammarScore", score)
    else:
        scored = model_score(fixed, "originalText", scorer, "grammarScore")
    refused = F.col("error").isNotNull()
    empty = {c: F.when(refused, F.lit("")).otherwise(F.col(c)) for c in FIELDS[:3]}
    return scored.withColumns(
        {**empty, "grammarScore": F.when(refused, F.lit(0.0)).otherwise(F.col("grammarScore"))}
    )


def response_json(fields: tuple[str, ...] = FIELDS) -> Column:
    """Response document; ``error`` is absent when NULL."""
    return F.to_json(F.struct(*[F.col(c) for c in fields]))
