"""Batch scoring: manifest and clips, or transcripts, to detail and delivery tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.contracts import (
    AUDIO_COLUMNS,
    EMBEDDING_SIZE,
    TEXT_COLUMNS,
    require_columns,
    widen,
)
from lingomark.functions.text import (
    SCORE_MAX,
    Rule,
    avg_word_len,
    build_prompt,
    clamp,
    grammar_ratio,
    is_nonblank,
    num_words,
    parse_score,
    rule_error_count,
    text_length,
    word_diff_score,
    words,
)
from lingomark.operators.apply_model import Predictor, apply_model, require_success
from lingomark.operators.cleaning import default_audio, drop_failed, failed_lines, keep_failed, require_rows
from lingomark.operators.embedding import hashed_embedding
from lingomark.operators.resolve import resolve
from lingomark.operators.training import Scorer, apply_scorer
from lingomark.plans.correction import cascade, corrected
from lingomark.session import stage
from lingomark.sources.audio import FEATURE_FIELDS, audio_features, feature_table, split_by_size
from lingomark.sources.tables import label_table

# Bits of the filter by which a manifest prunes the clip scan: 2 MB, however many names there are.
FILTER_BITS = 24

# Fixed value: prompts per call of the language model.
RUBRIC_BATCH = 5

Corrector = Callable[[Column], Column]


def with_text_features(df: DataFrame, text: str, at_least_one: bool = False) -> DataFrame:
    """Add ``num_words, avg_word_len, text_length``; the words are split once."""
    tokens = F.col("_words")
    n = F.array_size(tokens)
    return (
        df.withColumn("_words", words(F.col(text)))
        .withColumns(
            {
                "num_words": F.greatest(n, F.lit(1)) if at_least_one else n,
                "avg_word_len": avg_word_len(tokens),
                "text_length": text_length(F.col(text)),
            }
        )
        .drop("_words")
    )


def rule_score(text: Column, corrected: Column) -> Column:
    """Built-in score: share of unchanged words, on the scale 0 to 5."""
    return clamp(word_diff_score(text, corrected) * SCORE_MAX)


def correct_and_score(
    df: DataFrame,
    text: str,
    corrector: Corrector = cascade,
    error: str | None = None,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
    correction_error: str | None = None,
) -> DataFrame:
    """Add ``corrected_text`` and ``grammar_score``; failed rows keep their error as text.

    ``load_corrector`` is a Python model to correct with, followed by ``rules``; ``correction_error``
    names a column for its failures, which leave the text as it is.
    """
    fixed = corrected(df, text, corrector, load_corrector, rules, "corrected_text", correction_error)
    scored = fixed.withColumn("grammar_score", rule_score(F.col(text), F.col("corrected_text")))
    if error is None:
        return scored
    return keep_failed(scored, [text, "corrected_text"], "grammar_score", error)


def results_from_transcripts(
    transcripts: DataFrame,
    corrector: Corrector = cascade,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """Detail table of a transcript table; ``error`` marks failed transcriptions when present."""
    error = "error" if "error" in transcripts.columns else None
    done = correct_and_score(transcripts, "transcript", corrector, error, load_corrector, rules)
    return done.select("filename", "transcript", "grammar_score", "corrected_text")


def flagship(transcripts: DataFrame) -> DataFrame:
    """Delivery table of the whole text flow: chunk, correct, compare, score, project."""
    scored = correct_and_score(transcripts, "transcript")
    return scored.select("filename", F.col("grammar_score").alias("label"))


def _manifest_clips(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Clips the manifest may name.

    Clip bytes are never shuffled: a bitmap of name hashes, of one size for every manifest, drops
    nearly all clips that nobody asked for, and the later join with the manifest drops the others.
    """
    low = F.xxhash64("filename").bitwiseAND((1 << FILTER_BITS) - 1)
    part, place = F.shiftright(low, 15), low.bitwiseAND((1 << 15) - 1)
    named = manifest.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    # At most 2**(FILTER_BITS - 15) rows of 4096 bytes.
    found = files.join(F.broadcast(named), part == F.col("_part"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*files.columns)


def hear_clips(
    files: DataFrame, load_recogniser: Callable[[], Predictor], recognise: str = "content", limit: int | None = None
) -> DataFrame:
    """One row per clip: audio features, ``transcript``, ``audio_error`` and ``clip_error``.

    ``recognise`` names the column the recogniser gets; ``limit`` is the size of clips that uploads
    may have. Row by row, so it also runs on streams.
    """
    accepted, rejected = split_by_size(files, limit)
    heard = accepted.select(
        "filename",
        audio_features(F.col("content")).alias("_audio"),
        apply_model(F.col(recognise), load_recogniser).alias("_heard"),
    ).select(
        "filename",
        *[F.col(f"_audio.{c}").alias(c) for c in FEATURE_FIELDS],
        F.col("_heard.value").alias("transcript"),
        F.col("_audio.error").alias("audio_error"),
        F.col("_heard.error").alias("clip_error"),
    )
    refused = rejected.select("filename", F.col("error").alias("audio_error"), F.col("error").alias("clip_error"))
    return heard.unionByName(refused, allowMissingColumns=True)


def transcribe(
    manifest: DataFrame, files: DataFrame, load_recogniser: Callable[[], Predictor], recognise: str = "content"
) -> DataFrame:
    """Manifest columns with ``transcript`` and ``error``; staged, since two tables are written from it."""
    asked = _manifest_clips(manifest, files).select(
        "filename", apply_model(F.col(recognise), load_recogniser).alias("_heard")
    )
    heard = asked.select(
        "filename",
        F.col("_heard.value").alias("transcript"),
        F.col("_heard.error").alias("_failure"),
        F.lit(True).alias("_found"),
    )
    joined = resolve(manifest, heard, "filename", "_found")
    done = joined.withColumn("error", F.coalesce("error", "_failure")).drop("_failure", "_found")
    return stage(done, "transcripts")


def clip_table(
    manifest: DataFrame, files: DataFrame, load_recogniser: Callable[[], Predictor], recognise: str = "content"
) -> DataFrame:
    """:func:`hear_clips` of the clips in a manifest, written once.

    The tables derived from it would otherwise run the recogniser again.
    """
    return stage(hear_clips(_manifest_clips(manifest, files), load_recogniser, recognise), "clips")


# Columns of the audio job that stand behind the audio feature names, by variant.
AUDIO_VARIANTS = {
    "framed": ("duration", "zero_crossing_rate", "spectral_centroid", "rmse"),
    "global": ("duration", "zero_crossing_global", "mel_power_mean", "rms_global"),
}


def feature_dataset(
    transcripts: DataFrame,
    files: DataFrame,
    corrector: Corrector = cascade,
    variant: str = "framed",
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """Training table: audio features, text features, difference score and label per clip.

    ``transcripts`` has ``filename, transcript, label``. Rows that failed stay, with ``error`` set;
    :func:`~lingomark.operators.cleaning.drop_failed` and ``failed_lines`` part them.
    """
    require_columns(transcripts, ["filename", "transcript", "label"])
    clips = feature_table(_manifest_clips(transcripts, files), with_tempo=False)
    audio = clips.select(
        "filename",
        *[F.col(source).alias(name) for source, name in zip(AUDIO_VARIANTS[variant], AUDIO_COLUMNS)],
        F.col("error").alias("audio_error"),
        F.lit(True).alias("_found"),
    )
    texts = with_text_features(transcripts, "transcript", at_least_one=True)
    texts = corrected(texts, "transcript", corrector, load_corrector, rules)
    texts = texts.withColumn(
        "grammar_score_model", word_diff_score(F.col("transcript"), F.col("corrected_text"))
    )
    joined = resolve(texts, audio, "filename", "_found")
    blank = F.when(~is_nonblank(F.col("transcript")), F.lit("No transcript"))
    # Rows the training cannot use: labels that are no number, clips too short for a feature.
    unlabelled = F.when(F.col("label").isNull(), F.lit("No numeric label"))
    short = F.when(reduce(or_, [F.col(c).isNull() for c in AUDIO_COLUMNS]), F.lit("Clip too short for audio features"))
    return joined.select(
        "filename",
        *AUDIO_COLUMNS,
        "grammar_score_model",
        F.col("transcript").alias("original_text"),
        "corrected_text",
        *TEXT_COLUMNS,
        "label",
        F.coalesce("error", "audio_error", blank, unlabelled, short).alias("error"),
    )


def training_table(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`feature_dataset` that can be trained on, and one log line per other row.

    A dataset of which nothing can be used is an error. Staged once, since both results are written.
    """
    made = stage(dataset, "features")
    usable = require_rows(drop_failed(made)).drop("error")
    return usable, failed_lines(made, "filename")


def with_error_features(df: DataFrame, text: str, rules: Sequence[Rule], n_words: Column | None = None) -> DataFrame:
    """Add ``num_errors`` (rule hits) and ``grammar_ratio`` (hits per word); ``n_words`` is the number of words, if known."""
    n_words = num_words(F.col(text)) if n_words is None else n_words
    counted = df.withColumn("num_errors", rule_error_count(F.col(text), rules))
    return counted.withColumn("grammar_ratio", grammar_ratio(F.col("num_errors"), n_words))


def full_vectors(df: DataFrame, text: str, rules: Sequence[Rule], size: int = EMBEDDING_SIZE) -> DataFrame:
    """The widest contract: text, rule and audio features as columns, the embedding as one array.

    Audio columns that are absent become 0, as does the score of a first model.
    """
    names = (*AUDIO_COLUMNS, "grammar_score_model")
    present = set(df.columns)
    ready = df.withColumns({c: F.lit(0.0) for c in names if c not in present})
    ready = with_error_features(with_text_features(default_audio(ready, names), text), text, rules, F.col("num_words"))
    return hashed_embedding(ready, text, size)


def full_features(df: DataFrame, text: str, rules: Sequence[Rule], size: int = EMBEDDING_SIZE) -> DataFrame:
    """:func:`full_vectors` with the embedding as ``size`` scalar columns, for wide exports."""
    return widen(full_vectors(df, text, rules, size), "embedding", size)


def model_score(df: DataFrame, text: str, scorer: Scorer, output: str = "grammar_score") -> DataFrame:
    """Score texts with a trained model: text features, audio features or zeros, no first-model score.

    Leaves the columns of ``df`` as they were, plus the score.
    """
    names = (*AUDIO_COLUMNS, "grammar_score_model")
    present = set(df.columns)
    ready = df.withColumns({c: F.lit(0.0) for c in names if c not in present})
    ready = with_text_features(default_audio(ready, names), text).na.fill(0, list(TEXT_COLUMNS))
    return apply_scorer(ready, scorer, output).select(*df.columns, output)


def rubric_scores(
    df: DataFrame, text: str, load: Callable[[], Predictor], batch_size: int = RUBRIC_BATCH
) -> DataFrame:
    """Ask a language model for a score per text; an unusable or failed reply is NULL."""
    reply = apply_model(build_prompt(F.col(text)), load, batch_size=batch_size)
    asked = df.withColumn("_reply", reply)
    return asked.withColumn("grammar_score", parse_score(F.col("_reply.value"))).drop("_reply")


def deliver(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Detail table in which every manifest row appears; rows without a clip carry error text.

    Results are joined after they are computed: once per clip however often the manifest names it.
    """
    found = results.withColumn("_found", F.lit(True))
    joined = resolve(manifest.select("filename"), found, "filename", "_found")
    kept = keep_failed(joined, ["transcript", "corrected_text"], "grammar_score")
    return kept.select("filename", "transcript", "grammar_score", "corrected_text")


def batch_job(
    manifest: DataFrame,
    files: DataFrame,
    load_recogniser: Callable[[], Predictor],
    scorer: Scorer | None = None,
    corrector: Corrector = cascade,
    recognise: str = "content",
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """Detail table of a manifest of clips.

    With ``load_corrector`` a Python model corrects each distinct chunk of the transcripts once,
    followed by ``rules``; a transcript it fails on stays as it is and scores as unchanged. A clip without usable features is scored with zeros for them, as long as it has a transcript;
    a clip that could not be transcribed keeps its error as text and scores 0.
    """
    clips = clip_table(manifest, files, load_recogniser, recognise)
    done = correct_and_score(clips, "transcript", corrector, load_corrector=load_corrector, rules=rules)
    if scorer is not None:
        done = model_score(done.drop("grammar_score"), "transcript", scorer)
    done = keep_failed(done, ["transcript", "corrected_text"], "grammar_score", "clip_error")
    return deliver(manifest, done.select("filename", "transcript", "grammar_score", "corrected_text"))


def directory_job(
    files: DataFrame,
    load_recogniser: Callable[[], Predictor],
    scorer: Scorer | None = None,
    corrector: Corrector = cascade,
    recognise: str = "content",
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
) -> DataFrame:
    """Label table of all clips of a folder, without a manifest: ``filename, transcript, label``.

    A clip that could not be transcribed has its error as text and label 0. A folder of clips that all
    failed, if there are many, is an error; one without clips gives an empty table.
    """
    heard = stage(hear_clips(files, load_recogniser, recognise), "clips")
    clips = require_success(heard, "clip_error")
    done = correct_and_score(clips, "transcript", corrector, load_corrector=load_corrector, rules=rules)
    if scorer is not None:
        done = model_score(done.drop("grammar_score"), "transcript", scorer)
    return label_table(keep_failed(done, ["transcript"], "grammar_score", "clip_error"))
