"""Text embeddings: a built-in hashing encoder and the job around user encoders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingomark.contracts import EMBEDDING_SIZE
from lingomark.functions.text import is_nonblank
from lingomark.functions.vectors import guard, replace_zero, zeros
from lingomark.operators.apply_model import Predictor, apply_model

# Words whose buckets a task keeps at a time, and values of the vectors it returns at a time.
KNOWN_WORDS = 1 << 18
CELLS = 1 << 20


class Buckets(dict):
    """Bucket of a word by :func:`~lingomark.functions.text.token_hash`, worked out when it is first seen."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        bucket = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.size
        self[word] = bucket
        return bucket


def hashed_embedding(
    df: DataFrame,
    text: str,
    size: int = EMBEDDING_SIZE,
    output: str = "embedding",
    max_tokens: int | None = None,
) -> DataFrame:
    """Built-in encoder: L2-normalised counts of words hashed into ``size`` buckets.

    Blank texts get the zero vector. Works row by row; no vocabulary is fitted, and a task hashes a
    word once as long as it keeps it. All words count; ``max_tokens`` limits them to the first ones, like
    a model with a short input.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets(size)
        step = max(1, CELLS // size)
        for column in (batch[at : at + step] for batch in batches for at in range(0, len(batch), step)):
            vectors = np.zeros((len(column), size))
            for k, value in enumerate(column):
                # str.split parts texts at the same white space as functions.text.words.
                tokens = value.as_py().decode("utf-8", "replace").split()[:max_tokens]
                counts = np.bincount(np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens)), minlength=size)
                vectors[k] = counts / max(np.sqrt(float(counts @ counts)), 1.0)
            yield pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * size, vectors.ravel())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    encode = F.arrow_udf(run, returnType="array<double>").asNondeterministic()
    return df.withColumn(output, encode(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def embed_texts(
    df: DataFrame,
    text: str,
    load: Callable[[], Predictor],
    size: int = EMBEDDING_SIZE,
    output: str = "embedding",
) -> DataFrame:
    """User encoder over a text column.

    Blank, failing, wrongly sized and NaN results become zero vectors; the reason of a failure
    stays in ``error``.
    """
    asked = F.when(is_nonblank(F.col(text)), F.col(text))
    done = df.withColumn("_answer", apply_model(asked, load, "array<double>"))
    return (
        done.withColumn(output, F.coalesce(guard(F.col("_answer.value"), size), zeros(size)))
        .withColumn("error", F.col("_answer.error"))
        .drop("_answer")
    )


def replace_zero_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    return df.withColumn(vector, replace_zero(F.col(vector), F.col(key), size))
