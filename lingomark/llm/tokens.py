"""Token counts per document from counts per distinct pre-token.

A document is split at ASCII white space, which the tokenizer's own pre-tokeniser never crosses. Each
Arrow block of documents is turned into a dictionary of distinct pre-tokens and per-document
frequencies; the tokenizer sees a distinct pre-token once per task, and the counts are joined back to
the frequencies and summed per document. No token ids leave the tokenizer and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
MEMO_BYTES = 64 << 20  # known pre-tokens of a task; beyond it the memo starts anew, results are the same
BLOCK_BYTES = 8 << 20
BATCH_CHARS = 1 << 18  # of pre-tokens encoded at a time: the encodings are far larger than their texts
LONG = 200  # pre-tokens of more characters are counted, but not kept


def _blocks(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive slices of about ``most`` bytes (a longer text is a slice of its own)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _batches(words: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive parts of about ``most`` characters, 16 more counted for each word."""
    start = size = 0
    for end, word in enumerate(words, 1):
        size += len(word) + 16
        if size >= most or end == len(words):
            yield words[start:end]
            start, size = end, 0


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has no bytes and no tokens. Special strings inside a text are found as the
    tokenizer does by default; none is added. Texts are never cut. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, int] = {}
        held = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            totals = []
            for block in _blocks(texts, BLOCK_BYTES):
                words = pc.ascii_split_whitespace(pc.fill_null(block, ""))
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                new = [w for w in distinct if w not in known]
                pieces: dict[str, int] = {}
                for some in _batches(new, BATCH_CHARS):
                    pieces.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                each = np.fromiter((known[w] if w in known else pieces[w] for w in distinct), np.int64, len(distinct))
                kept = {w: n for w, n in pieces.items() if len(w) <= LONG}
                size = sum(map(len, kept)) + 100 * len(kept)
                if held + size > MEMO_BYTES:
                    known, held = {}, 0
                known.update(kept)
                held += size
                # Frequencies of each document joined to the counts, as a sum over its positions.
                ends = words.offsets.to_numpy()
                running = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64))])
                totals.append(running[ends[1:] - ends[0]] - running[ends[:-1] - ends[0]])
            counts = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, sizes, pa.array(counts, pa.int64()), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
