"""Document quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes. Each byte has a learned vector; learned filters over ``WIDTH`` bytes run
over every position of the whole text. Their positive responses are max-pooled over segments of
``SEGMENT`` positions, two neighbouring segments form a chunk, so that chunks overlap by half, and a
small layer turns a chunk's pooled responses into a logit. The mean logit of a document's chunks gives
its probability. The network is fitted on a sample of labelled documents of bounded number, of which
each gives a bounded number of chunks; scores read all bytes of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, SEGMENT = 8, 256  # bytes of a filter, positions of a segment; a multiple of the width
VECTOR, FILTERS, HIDDEN = 8, 32, 16
SAMPLE, CHUNKS, EPOCHS, BATCH = 4000, 8, 10, 32
BLOCK = 1 << 19  # bytes convolved at a time
LIMIT = 0.3
SEED = 7


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole segments (at least one), and segments per text."""
    segments = np.fromiter((max(1, -(-len(t) // SEGMENT)) for t in texts), np.int64, len(texts))
    filled = b"".join(t.ljust(int(n) * SEGMENT, b"\0") for t, n in zip(texts, segments, strict=True))
    return np.frombuffer(filled + bytes(WIDTH), np.uint8), segments


def pool(data: np.ndarray, ends: np.ndarray, net: dict) -> np.ndarray:
    """Largest positive response per segment and filter.

    ``ends`` marks segments that end a text: their last windows see zeros instead of the next text.
    Windows that start at one offset modulo the width do not overlap, so each offset is one product of
    the byte vectors with the filters. Zero bytes, the padding included, have the zero vector.
    """
    count = (len(data) - WIDTH) // SEGMENT
    most = np.zeros((count, FILTERS), np.float32)
    weights = net["filters"].reshape(WIDTH * VECTOR, FILTERS)
    per = SEGMENT // WIDTH
    step = BLOCK // SEGMENT
    for first in range(0, count, step):
        last = min(count, first + step)
        vectors = net["vectors"][data[first * SEGMENT : last * SEGMENT + WIDTH]]
        stops = np.flatnonzero(ends[first:last])
        for offset in range(WIDTH):
            windows = vectors[offset : offset + (last - first) * SEGMENT].reshape(-1, WIDTH * VECTOR)
            answers = (windows @ weights).reshape(last - first, per, FILTERS)
            if offset and len(stops):
                edge = windows.reshape(last - first, per, WIDTH, VECTOR)[stops, -1].copy()
                edge[:, WIDTH - offset :] = 0
                answers[stops, -1] = edge.reshape(len(stops), -1) @ weights
            np.maximum(most[first:last], answers.max(1), out=most[first:last])
    return most


def pool_excerpts(rows: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """Largest positive response per excerpt and filter, and the position it lies at."""
    width = 2 * SEGMENT
    most = np.zeros((len(rows), FILTERS), np.float32)
    where = np.zeros((len(rows), FILTERS), np.int64)
    weights = net["filters"].reshape(WIDTH * VECTOR, FILTERS)
    vectors = net["vectors"][rows]
    for offset in range(WIDTH):
        answers = vectors[:, offset : offset + width].reshape(len(rows), -1, WIDTH * VECTOR) @ weights
        best = answers.argmax(1)
        value = np.take_along_axis(answers, best[:, None], 1)[:, 0]
        better = value > most
        where[better] = best[better] * WIDTH + offset
        most[better] = value[better]
    return most, where


def chunk_table(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second segment of each chunk and its text. A text of one segment is one chunk."""
    chunks = np.maximum(segments - 1, 1)
    text = np.repeat(np.arange(len(segments)), chunks)
    start = np.repeat(np.cumsum(segments) - segments, chunks)
    first = start + np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return first, np.where(segments[text] > 1, first + 1, first), text


def filled_share(sizes: np.ndarray, first: np.ndarray, text: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Share of a chunk's two segments that its text fills."""
    begin = (first - (np.cumsum(segments) - segments)[text]) * SEGMENT
    return (np.clip(sizes[text] - begin, 0, 2 * SEGMENT) / (2 * SEGMENT)).astype(np.float32)


def _logits(pooled: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ net["inner"] + net["inner_bias"], 0)
    return hidden, hidden @ net["outer"] + net["outer_bias"]


def score_texts(texts: list[bytes], net: dict) -> np.ndarray:
    """Probability of label 1 of each text, from all its bytes."""
    out, start = np.zeros(len(texts)), 0
    while start < len(texts):  # blocks of whole texts
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= BLOCK):
            held += len(texts[end]) + SEGMENT
            end += 1
        some = texts[start:end]
        data, segments = padded(some)
        stops = np.zeros(int(segments.sum()), bool)
        stops[np.cumsum(segments) - 1] = True
        most = pool(data, stops, net)
        first, second, text = chunk_table(segments)
        share = filled_share(np.fromiter(map(len, some), np.int64, len(some)), first, text, segments)
        pooled = np.concatenate([np.maximum(most[first], most[second]), share[:, None]], 1)
        _, logits = _logits(pooled, net)
        mean = np.bincount(text, logits.ravel(), len(some)) / np.bincount(text, minlength=len(some))
        out[start:end] = 1 / (1 + np.exp(-np.clip(mean, -30, 30)))
        start = end
    return out


def excerpts(text: bytes, chunks: int = CHUNKS) -> list[bytes]:
    """At most ``chunks`` chunks of a training text, evenly spread; all of a short one."""
    whole = max(1, -(-len(text) // SEGMENT) - 1)
    picked = range(whole) if whole <= chunks else (k * (whole - 1) // (chunks - 1) for k in range(chunks))
    return [text[k * SEGMENT : (k + 2) * SEGMENT + WIDTH - 1] for k in picked]


def start_net(rng: np.random.Generator) -> dict[str, np.ndarray]:
    net = {
        "vectors": rng.normal(0, 0.5, (256, VECTOR)),
        "filters": rng.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH, VECTOR, FILTERS)),
        "inner": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS + 1, HIDDEN)),
        "inner_bias": np.zeros(HIDDEN),
        "outer": rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)),
        "outer_bias": np.zeros(1),
    }
    net["vectors"][0] = 0
    return {k: v.astype(np.float32) for k, v in net.items()}


def gradients(texts: list[list[bytes]], labels: np.ndarray, net: dict) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of documents, each a list of excerpts, and its gradients.

    Of all positions of a chunk only the largest response of each filter passes the loss on.
    """
    parts = [part for own in texts for part in own]
    text = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    width = 2 * SEGMENT
    length = width + WIDTH - 1
    rows = np.frombuffer(b"".join(p[:length].ljust(length, b"\0") for p in parts), np.uint8).reshape(-1, length)
    pooled, place = pool_excerpts(rows, net)
    share = np.array([min(len(p), width) / width for p in parts], np.float32)
    inputs = np.concatenate([pooled, share[:, None]], 1)
    hidden, logits = _logits(inputs, net)
    number = np.bincount(text, minlength=len(texts))
    mean = np.bincount(text, logits.ravel(), len(texts)) / number
    p = 1 / (1 + np.exp(-np.clip(mean, -30, 30)))
    loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
    d_logit = (((p - labels) / len(texts) / number)[text])[:, None].astype(np.float32)
    d_hidden = (d_logit @ net["outer"].T) * (hidden > 0)
    d_pooled = (d_hidden @ net["inner"].T)[:, :FILTERS] * (pooled > 0)
    codes = rows[np.arange(len(parts))[:, None, None], place[:, :, None] + np.arange(WIDTH)]  # parts, filters, width
    d_filters = np.einsum("pf,pfwv->wvf", d_pooled, net["vectors"][codes], optimize=True)
    d_vectors = np.zeros_like(net["vectors"])
    passed = d_pooled[:, :, None, None] * net["filters"].transpose(2, 0, 1)[None]
    for k in range(VECTOR):
        d_vectors[:, k] = np.bincount(codes.ravel(), passed[..., k].ravel(), 256)
    d_vectors[0] = 0
    return loss, {
        "vectors": d_vectors,
        "filters": d_filters,
        "inner": inputs.T @ d_hidden,
        "inner_bias": d_hidden.sum(0),
        "outer": hidden.T @ d_logit,
        "outer_bias": d_logit.sum(0),
    }


def train(texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The network after ``epochs`` passes of Adam in a fixed order; without both labels it stays as drawn,
    with a constant that answers the labels' share."""
    rng = np.random.default_rng(SEED)
    net = start_net(rng)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net["outer_bias"][:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        net["outer"][:] = 0
        return net
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    steps = epochs * -(-len(texts) // BATCH)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            _, slopes = gradients([texts[k] for k in some], labels[some], net)
            done += 1
            rate = 0.004 * (1 - (done - 1) / steps) + 1e-5
            for k, slope in slopes.items():
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.01 * (slope**2 - second[k])
                net[k] -= rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-7)
    return net


def held_out(doc_id: Column) -> Column:
    """True for documents that no label is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[list[list[bytes]], np.ndarray]:
    """Excerpts and labels of at most ``rows`` labelled documents that are not held out, spread by a hash.

    The driver gets at most ``rows`` times ``CHUNKS`` chunks, however long the documents are.
    """
    usable = F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    spread = F.xxhash64("doc_id"), F.col("doc_id")
    marked = labels.where(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    # At most ``rows`` ids and bits: small enough to broadcast whatever the tables.
    picked = marked.agg(F.max((F.col("quality") == 1).cast("int")).alias("label")).orderBy(*spread).limit(rows)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [excerpts((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array(parts, pa.list_(pa.binary())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "parts", "label"])

    sample = found.select("doc_id", "text", "label").mapInArrow(cut, "doc_id long, parts array<binary>, label int")
    chosen = sample.orderBy(*spread, F.xxhash64(F.to_json("parts"))).limit(rows).collect()
    return [[bytes(p) for p in r["parts"]] for r in chosen], np.array([r["label"] for r in chosen], np.float64)


def score_quality(docs: DataFrame, net: dict[str, np.ndarray], limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(2)]
            # Rounded, as the last digits depend on which texts share a product of matrices.
            scores = np.round(score_texts(texts, sent.value), 5)
            arrays = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= limit).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")
    )
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    A null text is scored as an empty one. Labels of held-out documents, null labels and null ids are not
    learned from; a document with several label rows counts as good if one says 1. Without labels of
    both kinds all scores equal the share of label 1 (one half without any). Repeated rows are scored
    each; other columns are ignored; an empty table gives an empty result.
    """
    return score_quality(docs, train(*training_sample(docs, labels, rows), epochs))
