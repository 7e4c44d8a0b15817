"""Quality classifier: gradients, whole texts and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingomark.llm import quality

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score int, parts int, label int, held_out int"


def plain_scores(texts, net):
    """Scores by convolving each text alone, position by position, over all of its bytes."""
    weights = net["filters"].reshape(-1, quality.FILTERS).astype(np.float64)
    out = []
    for text in texts:
        size = max(1, -(-len(text) // quality.SEGMENT)) * quality.SEGMENT
        data = np.frombuffer(text.ljust(size + quality.WIDTH, b"\0"), np.uint8)
        vectors = net["vectors"].astype(np.float64)[data]
        answers = np.stack([vectors[k : k + quality.WIDTH].ravel() @ weights for k in range(size)])
        most = np.maximum(answers, 0).reshape(-1, quality.SEGMENT, quality.FILTERS).max(1)
        chunks = [most[k : k + 2].max(0) for k in range(max(1, len(most) - 1))]
        logits = []
        for k, chunk in enumerate(chunks):
            share = min(max(len(text) - k * quality.SEGMENT, 0), 2 * quality.SEGMENT) / (2 * quality.SEGMENT)
            hidden = np.maximum(np.append(chunk, share) @ net["inner"] + net["inner_bias"], 0)
            logits.append(float((hidden @ net["outer"] + net["outer_bias"])[0]))
        out.append(1 / (1 + np.exp(-np.mean(logits))))
    return np.array(out)


@pytest.fixture(scope="module")
def net():
    return quality.start_net(np.random.default_rng(5))


def test_gradients_against_differences(net):
    exact = {k: v.astype(np.float64) for k, v in net.items()}
    exact["inner_bias"] += 0.1  # away from where an empty text's hidden values have a kink
    texts = [quality.excerpts(t) for t in (b"", b"some words " * 3, b"other words, " * 200, "Größe ".encode() * 900)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    _, slopes = quality.gradients(texts, labels, exact)
    for name, slope in slopes.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        losses = []
        for move in (1e-4, -1e-4):
            exact[name][at] += move
            losses.append(quality.gradients(texts, labels, exact)[0])
            exact[name][at] -= move
        assert slope[at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=0.02)


def test_scores_read_whole_texts(net):
    rng = np.random.default_rng(6)
    sizes = [0, 1, 7, 255, 256, 257, 511, 512, 513, 5000]
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in sizes]
    got = quality.score_texts(texts, net)
    assert np.allclose(got, plain_scores(texts, net), atol=1e-4)
    assert np.allclose(got, [quality.score_texts([t], net)[0] for t in texts], atol=1e-5)
    long = b"plain words " * 200_000
    assert len(long) > 4 * quality.BLOCK
    changed = long[:-50] + bytes(range(50))
    one, other = quality.score_texts([long, changed], net)
    first, second, _ = quality.chunk_table(np.array([-(-len(long) // quality.SEGMENT)]))
    assert one != other and second[-1] == first[-1] + 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels, epochs=6)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25
    ranks = np.argsort(np.argsort([r.score for r in rows]))
    mark = np.array([r.quality for r in rows])
    assert (ranks[mark == 1].mean() - ranks[mark == 0].mean()) / len(rows) + 0.5 > 0.98


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted(map(tuple, quality.quality_scores(docs, own, epochs=1).collect())) for own in (labels, turned))
    assert one == other


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\0\0"), (None, "words"), (4, "w" * 1_000_000), (5, "twice"), (5, "twice"), (6, "日本語 é")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    marks = [(1, 0, 1), (2, None, 1), (None, 1, 1), (4, 1, 1), (5, 1, 1), (5, 0, 1), (6, 0, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, score int")
    got = quality.quality_scores(docs, labels, epochs=1).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert by_id[1].score == by_id[2].score and by_id[None].held_out is False
    assert quality.quality_scores(docs.limit(0), labels, epochs=1).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    for most in (1, 2, 4):  # labelled ids without a document count, too
        parts, own = quality.training_sample(docs, labels, rows=most)
        assert len(parts) == len(own) <= most and all(len(p) <= quality.CHUNKS for p in parts)
    parts, own = quality.training_sample(docs, labels, rows=99)
    known = {1: 0.0, 4: 1.0, 5: 1.0, 6: 0.0}
    assert sorted(own) == sorted(known[i] for i, _ in rows if i in known and zlib.crc32(str(i).encode()) % 5)
