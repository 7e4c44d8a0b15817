"""Ordering, joins, statistics, splits, cleaning and vectors against brute force."""

import hashlib
import math
import re
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingomark import contracts, session
from lingomark.functions import signal, vectors
from lingomark.operators import cleaning, embedding, ordering, resolve, split, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; one key owns a third of them."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return spark.range(3000).select(
        "id", key.alias("key"), ((F.col("id") * 7919) % 3001).alias("ts"), (F.col("id") % 11 / 4).alias("value")
    ).repartition(7)


def test_row_index(spark, skewed):
    rows = ordering.with_row_index(skewed, ["key", "ts"]).collect()
    expected = sorted(skewed.collect(), key=lambda r: (r["key"], r["ts"]))
    got = sorted(rows, key=lambda r: r["row_index"])
    assert [r["row_index"] for r in got] == list(range(3000))
    assert [r["id"] for r in got] == [r["id"] for r in expected]


def test_batch_numbers_and_positions(spark, skewed):
    numbered = ordering.with_batch_number(skewed, ["ts"], 8).collect()
    order = {r["ts"]: i for i, r in enumerate(sorted(numbered, key=lambda r: r["ts"]))}
    assert all(r["batch_no"] == order[r["ts"]] // 8 for r in numbered)
    short = spark.range(5).select((F.col("id") * 2).alias("b"))
    bound = ordering.bind_columns(spark.range(7).select((-F.col("id")).alias("a")), short, ["a"], ["b"])
    pairs = {(r["a"], r["b"]) for r in bound.collect()}
    assert pairs == {(-6, 0), (-5, 2), (-4, 4), (-3, 6), (-2, 8), (-1, None), (0, None)}


def test_latest_rows_of_a_hot_key(skewed, plan_of):
    newest = ordering.latest_rows(skewed, "key", [F.desc("ts"), F.desc("id")], 10)
    frame = skewed.toPandas().sort_values(["key", "ts", "id"], ascending=False)
    expected = {(r.key, r.id) for r in frame.groupby("key").head(10).itertuples()}
    assert {(r["key"], r["id"]) for r in newest.collect()} == expected
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(newest))


def test_head_rows_keep_only_a_heap(skewed, plan_of):
    head = ordering.head_rows(skewed, ["ts"], 3)
    assert [r["ts"] for r in head.collect()] == [0, 1, 2]
    assert "TakeOrderedAndProject" in plan_of(head)


def test_joins(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "filename string")
    files = spark.createDataFrame([("a", "/x/a"), ("b", "/x/b"), ("d", "/x/d")], "filename string, path string")
    found = resolve.resolve(manifest, files, "filename", "path").collect()
    assert sorted((r["filename"], r["error"]) for r in found if r["error"]) == [("c", "Audio file not found: c")]
    assert len(found) == 4
    assert resolve.existing(manifest, files, "filename").count() == 3
    assert [r["filename"] for r in resolve.missing(manifest, files, "filename").collect()] == ["c"]


def test_merge_prefers_the_right_table(spark):
    left = spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double")
    right = spark.createDataFrame([(1, 9.0, 4.0)], "k int, x double, z double")
    assert resolve.merge_features(left, right, "k").first().asDict() == {"k": 1, "x": 9.0, "y": 3.0, "z": 4.0}


def test_describe_equals_pandas(spark, skewed):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(0, 4, 501).astype(float)})
    frame.loc[:200, "b"] = 2.0
    frame.loc[5, "a"] = np.nan
    got = stats.describe(spark.createDataFrame(frame).repartition(6), ["a", "b"]).toPandas().set_index("column_name")
    expected = frame.describe()
    for column in ("a", "b"):
        for mine, theirs in zip(("count", "mean", "std", "min", "p25", "p50", "p75", "max"), expected.index):
            assert got.loc[column, mine] == pytest.approx(expected.loc[theirs, column])


@pytest.mark.parametrize("n", [3, 500, 30000])
def test_bracketed_quantiles(spark, n):
    """The sketch path and its fallback: few or many rows, a value that fills a third of them, NULLs."""
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.full(n, 2.0)})
    frame.loc[: n // 3, "a"] = 0.1
    rows = spark.createDataFrame(frame).repartition(5)
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(r["column_name"], r["q"]): r["value"] for r in stats.exact_quantiles(rows, list("abc"), at).collect()}
    assert got == pytest.approx({(c, q): frame[c].quantile(q) for c in "abc" for q in at})


@pytest.mark.parametrize("few", [8, 300])
def test_brackets_are_narrowed_until_few_values_are_left(spark, monkeypatch, few):
    """As on tables of many values: every bracket gets a sketch of its own, again and again."""
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "SKETCH_SIZE", 64)
    rng = np.random.default_rng(few)
    n = 40000
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.exponential(size=n), "c": rng.integers(0, 3, n).astype(float)})
    frame.loc[: n // 3, "b"] = 0.5
    frame.loc[7, "a"], frame.loc[8, "a"] = 1e300, np.nan
    at = (0.0, 0.01, 0.5, 0.999, 1.0)
    got = {(r["column_name"], r["q"]): r["value"] for r in stats.exact_quantiles(spark.createDataFrame(frame), list("abc"), at).collect()}
    assert got == pytest.approx({(c, q): frame[c].quantile(q) for c in "abc" for q in at})


def test_quantiles_of_tiny_columns(spark):
    one = spark.createDataFrame([(4.0,)], "a double")
    assert {r["value"] for r in stats.exact_quantiles(one, ["a"]).collect()} == {4.0}
    two = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    got = {r["q"]: r["value"] for r in stats.exact_quantiles(two, ["a"]).collect()}
    assert got == {0.25: 1.25, 0.5: 1.5, 0.75: 1.75}


def test_metrics(spark):
    y, p = [1.0, 2.0, 4.0, 5.0], [1.5, 2.0, 3.0, 5.5]
    rows = spark.createDataFrame(list(zip(range(4), y, p)), "id long, y double, p double")
    got = stats.error_metrics(rows, "y", "p").first()
    errors = [(a - b) ** 2 for a, b in zip(y, p)]
    assert got["mse"] == pytest.approx(statistics.mean(errors))
    assert got["mae"] == pytest.approx(statistics.mean(abs(a - b) for a, b in zip(y, p)))
    assert got["r2"] == pytest.approx(1 - sum(errors) / (4 * statistics.pvariance(y)))
    constant = rows.withColumn("y", F.lit(3.0))
    assert stats.error_metrics(constant, "y", "p").first()["r2"] is None
    record = stats.metrics_record(rows, "id", "y", "p")
    assert record.count() == 1
    assert record.first()["val_predictions"] == p
    blocks = stats.metrics_record(rows, "id", "y", "p", block_size=3).orderBy("block_no").collect()
    assert [b["val_predictions"] for b in blocks] == [p[:3], p[3:]]
    assert {b["n_samples"] for b in blocks} == {4}


def test_any_null_and_counts(spark):
    rows = spark.createDataFrame(
        [(1.0, None, "x"), (float("nan"), 2.0, None)], "a double, b double, error string"
    ).withColumn("c", F.lit(1))
    got = {r["column_name"]: r["has_null"] for r in stats.any_null(rows, ["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": True, "c": False}
    counts = stats.progress_counts(rows).first().asDict()
    assert counts == {"found": 2, "processed": 1, "failed": 1}


@pytest.mark.parametrize("share", [0.15, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("n", [1, 7, 40, 1000])
def test_split_is_exact_and_ordered_by_hash(spark, n, share):
    parts = split.exact_split(spark.range(n), "id", share).collect()
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    wanted = set(order[: math.ceil(n * share)])
    assert len(parts) == n
    assert {r["id"] for r in parts if r["split"] == "val"} == wanted


def test_copies_of_a_key_stay_together(spark):
    """A third of all rows share one key; they fall on one side and the other keys are not lost."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"))
    parts = split.exact_split(rows, "id", 0.2).collect()
    sides = {r["split"] for r in parts if r["id"] == -1}
    assert len(parts) == 900 and len(sides) == 1
    order = sorted((r["id"] for r in rows.collect()), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    last = hashlib.md5(f"42:{order[179]}".encode()).hexdigest()
    assert all((hashlib.md5(f"42:{r['id']}".encode()).hexdigest() <= last) == (r["split"] == "val") for r in parts)


def test_split_does_not_depend_on_partitioning(spark):
    base = spark.range(500)
    first = {(r["id"], r["split"]) for r in split.exact_split(base.repartition(3), "id", 0.2).collect()}
    second = {(r["id"], r["split"]) for r in split.exact_split(base.repartition(11), "id", 0.2).collect()}
    assert first == second


def test_target_mean(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0), (4, float("nan"))], "id int, y double")
    filled = {r["id"]: r["y"] for r in cleaning.fill_target_mean(rows, "y").collect()}
    assert filled == {1: 2.0, 2: 3.0, 3: 4.0, 4: 3.0}
    known = cleaning.fill_target_mean(rows, "y", known=rows.where("id = 1"))
    assert {r["id"]: r["y"] for r in known.collect()}[2] == 2.0


def test_fills_and_policies(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, None), ("b", None, "bad"), ("c", float("nan"), None)], "t string, x double, error string"
    )
    filled = cleaning.fill_features(rows, ["x"])
    assert [r["x"] for r in filled.orderBy("t").collect()] == [1.0, 0.0, 0.0]
    assert [r["t"] for r in cleaning.drop_failed(rows).orderBy("t").collect()] == ["a", "c"]
    assert [r["value"] for r in cleaning.failed_lines(rows, "t").collect()] == ["b: bad"]
    kept = cleaning.keep_failed(filled, ["t"], "x").collect()
    assert [(r["t"], r["x"]) for r in kept] == [("a", 1.0), ("Error: bad", 0.0), ("c", 0.0)]
    with pytest.raises(ValueError, match="No features"):
        cleaning.require_rows(rows.where("false"))
    assert cleaning.require_rows(rows) is rows


def test_contract_checks(spark):
    row = spark.createDataFrame([(1, 2.0, 3)], "text_length int, avg_word_len double, num_words int")
    ordered = contracts.select_contract(row, contracts.contract_columns("basic3"))
    assert ordered.columns == ["num_words", "avg_word_len", "text_length"]
    with pytest.raises(ValueError, match=r"\['duration'"):
        contracts.require_columns(row, contracts.contract_columns("hybrid7"))
    with pytest.raises(ValueError, match="emb_"):
        contracts.prefixed_columns(row)
    assert len(contracts.contract_columns("emb384")) == 384
    assert contracts.contract_columns("full")[:3] == ("num_words", "num_errors", "grammar_ratio")
    listed = contracts.schema_listing(row).collect()
    assert [(r["column_name"], r["data_type"]) for r in listed][0] == ("text_length", "int")


def test_widen_and_narrow(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.5, 2.5])], "id int, e array<double>")
    wide = contracts.widen(rows, "e", 3)
    assert wide.columns == ["id", "emb_0", "emb_1", "emb_2"]
    assert contracts.narrow(wide, "e").first()["e"] == [0.5, 1.5, 2.5]


def test_vector_guards_and_noise(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0])],
        "id long, e array<double>",
    )
    guarded = rows.withColumn("e", vectors.guard(F.col("e"), 2))
    got = {r["id"]: r["e"] for r in guarded.collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0]}
    filled = {r["id"]: r["e"] for r in embedding.replace_zero_vectors(guarded, "id", "e", 2).collect()}
    assert filled[1] == [1.0, 2.0]
    assert all(v != 0 and abs(v) < 0.1 for i in (2, 3, 4, 5) for v in filled[i])
    again = embedding.replace_zero_vectors(guarded.repartition(5), "id", "e", 2)
    assert {r["id"]: r["e"] for r in again.collect()} == filled


def test_noise_distribution(spark):
    draws = spark.range(300).select(F.explode(vectors.noise(F.col("id"), 200)).alias("v"))
    row = draws.agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert abs(row["m"]) < 2e-4 and row["s"] == pytest.approx(0.01, rel=0.02)


def test_masked_mean(spark):
    hidden = [[1.0, 2.0], [3.0, 4.0], [100.0, 100.0]]
    rows = spark.createDataFrame([(hidden, [1, 1, 0]), (hidden, [0, 0, 0])], "h array<array<double>>, m array<int>")
    got = [r["v"] for r in rows.select(vectors.masked_mean(F.col("h"), F.col("m"), 2).alias("v")).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0]]


def test_pooled_vectors(spark, skewed):
    rows = skewed.select("key", F.array("value", "ts").cast("array<double>").alias("e"), (F.col("id") % 2).alias("m"))
    pooled = stats.collect_vectors(stats.pooled_vectors(rows, "key", "e", F.col("m")), "key")
    frame = skewed.toPandas()
    kept = frame[frame["id"] % 2 == 1].groupby("key")[["value", "ts"]].mean()
    for row in pooled.collect():
        expected = kept.loc[row["key"]].tolist() if row["key"] in kept.index else [0.0, 0.0]
        assert row["embedding"] == pytest.approx(expected)


def test_signal_functions(spark):
    wave = [0.5, -0.5, 0.0, 0.25, 0.25]
    rows = spark.createDataFrame([(wave,), ([0.5],), ([],)], "s array<float>")
    zcr = [r[0] for r in rows.select(signal.zero_crossing_global(F.col("s"))).collect()]
    assert zcr == [pytest.approx(np.abs(np.diff(np.sign(wave))).mean()), None, None]
    rms = [r[0] for r in rows.select(signal.rms_global(F.col("s"))).collect()]
    assert rms == [pytest.approx(np.sqrt(np.mean(np.square(wave)))), 0.5, None]
    frames = rows.select(signal.frames(F.col("s"), 3, 2).alias("f")).collect()
    assert [r["f"] for r in frames] == [[[0.5, -0.5, 0.0], [0.0, 0.25, 0.25]], [], []]


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "  "), (3, None), (4, "a b a " * 1000)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in embedding.hashed_embedding(rows, "t", 384).collect()}
    assert all(len(v) == 384 for v in got.values())
    assert sum(v * v for v in got[1]) == pytest.approx(1.0)
    assert set(got[2]) == set(got[3]) == {0.0}
    assert got[4] == pytest.approx(got[1])
    bucket = int(hashlib.md5(b"a").hexdigest()[:8], 16) % 384
    assert got[1][bucket] == pytest.approx(2 / math.sqrt(5))


def test_user_encoder(spark):
    def load():
        def predict(texts):
            out = []
            for t in texts:
                if t == "bad":
                    raise ValueError("cannot encode")
                out.append([1.0] if t == "short" else [float(len(t)), float("nan") if t == "nan" else 1.0])
            return out

        return predict

    rows = spark.createDataFrame([("ok",), ("bad",), ("short",), ("nan",), (" ",), (None,)], "t string")
    done = embedding.embed_texts(rows, "t", load, 2).collect()
    assert [(r["embedding"], r["error"]) for r in done] == [
        ([2.0, 1.0], None), ([0.0, 0.0], "cannot encode"), ([0.0, 0.0], None),
        ([0.0, 0.0], None), ([0.0, 0.0], None), ([0.0, 0.0], None),
    ]


def test_stage_and_spread(spark):
    rows = spark.range(10)
    staged = session.stage(rows, "test")
    assert sorted(r["id"] for r in staged.collect()) == list(range(10))
    assert session.scratch_root(spark) in staged.inputFiles()[0]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert session.spread(docs).rdd.getNumPartitions() == 8
    assert session.spread(docs, bytes_per_task=1).count() == docs.count()


def test_split_with_null_keys(spark):
    rows = spark.createDataFrame([(None if k % 2 else k,) for k in range(100)], "k long")
    parts = {r["split"]: r["count"] for r in split.exact_split(rows, "k", 0.2).groupBy("split").count().collect()}
    assert sum(parts.values()) == 100 and parts["val"] >= 20


def test_describe_keeps_columns_without_values(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = {r["column_name"]: r for r in stats.describe(rows, ["a", "b"]).collect()}
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None and got["a"]["mean"] == 2.0


@pytest.mark.parametrize("block", [1 << 22, 20])
def test_rule_matches_equal_the_fold(spark, monkeypatch, block):
    from lingomark.functions import text
    from lingomark.operators import rules

    monkeypatch.setattr(rules, "BLOCK_BYTES", block)
    words = ["the", "cat", "the the", "cats", "a", "ab", "été"]
    listed = [(k, f"w{k}", text.word_rule(w, "").pattern, w, True) for k, w in enumerate(words)]
    listed += [
        (20, "marks", "[!?]{2,}", None, False), (21, "vowel", "([aA]) ([aeiou])", " ", None),
        (22, "cat", "cat", "cat", False), (23, "empty literal", "x+", "", False), (24, "again", "the", "the", None),
    ]
    table = spark.createDataFrame(listed, "position bigint, rule_id string, pattern string, literal string, whole boolean")
    texts = ["the the the cat", "cats and a apple!! concat été_ été", None, "", "ab ab aba_ab xx", "THE the_ 1the the1 ?!x"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    got = {(r["id"], r["rule_id"]): r["hits"] for r in rules.rule_matches(docs, "id", "t", table).collect()}
    counted = docs.select("id", F.explode(text.rule_hits(F.col("t"), [text.Rule(r[1], r[2], "") for r in listed])).alias("h"))
    want = {(r["id"], r["h"]["rule_id"]): r["h"]["hits"] for r in counted.where("h.hits > 0").collect()}
    assert got == want and got[0, "w2"] == 1 and got[0, "w0"] == 3
    assert rules.rule_matches(docs, "id", "t", table.limit(0)).count() == 0
    assert rules.rule_matches(docs.limit(0), "id", "t", table).count() == 0


def test_split_narrows_down_to_one_digest(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") % 97).alias("id"))
    plain = {(r["id"], r["split"]) for r in split.exact_split(rows, "id", 0.3).collect()}
    monkeypatch.setattr(split, "FEW", 0)
    monkeypatch.setattr(split, "DIGITS", 1)
    assert {(r["id"], r["split"]) for r in split.exact_split(rows, "id", 0.3).collect()} == plain
    assert split.exact_split(rows.limit(0), "id", 0.3).count() == 0

def test_rule_matches_joins_whole_words(spark, monkeypatch):
    """Dictionaries of plain words build no automaton, pass no driver and move no text."""
    from lingomark.functions import text
    from lingomark.operators import rules

    built = []
    monkeypatch.setattr(rules, "_scan", lambda rows, block: built.append(block.value))
    words = ["cat", "cats", "a_1", "no", "cat"]
    listed = [(k, f"w{k}", text.word_rule(w, "").pattern, w, True) for k, w in enumerate(words)]
    table = spark.createDataFrame(
        [*listed, (9, "marks", "[!?]{2,}", None, False)],
        "position bigint, rule_id string, pattern string, literal string, whole boolean",
    )
    # Keys repeat and are null: every row counts for itself.
    docs = spark.createDataFrame([(1, "cat cat-cats?!"), (1, "cat a_1!!"), (None, "été cat_ xcat cats"), (2, None)], "id int, t string")
    done = rules.rule_matches(docs, "id", "t", table)
    got = sorted((str(r["id"]), r["rule_id"], r["hits"]) for r in done.collect())
    assert got == [
        ("1", "marks", 1), ("1", "marks", 1), ("1", "w0", 1), ("1", "w0", 2), ("1", "w1", 1), ("1", "w2", 1),
        ("1", "w4", 1), ("1", "w4", 2), ("None", "w1", 1),
    ]
    assert built == []
    runs = rules.word_runs(docs.coalesce(1), "id", "t")
    assert sorted((r["literal"], sorted((str(x["key"]), x["hits"]) for x in r["rows"])) for r in runs.collect()) == [
        ("a_1", [("1", 1)]), ("cat", [("1", 1), ("1", 2)]), ("cat_", [("None", 1)]), ("cats", [("1", 1), ("None", 1)]),
        ("t", [("None", 1)]), ("xcat", [("None", 1)]),
    ]
    for piece in (1, 2, 3, 100):
        assert rules.count_runs("cat cats,_1 cat", piece) == {"cat": 2, "cats": 1, "_1": 1}


def test_rule_matches_with_many_parts_of_words(spark, monkeypatch):
    """The same hits, whether literals are looked for one by one or by the automaton."""
    from lingomark.operators import rules

    listed = [(0, "a", "a+", "a", False), (1, "b", "bb", "bb", False), (2, "a b", "a b(?![A-Za-z0-9_])", "a b", True), (3, "", None, "c", False)]
    table = spark.createDataFrame(listed, "position bigint, rule_id string, pattern string, literal string, whole boolean")
    docs = spark.createDataFrame([(1, "aa bbb"), (2, "a b c a b"), (3, "")], "id int, t string")
    want = {(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "a b", 2)}
    for few in (32, 1):
        monkeypatch.setattr(rules, "FEW", few)
        assert {tuple(r) for r in rules.rule_matches(docs, "id", "t", table).collect()} == want


def test_hashed_embedding_hashes_words_once(spark, monkeypatch):
    """A task works a word out once while it keeps it; blocks and a full cache leave the vectors alone."""
    from lingomark.functions import text

    asked = []
    plain = hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda word: asked.append(word) or plain(word))
    known = embedding.Buckets(384)
    assert len({known[w] for w in ["the", "cat", "the"] * 50}) == 2 and asked == [b"the", b"cat"]
    monkeypatch.undo()
    texts = ["the cat\x1cthe\x85été　x", None, "", "the " * 99 + "cat", "\ta b\nc  d "] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(2)
    tokens = rows.select("id", F.explode(F.slice(text.words("t"), 1, 90)).alias("w"))
    counts = {(r[0], r[1]): r[2] for r in tokens.groupBy("id", text.token_hash(F.col("w")) % 7).count().collect()}
    for cells, kept in ((1 << 20, 1 << 18), (7, 1)):
        monkeypatch.setattr(embedding, "CELLS", cells)
        monkeypatch.setattr(embedding, "KNOWN_WORDS", kept)
        done = embedding.hashed_embedding(rows, "t", 7, max_tokens=90)
        assert done.columns == ["id", "t", "embedding"]
        for r in done.collect():
            own = [counts.get((r["id"], b), 0) for b in range(7)]
            length = math.sqrt(sum(n * n for n in own)) or 1.0
            assert r["embedding"] == [n / length for n in own]
