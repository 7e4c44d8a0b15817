"""Model application with failing predictors, training, persistence and probing."""

import pytest
from pyspark.sql import functions as F

from lingomark import contracts
from lingomark.operators import apply_model, training
from lingomark.plans import batch, correction, request
from lingomark.functions import text


def failing(texts):
    calls = []

    def predict(batch):
        calls.append(list(batch))
        for t in batch:
            if t.startswith("bad"):
                raise ValueError(f"cannot read {t}")
            if t.startswith("oom"):
                raise RuntimeError("CUDA out of memory")
        return [t.upper() for t in batch]

    return apply_model.predict_guarded(predict, texts), calls


def test_one_bad_item_does_not_spoil_its_batch():
    done, _ = failing(["a", "bad1", "b", "c", "bad2"])
    assert done == [
        ("A", None), (None, "cannot read bad1"), ("B", None), ("C", None), (None, "cannot read bad2"),
    ]


def test_memory_errors_are_retried_three_times():
    done, calls = failing(["oom"])
    assert done == [(None, "CUDA out of memory")]
    assert len(calls) == 4


def test_memory_error_heals_with_smaller_batches():
    def predict(items):
        if len(items) > 2:
            raise MemoryError("out of memory")
        return [i * 2 for i in items]

    assert apply_model.predict_guarded(predict, [1, 2, 3, 4, 5]) == [(i * 2, None) for i in (1, 2, 3, 4, 5)]


def test_wrong_result_count_is_an_error():
    done = apply_model.predict_guarded(lambda items: [1], ["a", "b"])
    assert done == [(1, None), (1, None)]
    done = apply_model.predict_guarded(lambda items: [], ["a"])
    assert done[0][0] is None and "0 results" in done[0][1]


def upper():
    def predict(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    return predict


def test_apply_model_keeps_rows_and_nulls(spark):
    rows = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(100)] + [(100, "bad")], "id int, t string")
    out = rows.repartition(5).select("id", apply_model.apply_model(F.col("t"), upper).alias("a")).collect()
    got = {r["id"]: (r["a"]["value"], r["a"]["error"]) for r in out}
    assert len(got) == 101
    assert got[7] == (None, None) and got[8] == ("T8", None) and got[100] == (None, "bad text")


def test_a_filter_does_not_run_the_model_twice(spark, plan_of):
    rows = spark.range(10).select("id", F.col("id").cast("string").alias("t"))
    done = rows.select("id", apply_model.apply_model(F.col("t"), upper).alias("a"))
    kept = done.where(F.col("a.error").isNull()).select("id", "a.value")
    assert plan_of(kept).count("ArrowEvalPython") == 1
    assert kept.count() == 10


def test_cascade_with_predictor(spark):
    long = "first part. " * 60
    rows = spark.createDataFrame([(1, "short i."), (2, long), (3, long + "bad"), (4, "bad")], "id int, t string")
    done = correction.cascade_with_predictor(rows, "t", upper)
    got = {r["id"]: r["corrected_text"] for r in done.collect()}
    assert got[1] == "SHORT I."
    assert got[2].startswith("FIRST PART. FIRST PART.") and "first" not in got[2]
    assert got[3] == long + "bad" and got[4] == "bad"


def test_distinct_units_are_asked_once(spark, tmp_path):
    """The predictor leaves a file per call: every distinct unit stands in exactly one of them."""
    calls = str(tmp_path)

    def load():
        import uuid

        def predict(units):
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as out:
                out.write("\0".join(units))
            if any("bad" in unit for unit in units):
                raise ValueError("refused")
            return [unit.upper() for unit in units]

        return predict

    long = "first part. " * 60
    texts = ["short i.", None, long, long + "bad", "bad", ""] * 3 + ["short i."] * 500
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    done = correction.cascade_distinct(rows, "t", load, output="t2", error="why")
    plain = correction.cascade_with_predictor(rows, "t", upper, output="t2", error="why")
    assert done.columns == ["id", "t", "t2", "why"]
    got = {r["id"]: (r["t2"], r["why"]) for r in done.collect()}
    want = {r["id"]: (r["t2"], "refused" if r["why"] else None) for r in plain.collect()}
    assert got == want and got[0] == ("SHORT I.", None) and got[4] == ("bad", "refused") and got[1] == (None, None)
    asked = [unit for file in tmp_path.iterdir() for unit in file.read_text().split("\0") if "bad" not in unit]
    assert asked.count("short i.") <= 4  # once, and again in the halves of a batch with a unit that failed


def test_own_columns_survive_a_distinct_correction(spark):
    rows = spark.createDataFrame([("a", "x", 1, 2), ("a", "x", 1, 2)], "t string, unit string, at int, answer int")
    done = correction.cascade_distinct(rows, "t", upper)
    assert done.columns == ["t", "unit", "at", "answer", "corrected_text"]
    assert [tuple(r) for r in done.collect()] == [("a", "x", 1, 2, "A")] * 2
    assert correction.cascade_distinct(rows.limit(0), "t", upper).count() == 0


def test_a_dead_model_ends_the_job(spark):
    def dead():
        def predict(items):
            raise RuntimeError("no weights")

        return predict

    rows = spark.range(300, numPartitions=2).select("id", F.col("id").cast("string").alias("t"))
    with pytest.raises(Exception, match="the model failed on .* of .* inputs of a task, last: no weights"):
        rows.select(apply_model.apply_model(F.col("t"), dead)).collect()
    with pytest.raises(Exception, match="no weights"):
        correction.cascade_with_predictor(rows, "t", dead).collect()
    # Too few inputs to judge: they are error rows.
    few = rows.limit(10).select("id", apply_model.apply_model(F.col("t"), dead).alias("a"))
    assert few.where("a.error = 'no weights'").count() == 10


def test_a_budget_of_failures(spark):
    def half():
        def predict(items):
            if any(int(i) % 2 for i in items):
                raise ValueError("odd")
            return items

        return predict

    rows = spark.range(400, numPartitions=2).select(F.col("id").cast("string").alias("t"))
    done = rows.select(apply_model.apply_model(F.col("t"), half).alias("a")).select("a.*")
    assert done.where("error IS NOT NULL").count() == 200
    with pytest.raises(Exception, match="of a task"):
        rows.select(apply_model.apply_model(F.col("t"), half, max_failed=0.4)).collect()
    assert apply_model.require_success(done, "error").count() == 400
    with pytest.raises(apply_model.ModelFailed, match="200 of 400"):
        apply_model.require_success(done, "error", 0.5)


def test_a_loader_that_fails_ends_the_job(spark):
    def load():
        raise OSError("no such model")

    with pytest.raises(Exception, match="no such model"):
        spark.range(3).select(apply_model.apply_model(F.col("id").cast("string"), load)).collect()


def test_hot_keys_are_spread(spark):
    from lingomark.operators import resolve

    keys = ["hot"] * 3000 + [None] * 1000 + [f"k{k % 400}" for k in range(2000)] + ["gone"]
    left = spark.createDataFrame([(k, key) for k, key in enumerate(keys)], "id int, key string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{k}", k) for k in range(400)], "key string, value int")
    done = resolve.join_content(left, right, "key", ["id"], parts=16)
    got = {r["id"]: r["value"] for r in done.collect()}
    known = {"hot": 1} | {f"k{k}": k for k in range(400)}
    assert got == {k: known.get(key) for k, key in enumerate(keys)} and done.count() == len(keys)
    assert done.columns == ["key", "id", "value"]


@pytest.fixture(scope="module")
def features(spark):
    rows = spark.range(300).select(
        "id",
        (F.col("id") % 17).cast("int").alias("num_words"),
        (F.col("id") % 5 + 1.5).alias("avg_word_len"),
        (F.col("id") % 90).cast("int").alias("text_length"),
        *[(F.col("id") % k / k).alias(c) for k, c in zip((3, 7, 11, 13), contracts.AUDIO_COLUMNS)],
    )
    return rows.withColumn("label", F.col("num_words") / 4.0).cache()


def test_train_evaluate_save_reload(spark, features, tmp_path):
    scorer, metrics = training.train_and_evaluate(
        features, "id", "hybrid7", training.gbt("hybrid", maxIter=10, maxDepth=4)
    )
    by_part = {r["split"]: r for r in metrics.collect()}
    assert by_part["train"]["n_samples"] == 255 and by_part["val"]["n_samples"] == 45
    assert by_part["val"]["r2"] > 0.9 and by_part["val"]["mse"] < 0.2
    training.save_scorer(scorer, str(tmp_path / "scorer"))
    loaded = training.load_scorer(spark, str(tmp_path / "scorer"))
    assert (loaded.contract, loaded.columns) == ("hybrid7", contracts.contract_columns("hybrid7"))
    before = {r["id"]: r["prediction"] for r in training.apply_scorer(features, scorer).collect()}
    after = {r["id"]: r["prediction"] for r in training.apply_scorer(features, loaded).collect()}
    assert before == after


def test_presets():
    assert training.gbt().getMaxIter() == 300 and training.gbt().getMaxDepth() == 6
    assert training.gbt().getStepSize() == 0.05 and training.gbt().getSeed() == 42
    assert training.forest().getNumTrees() == 10


def test_stacked_and_mean(features):
    first = training.fit_scorer(features, "hybrid7", training.forest(numTrees=3))
    with_first = training.apply_scorer(features, first, "grammar_score_model")
    second = training.fit_scorer(with_first, "scorer8", training.forest(numTrees=3))
    stacked = training.stacked_score(features, first, second)
    alone = training.apply_scorer(with_first, second, "second")
    expected = {r["id"]: (r["grammar_score_model"] + r["second"]) / 2 for r in alone.collect()}
    assert {r["id"]: r["grammar_score"] for r in stacked.collect()} == pytest.approx(expected)


def test_vectors_need_no_widening(spark):
    rows = spark.range(200).select(
        "id", F.array(F.col("id") % 10 / 10.0, F.lit(1.0)).alias("e"), (F.col("id") % 10 / 2.0).alias("label")
    )
    model = training.fit_vectors(rows, "e", training.forest(numTrees=5))
    for row in training.apply_vectors(rows, "e", model).collect():
        assert abs(row["prediction"] - row["label"]) < 1.5


def test_vectors_keep_the_callers_columns(spark):
    rows = spark.range(200).select(
        "id", F.array(F.col("id") % 10 / 10.0, F.lit(1.0)).alias("e"), (F.col("id") % 10 / 2.0).alias("label"),
        F.lit("mine").alias("features"), F.lit("own").alias("prediction"),
    )
    model = training.fit_vectors(rows, "e", training.forest(numTrees=2))
    odd = rows.withColumn("e", F.when(F.col("id") == 3, F.array(F.lit(1.0))).when(F.col("id") > 4, F.col("e")))
    done = training.apply_vectors(odd, "e", model, "score")
    assert done.columns == [*rows.columns, "score"]
    got = {r["id"]: r for r in done.collect()}
    assert got[3]["score"] is None and got[4]["score"] is None and got[5]["score"] is not None
    assert got[5]["features"] == "mine" and got[5]["prediction"] == "own"


@pytest.mark.parametrize("contract", ["full", "emb384"])
def test_array_contracts(spark, features, contract, tmp_path):
    """The same trees, whether the embedding is one array column or a column per value."""
    size = 6
    extra = [F.lit(float(k)).alias(c) for k, c in enumerate(("num_errors", "grammar_ratio", "grammar_score_model"))]
    vector = F.array(*[(F.col("id") * (k + 3) % 11 / 11.0) for k in range(size)]).alias("embedding")
    rows = features.select("*", *extra, vector)
    scorer = training.fit_scorer(rows, contract, training.forest(numTrees=3), vector="embedding", size=size)
    columns = contracts.contract_columns(contract, size)
    wide = contracts.widen(rows, "embedding", size)
    plain = training.fit_scorer(wide, contract, training.forest(numTrees=3), columns)
    one = {r["id"]: r["prediction"] for r in training.apply_scorer(rows, scorer).collect()}
    assert one == {r["id"]: r["prediction"] for r in training.apply_scorer(wide, plain).collect()}
    training.save_scorer(scorer, str(tmp_path / contract))
    loaded = training.load_scorer(spark, str(tmp_path / contract))
    assert (loaded.columns, loaded.vector, loaded.size) == (scorer.columns, "embedding", size)
    broken = rows.withColumn(
        "embedding", F.when(F.col("id") == 0, F.array(F.lit(1.0))).when(F.col("id") == 1, F.lit(None)).when(
            F.col("id") == 2, F.transform("embedding", lambda v: v * F.lit(float("nan")))).otherwise(F.col("embedding"))
    )
    got = {r["id"]: r["prediction"] for r in training.apply_scorer(broken, loaded).collect()}
    assert [got[k] for k in range(3)] == [None] * 3 and {k: v for k, v in got.items() if k > 2} == {k: v for k, v in one.items() if k > 2}
    with pytest.raises(Exception, match="lacks a feature"):
        training.fit_scorer(broken, contract, training.forest(numTrees=1), vector="embedding", size=size)


def test_stacked_full_contract(spark, features):
    rows = features.withColumn("t", F.concat_ws(" ", F.lit("u r"), "id"))
    first = training.fit_scorer(rows, "hybrid7", training.forest(numTrees=2))
    ready = batch.full_vectors(rows, "t", text.WORD_RULES, size=5).drop("grammar_score_model")
    with_first = training.apply_scorer(ready, first, "grammar_score_model")
    second = training.fit_scorer(with_first, "full", training.forest(numTrees=2), vector="embedding", size=5)
    done = training.stacked_score(ready, first, second)
    assert not [c for c in done.columns if c.startswith("emb_")]
    for r in done.collect():
        assert r["grammar_score"] == pytest.approx((r["grammar_score_model"] + r["second_score"]) / 2)


def test_contract_probe(spark, features):
    scorer = training.fit_scorer(features, "hybrid7", training.forest(numTrees=2))
    basic = {"num_words": 10, "avg_word_len": 5.0, "text_length": 50}
    audio = {"duration": 1.0, "zero_crossing_rate": 0.1, "spectral_centroid": 1000.0, "rmse": 0.5}
    probed = training.probe_contracts(
        spark, scorer, {"basic3": basic, "hybrid7": {**audio, **basic}, "extra": {**audio, **basic, "num_errors": 1}}
    )
    got = {r["contract"]: (r["ok"], r["error"]) for r in probed.collect()}
    assert got["hybrid7"] == (True, None)
    assert not got["basic3"][0] and "duration" in got["basic3"][1]
    assert not got["extra"][0] and "num_errors" in got["extra"][1]


def test_missing_feature_is_an_error(features):
    scorer = training.fit_scorer(features, "basic3", training.forest(numTrees=2))
    with pytest.raises(ValueError, match="avg_word_len"):
        training.apply_scorer(features.drop("avg_word_len"), scorer)


def test_results_from_transcripts(spark):
    rows = spark.createDataFrame(
        [("a.wav", "i am u", None), ("b.wav", None, "no file"), ("c.wav", "all fine", None)],
        "filename string, transcript string, error string",
    )
    got = {r["filename"]: r.asDict() for r in batch.results_from_transcripts(rows).collect()}
    assert got["a.wav"]["corrected_text"] == "I am you"
    assert got["a.wav"]["grammar_score"] == pytest.approx(5 / 3)
    assert got["b.wav"]["transcript"] == got["b.wav"]["corrected_text"] == "Error: no file"
    assert got["b.wav"]["grammar_score"] == 0.0
    assert got["c.wav"]["grammar_score"] == 5.0


def test_model_score_fills_what_is_missing(spark, features):
    scorer = training.fit_scorer(
        features.withColumn("grammar_score_model", F.lit(0.0)), "scorer8", training.forest(numTrees=3)
    )
    rows = spark.createDataFrame([(1, "one two three"), (2, None)], "id int, t string")
    scored = batch.model_score(rows, "t", scorer)
    assert scored.columns == ["id", "t", "grammar_score"]
    assert all(0.0 <= r["grammar_score"] <= 4.0 for r in scored.collect())
    answered = request.respond(rows, F.col("t"), scorer=scorer).select("id", *request.FIELDS)
    got = {r["id"]: r for r in answered.collect()}
    first = scored.where("id = 1").first()
    assert got[1]["grammarScore"] == first["grammar_score"] and got[2]["grammarScore"] == 0.0


def test_full_contract(spark):
    rows = spark.createDataFrame([(1, "u r u fine")], "id int, t string")
    full = batch.full_features(rows, "t", text.WORD_RULES, size=4)
    got = contracts.select_contract(full, contracts.contract_columns("full", 4)).first()
    assert got["num_errors"] == 3 and got["grammar_ratio"] == 0.75 and got["duration"] == 0.0
    assert sum(got[f"emb_{i}"] ** 2 for i in range(4)) == pytest.approx(1.0)


def test_rubric_scores(spark):
    def load():
        def predict(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no reply")
            return [p + " 4.5 of 5" if "x" in p else p + " none" for p in prompts]

        return predict

    rows = spark.createDataFrame([(1, "x"), (2, "other"), (3, "bad"), (4, None)], "id int, t string")
    got = {r["id"]: r["grammar_score"] for r in batch.rubric_scores(rows, "t", load).collect()}
    assert got == {1: 4.5, 2: None, 3: None, 4: None}


def test_rule_table(spark):
    table = spark.createDataFrame(
        [(2, "b", "y", "z"), (1, "a", "x", "y")], "position int, rule_id string, pattern string, replacement string"
    )
    t, rules = F.col("t"), F.col("rules")
    rows = spark.createDataFrame([("x",), (None,), ("",)], "t string")
    ruled = rows.withColumn("rules", text.rule_table(table))
    got = ruled.select(text.apply_table(t, rules).alias("done"), text.table_hits(t, rules).alias("hits")).collect()
    assert [r["done"] for r in got] == ["z", None, ""]
    assert [(h["rule_id"], h["hits"]) for h in got[0]["hits"]] == [("a", 1), ("b", 0)]
    none = rows.withColumn("rules", text.rule_table(table.limit(0))).select(text.apply_table(t, rules).alias("done")).collect()
    assert [r["done"] for r in none] == ["x", None, ""]


def test_words_are_split_once(spark, plan_of):
    rows = spark.createDataFrame([(1, "a b")], "id int, t string")
    assert plan_of(batch.with_text_features(rows, "t")).count("split(") == 1
    scored = batch.correct_and_score(rows, "t", text.substitute_words)
    assert plan_of(scored.select("id", "grammar_score")).count("zip_with(") == 1
