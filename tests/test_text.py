"""Text functions against plain-Python restatements on generated and hand-made strings."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingomark.functions import numeric, text
from lingomark.plans import correction

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

pieces = st.sampled_from(
    ["i", "im", "ur", "u", "r", "y", "Iñ", "é", "éi", "yé", "_i", "i_", "I'm", "foo", "bar.", ". ", ".", " ", "  ",
     "\n", " ", " ", "\x1c", "\x85", "​", "a" * 120, "b" * 499, "c" * 500, "word. ", "x1", "1y", "-u-"]
)
strings = st.one_of(st.lists(pieces, max_size=40).map("".join), st.text(max_size=60))
many = st.lists(strings, min_size=25, max_size=60)

EDGE_CASES = [
    "", " ", "  ", "no mark", "foo.", "foo. bar", ". ", ". . . ", "ends. ", "a" * 498 + ". b",
    "a" * 497 + ". b", "a" * 499 + ". " + "b" * 3, "a" * 500, "a" * 501 + ". b. c", "x. " + "y" * 600 + ". z",
    " lead. " + "q" * 495 + ".  trail ", "i im ur u r y", "éi iñ", "i-i i.i (u)",
]


def apply(spark, values, column, name="text"):
    rows = spark.createDataFrame(list(enumerate(values)), f"id long, {name} string").repartition(4)
    done = rows.select("id", column.alias("out")).collect()
    return [row["out"] for row in sorted(done, key=lambda r: r["id"])]


def pack(value, limit=500):
    """Sentence packing restated over start offsets instead of a growing string."""
    parts = value.split(". ")
    groups, size = [[]], 0
    for part in parts:
        if groups[-1] and size + len(part) >= limit:
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += len(part) + 2
    return ["".join(p + ". " for p in group).strip() for group in groups]


WORD = re.compile(r"[A-Za-z0-9_]+")


def swap(value):
    table = dict(text.WORD_SUBSTITUTIONS)
    return WORD.sub(lambda m: table.get(m.group(), m.group()), value)


def unsurrogate(values):
    return [v.encode("utf-16", "replace").decode("utf-16") if any(0xD800 <= ord(c) < 0xE000 for c in v) else v for v in values]


@given(many)
@SETTINGS
def test_counts_follow_python_split(spark, values):
    values = unsurrogate(values + EDGE_CASES)
    assert apply(spark, values, text.words(F.col("text"))) == [v.split() for v in values]
    assert apply(spark, values, text.text_length(F.col("text"))) == [len(v) for v in values]
    mean = apply(spark, values, text.avg_word_len(text.words(F.col("text"))))
    assert mean == pytest.approx([sum(map(len, v.split())) / max(len(v.split()), 1) for v in values])


@given(many)
@SETTINGS
def test_strip_and_blank(spark, values):
    values = unsurrogate(values + EDGE_CASES)
    assert apply(spark, values, text.strip(F.col("text"))) == [v.strip() for v in values]
    assert apply(spark, values, text.is_nonblank(F.col("text"))) == [bool(v.strip()) for v in values]


@given(many)
@SETTINGS
def test_chunks(spark, values):
    values = unsurrogate(values + EDGE_CASES)
    assert apply(spark, values, text.chunks(F.col("text"))) == [pack(v) for v in values]
    units = apply(spark, values, text.correction_units(F.col("text")))
    assert units == [[v] if len(pack(v)) == 1 else pack(v) for v in values]


@given(many)
@SETTINGS
def test_substitutions_use_ascii_word_edges(spark, values):
    values = unsurrogate(values + EDGE_CASES)
    assert apply(spark, values, text.substitute_words(F.col("text"))) == [swap(v) for v in values]


@given(many)
@SETTINGS
def test_cascade_with_substitutions(spark, values):
    values = unsurrogate(values + EDGE_CASES)
    expected = [swap(v) if len(pack(v)) == 1 else " ".join(swap(c) for c in pack(v)) for v in values]
    assert apply(spark, values, correction.cascade(F.col("text"))) == expected
    assert apply(spark, values, correction.cascade(F.col("text"), original_when_single=False)) == [
        " ".join(swap(c) for c in pack(v)) for v in values
    ]


@given(many, many)
@SETTINGS
def test_word_diff_follows_zip(spark, before, after):
    before, after = unsurrogate(before + EDGE_CASES), unsurrogate(after + EDGE_CASES)
    pairs = list(zip(before, after))
    rows = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(pairs)], "id long, b string, a string")
    done = rows.select("id", text.word_diff_score(F.col("b"), F.col("a")).alias("s")).orderBy("id").collect()
    for (b, a), row in zip(pairs, done):
        changed = sum(1 for x, y in zip(b.split(), a.split()) if x != y)
        assert row["s"] == pytest.approx(max(0.0, 1 - changed / max(len(b.split()), 1)))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_missing_text_stays_missing(spark, ansi):
    """NULL in, NULL out, whatever the session's ANSI mode."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        t = F.col("text")
        for column in (
            text.num_words(t), text.avg_word_len(text.words(t)), text.chunks(t), text.correction_units(t),
            correction.cascade(t), text.word_diff_score(t, t), text.build_prompt(t), text.parse_score(t),
            text.rule_error_count(t, text.WORD_RULES), text.clean_name(t), text.safe_name(t),
        ):
            assert apply(spark, [None, "a. b"], column)[0] is None
        assert apply(spark, [None], text.is_nonblank(t)) == [False]
        assert apply(spark, [None, "a. b"], text.chunks(t))[1] == ["a. b."]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_blocks_do_not_show(spark):
    """Texts longer than one fold block, with chunk borders on and around block borders."""
    values = [
        "x" * 60 + ". " + "word. " * n + "y" * 480 + ". " + "tail. " * m
        for n in (253, 254, 255, 256, 257, 511, 512, 513)
        for m in (0, 1, 300)
    ]
    values += ["s. " * n for n in (255, 256, 257, 1024)]
    assert apply(spark, values, text.chunks(F.col("text"))) == [pack(v) for v in values]


def test_chunk_limits():
    assert pack("foo.") == ["foo.."]
    assert pack("") == ["."]


@pytest.mark.parametrize(
    "before, after, score",
    [
        ("a b c d", "a b c d", 1.0),
        ("a b c d", "a x c d", 0.75),
        ("a b", "a b c d", 1.0),
        ("a b c d", "a", 1.0),
        ("a b", "x y", 0.0),
        ("", "x", 1.0),
        ("a", "", 1.0),
    ],
)
def test_word_diff_score(spark, before, after, score):
    row = spark.createDataFrame([(before, after)], "b string, a string")
    assert row.select(text.word_diff_score(F.col("b"), F.col("a"))).first()[0] == pytest.approx(score)


REPLIES = {
    "Score: 4": 4.0,
    "Score:4/5": 5.0,
    "Score: -2": 2.0,
    "Score: n/a": None,
    "Score:": None,
    "Score: 1.2.3": None,
    "Score: .": None,
    "": None,
    "a Score: 1 Score: 2": 2.0,
    "no marker 7": None,
    "3.5 no marker": 3.5,
    "Score: 4.5 x": 4.5,
    "Score: 9": 5.0,
    "Score: .5": 0.5,
}


def test_parse_score(spark):
    assert apply(spark, list(REPLIES), text.parse_score(F.col("text"))) == list(REPLIES.values())
    assert apply(spark, [None], text.parse_score(F.col("text"))) == [None]


def test_prompt(spark):
    prompt = apply(spark, ["hi"], text.build_prompt(F.col("text")))[0]
    assert prompt.startswith("<|system|>You are an English grammar evaluator.")
    assert prompt.endswith("<|user|>Transcript: hi<|end|>\n<|assistant|>Score:")


def test_rules_in_order(spark):
    rules = [text.Rule("one", "a+", "b"), text.Rule("two", "b", "c")]
    assert apply(spark, ["aab ab"], text.apply_rules(F.col("text"), rules)) == ["cc cc"]
    assert apply(spark, ["aab ab"], text.rule_error_count(F.col("text"), rules)) == [4]
    hits = apply(spark, ["aab"], text.rule_hits(F.col("text"), rules))[0]
    assert [(h["rule_id"], h["hits"]) for h in hits] == [("one", 1), ("two", 1)]


def test_token_batch(spark):
    long, short = apply(spark, ["a b c d", "a"], text.token_batch(F.col("text"), 3))
    assert len(long["input_ids"]) == len(short["input_ids"]) == 3
    assert long["attention_mask"] == [1, 1, 1] and short["attention_mask"] == [1, 0, 0]
    assert short["input_ids"] == [long["input_ids"][0], 0, 0]
    unpadded = apply(spark, ["a"], text.token_batch(F.col("text"), 3, pad=False))[0]
    assert unpadded["attention_mask"] == [1]


def test_text_choice(spark):
    rows = spark.createDataFrame(
        [("typed", "heard"), ("", "heard"), (None, "heard"), ("typed", None), ("", None)], "t string, h string"
    )
    chosen = rows.select(
        text.choose_text(F.col("t"), F.col("h")).alias("a"),
        text.choose_text(F.col("t"), F.col("h"), prefer_audio=True).alias("b"),
    ).collect()
    assert [r["a"] for r in chosen] == ["typed", "heard", "heard", "typed", ""]
    assert [r["b"] for r in chosen] == ["heard", "heard", "heard", "typed", ""]


def test_names(spark):
    values = [" a\\b\\c.wav ", "/x/y.wav", "y.wav\n"]
    assert apply(spark, values, text.clean_name(F.col("text"))) == ["c.wav", "y.wav", "y.wav"]
    values = ["../../etc/passwd", "my clip (1).wav", "..hidden..", "a/b\\c.wav"]
    assert apply(spark, values, text.safe_name(F.col("text"))) == [
        "etc_passwd", "my_clip_1.wav", "hidden", "a_b_c.wav",
    ]


def test_numbers(spark):
    rows = spark.createDataFrame([("3.5",), ("x",), (None,), ("7",)], "v string")
    cast = rows.select(numeric.to_number(F.col("v")).alias("n"))
    assert [r["n"] for r in cast.collect()] == [3.5, None, None, 7.0]
    clamped = cast.select(text.clamp(F.col("n")).alias("c"))
    assert [r["c"] for r in clamped.collect()] == [3.5, None, None, 5.0]


def test_row_long_text_stays_whole(spark):
    value = "word. " * 20000 + "z" * 5000
    chunks = apply(spark, [value], text.chunks(F.col("text")))[0]
    assert chunks == pack(value)
