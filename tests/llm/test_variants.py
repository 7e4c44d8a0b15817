"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from lingomark.llm import variants

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n int, word int, form int, root int"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows, shortest=5, fewest=3):
    """word -> (form, root, n, n_near, form_n) by trying every edit of every word."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= fewest and len(w) >= shortest}
    letters = sorted({c for w in known for c in w})
    near, form = {}, {}
    for w, n in known.items():
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + over :] for k in range(len(w) + 1) for c in letters for over in (0, 1)}
        near[w] = sorted((edits - {w}) & set(known), key=lambda x: (-known[x], x))
        form[w] = near[w][0] if near[w] and known[near[w][0]] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), known[form[w]] if form[w] else None) for w, n in known.items()}


def found(rows):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}
    return out


def test_scan_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        make = lambda: "".join(rng.choice("abé"[: rng.choice((2, 3))]) for _ in range(rng.randint(5, 8)))
        stored = sorted({make() for _ in range(rng.randint(1, 60))})
        queries = stored[::2] + [make() for _ in range(5)]
        got = [(stored[k], q) for k, hits in variants.scan(stored, queries) for q in hits.tolist()]
        assert len(set(got)) == len(got)
        assert set(got) == {(w, k) for w in stored for k, q in enumerate(queries) if one_edit(w, q)}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = found(variants.spelling_variants(docs))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert any(form and form != root for form, root, *_ in got.values())


@pytest.fixture(scope="module")
def typos():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    text = []
    for k, word in enumerate(words):
        text += [word] * (200 + k)
        for _ in range(15):
            at = rng.randrange(len(word))
            text += [word[:at] + rng.choice(("", "x", word[at] + "y")) + word[at + 1 :]] * rng.randint(1, 40)
    rng.shuffle(text)
    return text


def test_groups_in_several_blocks(spark, typos):
    # All words share their first letters, so that blocks and not keys keep the groups small.
    rows = [(n, " ".join("same" + w for w in typos[n::7])) for n in range(7)]
    want = plain(rows)
    counts = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).where("n >= 3")
    for block, chars in ((1 << 13, 1 << 20), (16, 1 << 20), (1 << 13, 300)):
        near = {r.word: (r.n_near, r.best_n, r.best) for r in variants.near_words(counts, block, chars).collect()}
        assert {w: own[0] for w, own in near.items()} == {w: own[3] for w, own in want.items() if own[3]}
        assert all(want[w][0] in (None, best) for w, (_, _, best) in near.items())


def test_odd_rows(spark, typos):
    text = " ".join(typos)
    rows = [
        (1, None), (2, ""), (3, "the cat"), (None, text), (4, text.upper()), (4, text.upper()), (5, "É" * 40 + "." + "é" * 40),
        (6, "colour colour colour color color color color color color"), (7, "x" * 60 + " " + "x" * 60 + "! " + "x" * 60),
        (8, "naïve-naïve_naïve Naïveİnaïve"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = found(variants.spelling_variants(docs))
    assert got == plain(rows) and got["color"][3] >= 1 and "x" * 60 in got
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_very_long_words(spark):
    long, one = "xy" * 20_000, "xy" * 20_000 + "z"
    docs = spark.createDataFrame([(1, f"{long} {long}! {long}-{one} {one} {one}")], "doc_id long, text string")
    got = found(variants.spelling_variants(docs))
    kept = {w for w in (long, one) if w in got}  # a run whose hash says so lacks a code point
    assert len(got) == 2 and kept and {r[3] for r in got.values()} <= {0, 1}
    if len(kept) == 2:
        assert got[long][3] == got[one][3] == 1


def test_chains_reach_their_root(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(60)] + [("a", "w0"), ("b", "w0"), ("c", "d")]
    got = {r.word: r.root for r in variants.roots_of(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "d" if w == "c" else "w60" for w, _ in chain}
