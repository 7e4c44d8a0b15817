"""Corpus operators against brute force, and on nulls, empty and odd input."""

import hashlib
import itertools
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from compare import connect, difference
from lingomark.llm import (
    decontaminate, exact, html, language, mixing, repeats, sharding, simhash, suffixes, tokens, urls,
)

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int, rate string"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Same text here"), (5, "Same  text here"), (6, "Same  text here"),
    (None, "Same text here"), (7, "x" * 5000), (7, "x" * 5000), (8, "<|endoftext|> It's 12 ÉTÉ, 日本語\u0301 don’t"),
    (9, "word " * 3000), (10, "-- 123 --"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "k", 5, "r") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 200")


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op5_decontamination", "op7_sharding"])
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name], entry.oracle_sql()[name], spark, connect(FOLDER), FOLDER) is None


# Exact duplicates


def test_exact_odd(odd, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exact.exact_groups(odd).collect()}
    by_id = {r.doc_id: r for r in got.values()}
    assert [by_id[i].keep_id for i in (1, 2, 3, 4, 5, 6, None, 7)] == [3, 3, 3, 5, 5, 5, 5, 7]
    assert by_id[5].kept and not by_id[6].kept and not by_id[None].kept
    assert by_id[7].group_size == 2 and by_id[1].group_size == 3 and by_id[4].group_size == 4
    assert by_id[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact.exact_groups(odd).count() == len(ODD) and exact.exact_groups(empty).count() == 0


def test_exact_does_not_depend_on_salts(some):
    one, many = (sorted(map(tuple, exact.exact_groups(some, salts).collect())) for salts in (1, 7))
    assert one == many


# Sharding


def test_shards_odd(spark, odd, empty):
    rows = sharding.document_shards(odd, 3).collect()
    assert len(rows) == len(ODD) and sharding.document_shards(empty).count() == 0
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in own][0] == 0
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = docs_of(spark, [(1, "same")] * 600)
    sizes = Counter(r.shard for r in sharding.document_shards(same).collect())
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1


# URL filter


def test_listed_rules(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"),
        "http://example.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://m.example.com/de/?q": ("m.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.org/fr/a#b": ("x.org", "/fr/a", "org/fr/", "allow"),
        "net/": ("", "", None, "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://a.b?c://d/e": ("a.b", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(cases)], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([], "url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, labelled).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(pages.limit(0), labelled).count() == 0


def test_mined_rules(spark):
    rows = [(k, f"https://{'spam' if k % 3 == 0 else 'fine'}-farm.example.com/p/{k}", k % 3 == 0) for k in range(300)]
    labelled = spark.createDataFrame([(u, "block" if bad else "allow") for _, u, bad in rows], "url string, verdict string")
    rules = urls.mine_rules(labelled, min_support=0.05).collect()
    assert any(r.tokens == ["h:spam"] and r.verdict == "block" and r.confidence == 1.0 for r in rules)
    assert all(r.key in r.tokens for r in rules)
    pages = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labelled).collect()}
    assert got == {k: "block" if bad else "allow" for k, _, bad in rows}


def test_mined_rules_against_brute_force(spark):
    """Supports, confidences and lifts of all token sets, counted one by one."""
    rng = random.Random(8)
    hosts, paths = ["a.shop.net", "b.news.org", "spam.shop.net"], ["buy/now", "read/more", "buy/more"]
    rows = []
    for _ in range(120):
        url = f"http://{rng.choice(hosts)}/{rng.choice(paths)}"
        rows.append((url, "block" if rng.random() < (0.9 if "spam" in url or "now" in url else 0.2) else "allow"))
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    tokens_of = {r.url: set(r.t) for r in labelled.select("url", urls.url_tokens(F.col("url")).alias("t")).collect()}
    support, confidence, lift = 0.15, 0.8, 1.1
    want = set()
    n = len(rows)
    every = sorted(set().union(*tokens_of.values()))
    for size in range(1, 6):
        for own in itertools.combinations(every, size):
            inside = [v for u, v in rows if set(own) <= tokens_of[u]]
            for verdict in ("allow", "block"):
                both, share = inside.count(verdict), sum(v == verdict for _, v in rows) / n
                if inside and both >= support * n and both >= confidence * len(inside) and both / len(inside) / share >= lift:
                    want.add((own, verdict, round(both / len(inside), 9)))
    got = {(tuple(r.tokens), r.verdict, round(r.confidence, 9)) for r in urls.mine_rules(labelled, support, confidence, lift).collect()}
    assert {r for r in got if len(r[0]) <= 5} == want and want


# Mixing


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    rows = spark.createDataFrame(
        [(int(rng.integers(1, 500)), *map(float, own)) for own in p], "n_tokens long, p_0 double, p_1 double, p_2 double"
    )
    rate = mixing.fit_rates(rows, [0.7, 0.25, 0.05], steps=40)
    got = rows.withColumn("x", rate).agg(
        *[F.sum(F.col("x") * F.col("n_tokens") * F.col(f"p_{d}")) for d in range(3)], F.sum("n_tokens"), F.min("x")
    ).first()
    assert got[4] >= 0
    for d, share in enumerate([0.7, 0.25, 0.05]):
        assert abs(got[d] - share * got[3]) < 0.01 * got[3]


@pytest.mark.parametrize("mix, strength", [((0.72, 0.15, 0.13), 2), ((0.45, 0.42, 0.13), 2), ((0.5, 0.15, 0.35), 2)])
def test_rates_converge_where_some_are_cut(spark, caplog, mix, strength):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.array(mix) * strength, 2000)
    schema = "n_tokens long, p_0 double, p_1 double, p_2 double"
    rows = spark.createDataFrame([(int(rng.integers(1, 500)), *map(float, own)) for own in p], schema)
    rate = mixing.fit_rates(rows, [0.9, 0.08, 0.02])
    got = rows.withColumn("x", rate).agg(
        *[F.sum(F.col("x") * F.col("n_tokens") * F.col(f"p_{d}")) for d in range(3)], F.sum("n_tokens"), F.min("x")
    ).first()
    assert got[4] == 0 and not caplog.records
    for d, share in enumerate([0.9, 0.08, 0.02]):
        assert abs(got[d] - share * got[3]) <= 2e-6 * got[3]


def test_rates_report_unreachable_targets(spark, caplog):
    rows = spark.createDataFrame([(100, 0.6, 0.4), (50, 0.5, 0.5)], "n_tokens long, p_0 double, p_1 double")
    rate = mixing.fit_rates(rows, [0.9, 0.1])
    assert "rates miss the targets" in caplog.text
    # The nearest point to (135, 15) on the ray of (0.6, 0.4).
    got = rows.agg(F.sum(rate * F.col("n_tokens") * F.col("p_0")), F.sum(rate * F.col("n_tokens") * F.col("p_1"))).first()
    scale = (0.6 * 135 + 0.4 * 15) / 0.52
    assert tuple(got) == pytest.approx((0.6 * scale, 0.4 * scale), rel=1e-4)


def test_mixing_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mix(odd, none).collect()
    assert len(rows) == len(ODD) and all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in rows)
    assert mixing.mix(empty, none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 1), (9, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    domains = {r.doc_id: r.domain for r in mixing.domain_labels(labels).collect()}
    assert domains == {4: "high", 9: "toxic"}
    assert mixing.mix(odd, mixing.domain_labels(labels)).count() == len(ODD)


# Token counts


@pytest.mark.parametrize("most", [40, tokens.BATCH_CHARS])
def test_token_counts(spark, some, odd, empty, monkeypatch, most):
    monkeypatch.setattr(tokens, "BATCH_CHARS", most)
    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    both = odd.select("doc_id", "text").union(some.select("doc_id", "text"))
    want = Counter(
        (r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect()
    )
    rows = tokens.token_counts(both, file).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert tokens.token_counts(empty, file).count() == 0


# Decontamination


def brute_hits(words, items, width):
    hit, found = set(), set()
    for key, own in items.items():
        n = min(len(own), width)
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(key)
    return hit, found


@pytest.mark.parametrize("stretch, abreast", [(512, 1 << 20), (1, 30), (3, 1 << 20), (7, 5)])
def test_automaton_against_brute_force(monkeypatch, stretch, abreast):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    monkeypatch.setattr(decontaminate, "ABREAST", abreast)
    rng = random.Random(3)
    for _ in range(150):
        items = {k: [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))] for k in range(4)}
        scanner = decontaminate.Scanner(decontaminate.Automaton(items, 4).packed())
        texts = [[rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 5))]
        for words, (spans, found) in zip(texts, scanner.scan(texts), strict=True):
            hit, want = brute_hits(words, items, 4)
            assert {i for a, b in spans for i in range(a, b)} == hit and found == want
            assert spans == sorted(spans) and all(a[1] < b[0] for a, b in itertools.pairwise(spans))


def test_automata_are_small():
    """Arrays of some 16 bytes an edge, however long the items."""
    rng = random.Random(4)
    items = {k: [b"w%d" % rng.randrange(3000) for _ in range(400)] for k in range(100)}
    packed = decontaminate.Automaton(items).packed()
    edges = len(packed["keys"])
    arrays = [own.nbytes for own in packed.values() if isinstance(own, np.ndarray)]
    assert edges < 3 * 40_000 and sum(arrays) < 48 * edges
    assert len(pickle.dumps(packed)) < sum(arrays) + 100_000


def test_decontaminate(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "only three words"), (3, None), (4, ""), (None, "zz yy")],
        "item_id long, text string",
    )
    text = "Before. One two THREE four, five six seven eight nine ten -- after " + "clean " * 30
    docs = docs_of(spark, [(1, text), (2, "quite clean text"), (3, "only three words"), (4, None), (5, "aa zz yy bb cc dd ee")])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[3].n_hit, got[4].n_words) == (10, 1, 3, 0)
    assert got[5].items_sha256 == hashlib.sha256(b"null").hexdigest()
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert left[1] == "Before.  -- after " + "clean " * 30 and left[2] == "quite clean text" and 3 not in left and left[4] is None
    for together in (1, 2, 4):
        monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", together)
        blocks = decontaminate.hits(docs, items, block_bytes=20).select("doc_id", "n_hit", "items").collect()
        assert {r.doc_id: r.n_hit for r in blocks} == {k: r.n_hit for k, r in got.items()}
        assert {r.doc_id: r["items"] for r in blocks}[5] == ["null"]
    assert decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


# Language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_kneser_ney_sums_to_one():
    counts = np.random.default_rng(0).integers(0, 4, (7, language.SYMBOLS))
    lower = np.full((7, language.SYMBOLS), 1 / language.SYMBOLS)
    assert np.allclose(language._level(counts, lower)[0].sum(1), 1)


def test_language_odd(odd, empty):
    assert {r.lang_pred for r in language.predictions(odd).collect()} == {"und"}  # nothing to learn from
    assert language.predictions(empty).count() == 0
    learned = language.predictions(odd.withColumn("lang", F.lit("en")))
    got = {r.doc_id: r for r in learned.collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[10].lang_pred == "und" and got[4].lang_pred == "en"
    assert learned.count() == len(ODD)


# SimHash


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [5, simhash.BLOCK])
def test_simhash_components(some, monkeypatch, block):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = simhash.near_duplicates(some).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components({r.doc_id: int(r.fingerprint, 16) for r in rows})


@pytest.mark.parametrize("block", [5, simhash.BLOCK])
def test_simhash_links_of_near_prints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "LEAF", 32)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(8)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long").repartition(4)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(nodes).collect():
        a, b = find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == brute_components({p: p for p in prints})


def test_fingerprint():
    import xxhash

    words = "the cat sat on The mat the end".lower().split()
    hashes = [xxhash.xxh64(" ".join(words[k : k + 3]).encode(), seed=42).intdigest() for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("the cat sat on The mat the end") & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("one Two") & (1 << 64) - 1 == xxhash.xxh64(b"one two", seed=42).intdigest()


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert kept.count(7) == 1 and 2 not in kept and 1 in kept
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# Repeats


def brute_repeats(rows, depth):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + depth] for _, b in texts for k in range(len(b) - depth + 1))
    out = Counter()
    for i, b in texts:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - depth + 1):
            if count[b[k : k + depth]] > 1:
                cover[k : k + depth] = True
        steps = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        runs, longest = int((steps == 1).sum()), max(np.flatnonzero(steps == -1) - np.flatnonzero(steps == 1), default=0)
        kept = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()
        out[i, len(b), int(cover.sum()), runs, kept, int(longest), 0 < cover.sum() < len(b)] += 1
    return out


def test_suffix_array_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        depth, letters = rng.choice([8, 16]), rng.choice([b"ab", b"abc\x00", b"a"])
        base = bytes(rng.choice(letters) for _ in range(50))
        strings = [
            bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) + base[rng.randint(0, 30) : rng.randint(20, 50)]
            for _ in range(rng.randint(1, 7))
        ]
        seen = defaultdict(set)
        for s, x in enumerate(strings):
            for k in range(len(x) - depth + 1):
                seen[x[k : k + depth]].add((s, k))
        want = []
        for s, x in enumerate(strings):
            runs = repeats.merged([(k, k + depth) for k in range(len(x) - depth + 1) if len(seen[x[k : k + depth]]) > 1])
            want += [(s, a, b) for a, b in runs]
        assert sorted(suffixes.repeats(strings, np.arange(len(strings)) * 1000, depth)) == want


@pytest.mark.parametrize("crowd", [2, 512])
def test_repeats_against_brute_force(spark, some, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    noise = lambda: "".join(rng.choice("klmnopq ") for _ in range(rng.randint(0, 300)))
    rows = ODD + [(r.doc_id + 100, r.text) for r in some.limit(60).collect()]
    rows += [(1000 + k, noise() + passage[rng.choice([0, 7]) :] + noise()) for k in range(30)]
    rows += [(2000, "é" * 300), (2001, "line of text\n" * 90)]
    got = Counter(map(tuple, repeats.repeat_report(docs_of(spark, rows)).collect()))
    assert got == brute_repeats(rows, 400)


def test_repeats_empty_and_cut(spark, empty):
    assert repeats.repeat_report(empty).count() == 0
    passage = "".join(random.Random(4).choice("abcdefgh ") for _ in range(500))
    docs = docs_of(spark, [(1, "first " + passage + " end"), (2, passage + "!"), (3, "short")])
    left = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert left == {1: "first  end", 2: "!", 3: "short"}


# Pages


def test_minimum_cut_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a, b in (rng.choices(range(n), k=2) for _ in range(2 * n)) if a != b]

        def value(side):
            lost = sum(abs(c) for c, s in zip(costs, side) if bool(s) != (c > 0))
            return lost + sum(w for a, b, w in edges if bool(side[a]) != bool(side[b]))

        best = min(map(value, itertools.product([0, 1], repeat=n)))
        assert abs(value(html.minimum_cut(costs, edges)) - best) < 1e-9


def test_main_text():
    page = (
        "<html><head><title>t</title><script>var p='<p>';</script></head><body><header><h1>Site</h1></header>"
        "<ul class=menu><li><a href=x>Home</a><li><a>About</a></ul><div id='cookie-notice'><p>We use cookies here.</p></div>"
        "<div class='content'><h2>A heading</h2><p>First <b>paragraph</b>, with\n  words &amp; more.<br>New line."
        "<p>Second&eacute; paragraph is here, it also has words.</div><!-- <p>hidden</p> -->"
        "<section id='comments'><p>Great text, thank you.</p></section><form><label>Name</label></form><footer>&copy; x</footer>"
    )
    want = "A heading\n\nFirst paragraph, with words & more. New line.\n\nSecondé paragraph is here, it also has words."
    assert html.main_text(page, html.PRIOR) == want
    assert html.main_text(None, html.PRIOR) == html.main_text("", html.PRIOR) == html.main_text("<nav>a</nav>", html.PRIOR) == ""


def test_icons_and_formulas():
    page = (
        '<article><p>Before the icon, some words.</p><svg class="icon"/><p>Behind the icon, some words.</p>'
        "<p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math>, as shown.</p>"
        "<svg viewBox='0 0 1 1'><title>drawn</title><svg><text>label</text></svg><path d='M0'/><g>more</g></svg>"
        "<p>Last words, behind the drawing.</p></article>"
    )
    want = "Before the icon, some words.\n\nBehind the icon, some words.\n\nThe area is a=r2, as shown.\n\nLast words, behind the drawing."
    assert html.main_text(page, html.PRIOR) == want
    page = (
        "<article><p>Words with <svg><style/><title/><g><path d='M0'/><text>label</text></g></svg>an icon, in one paragraph.</p>"
        "<p>An open drawing, <svg class=icon><g><p>ends at the next paragraph.</p>"
        "<svg><foreignObject><div>a label</div></foreignObject></svg><p>All is well, at the end.</p></article>"
    )
    want = "Words with an icon, in one paragraph.\n\nAn open drawing,\n\nends at the next paragraph.\n\nAll is well, at the end."
    assert html.main_text(page, html.PRIOR) == want


HOSTILE = {
    "open elements": "<div>" * 200_000,
    "no end of a tag": "<b " * 350_000,
    "quotes never closed": "<b \">\" " * 120_000,
    "mixed quotes": "<b '\"> " * 120_000,
    "inline elements and paragraphs": "<b><p>x" * 130_000,
    "closed without an opening": "<div>" * 100_000 + "</x>" * 100_000,
    "drawings": "<svg>" * 100_000 + "<g>" * 100_000,
    "undecided blocks": "<p>a b</p>" * 50_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_long_pages_take_linear_time(kind):
    import time

    # Five times the page, at most some ten times the time: a quadratic step would show as 25.
    took = []
    for part in (5, 1):
        page = HOSTILE[kind][: len(HOSTILE[kind]) // part]
        start = time.process_time()
        html.main_text(page, html.PRIOR)
        took.append(time.process_time() - start)
    assert took[1] < max(0.5, 12 * took[0]) and took[1] < 10


def test_tags_with_open_quotes():
    page = '<p title="never closed>First words.</p><p>Second words.</p>'
    assert [b.text for b in html.blocks_of(page)] == ["First words.", "Second words."]
    assert [b.text for b in html.blocks_of("a < b and <p>c > d<!-- never closed <p>gone")] == ["a < b and", "c > d"]
    assert [b.text for b in html.blocks_of("<p>one <script>var a = '<p>';</script>two</p>")] == ["one two"]


def test_classifier_decides_where_lists_are_silent(spark):
    """Fitted weights alone, without any named element or class word, part article and rest."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = html.train(pages)
    right = total = 0
    for row in pages.collect():
        blocks = html.blocks_of(row.html)
        truth = [b.content > 0 for b in blocks]
        for b in blocks:
            b.content = b.boilerplate = b.cue = 0
        sides = html.minimum_cut([html.cost(b, weights) for b in blocks], html.edges_of(blocks))
        right += sum(a == b for a, b in zip(truth, sides, strict=True))
        total += len(truth)
    assert right / total > 0.98


def test_extract(spark):
    rows = [(1, None, None), (2, "u", ""), (None, None, "<article><p>Some words, here.</p></article>"), (3, "u", "<p>" + "long words, " * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[None].text == "Some words, here." and got[1].n_chars == 0 and got[3].n_chars == len(("long words, " * 20000).strip())
    assert html.extract(pages.limit(0)).count() == 0


# Pipeline


def plain_kept(rows, bits=3):
    """Ids that stay: the smallest of each component of fingerprints, by comparing all pairs."""
    prints = [(k, simhash.fingerprint(t)) for k, t in rows]
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, one), (b, other) in itertools.combinations(prints, 2):
        if ((one ^ other) & (1 << 64) - 1).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in root if find(k) == k}


def test_pipeline_near_dedup_against_brute_force(spark, some):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in some.collect()]
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, some, FOLDER).collect()]
    assert sorted(kept) == sorted(plain_kept(rows)) and len(kept) < len(rows)


def test_keep_one_odd(spark):
    schema = "doc_id long, text string, Nth int, nth_ int, component_id int"
    long, other = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(90))
    rows = [
        (1, None, 1, 1, 1), (2, "", 1, 1, 1), (3, long, 1, 1, 1), (4, long, 1, 1, 1), (5, long + " w80", 1, 1, 1),
        (7, "short one", 1, 1, 1), (7, other, 2, 2, 2), (None, long, 3, 3, 3), (None, None, 3, 3, 3),
    ]
    docs = spark.createDataFrame(rows, schema)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    near = plain_kept([(k, t) for k, t, *_ in rows if k is not None and k != 7])
    assert got == {(k, dict((r[0], r[1]) for r in rows)[k]) for k in near} | {(7, other), (None, long), (None, None)}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = corpus_pipeline.session.stage(stage(spark, docs, FOLDER), name)
        assert now.columns == documents.columns and 0.85 * docs.count() <= now.count() <= docs.count()
        docs = now
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.contamination(docs, items).agg(F.sum("n_hit")).first()[0] <= 20
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*documents.columns, "shard", "slot"]
    assert out.select("shard").distinct().count() == 8
