"""Filter interaction audit against SQL and brute force."""

from collections import Counter
from itertools import permutations

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from lingomark.llm import interactions

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, n long, mask string, part int, good int, _words int"
LABELS = "doc_id long, quality int, toxic int, part string"
PROSE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE, "b"), (2, PROSE, "a"), (None, PROSE, "a"),
    (4, None, None), (5, "", "a"), (6, " \t\n", ""), (7, "same " * 70, "b"), (8, "LOUD " * 70 + PROSE, "b"),
    (9, PROSE + " #tag", "a"), (10, "x" * 300_000, "a"), (11, PROSE + " Ärger É", None), (12, "a|b", "b"),
    (13, "Case case CASE " * 30, "b"), (None, None, None),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 0, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def plain(rows, marks):
    """The audit by walking every order over every document."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    fails = []
    for doc_id, text, source in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails.append((source or "", doc_id, {
            name for name, bad in {
                "A": len(words) < 50,
                "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": any(t == text for i, t in ((i, t or "") for i, t, _ in rows) if None not in (i, doc_id) and i < doc_id),
            }.items() if bad
        }))
    out = {}
    for part in {p for p, _, _ in fails}:
        removed_at = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                row = Counter()
                for own, doc_id, bad in fails:
                    if own != part:
                        continue
                    gone, now = bad & set(order[: step - 1]), name in bad
                    row["kept"] += not gone and not now
                    row["removed"] += not gone and now
                    row["redundant"] += bool(gone) and now
                    row["unique_fails"] += bad == {name}
                    row["good_lost"] += not gone and now and doc_id in good
                    row["toxic_lost"] += not gone and now and doc_id in toxic
                removed_at[name] += row["removed"]
                out[part, order, step] = [row[c] for c in interactions.COUNTS]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_at[order[step - 1]])
    return out


def test_equals_sql(spark):
    name = "op11_filter_audit"
    assert difference(entry.queries()[name], entry.oracle_sql()[name], spark, connect(FOLDER), FOLDER) is None


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(*r, 1, "m", 2, 3, 4) for r in ROWS], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(*m, "p") for m in MARKS], LABELS)


def test_odd_rows_against_brute_force(odd):
    rows = interactions.filter_interactions(*odd).collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in interactions.COUNTS] + [r.shapley] for r in rows}
    assert len(rows) == len(got) and got == plain(ROWS, MARKS)


def test_empty_tables(odd):
    docs, labels = odd
    assert interactions.filter_interactions(docs.limit(0), labels).count() == 0
    none = interactions.filter_interactions(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert list(none) == [0, 0]


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 0b11, 5, 2, 1), ("p", 0b01, 3, 0, 0), ("q", 0, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): r for r in interactions.audit(cells, "XY").collect()}
    assert len(got) == 8
    assert (got["p", "XY", 1].removed, got["p", "XY", 2].redundant, got["p", "YX", 1].removed, got["p", "YX", 2].removed) == (8, 5, 5, 3)
    assert got["p", "XY", 1].shapley == 11 and got["p", "XY", 2].shapley == 5 and got["q", "YX", 2].kept == 4
