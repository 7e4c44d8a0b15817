"""Spelling variants: words of a corpus one edit apart, grouped under their most frequent form.

Two words one edit apart share their first or their last c code points, where c is half the length of
the longer one. So words are dealt by their first c code points and, spelled backwards, by their last
c. A group is a sorted list: it is scanned once for all of its words as queries, row by row of the
edit matrix. The band of a matrix has three cells; rows up to the common prefix with the previous
word (LCP) are reused; a query leaves a range of the list once its band over the range's shared
prefix exceeds one edit, and a range that no query is left in is skipped. Large groups are stored in
several blocks, and every word of the group asks each of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

RUN = re.compile("[a-zÀ-ÿ]+")  # in text whose A-Z are lower-cased
SHORTEST, FEWEST, TYPO = 5, 3, 97
BLOCK = 8192  # stored words of a task, and
BLOCK_CHARS = 1 << 20  # their code points
HELD_WORDS = 1 << 18  # distinct words a task counts before it hands them on
WORDS_PER_TASK = 1 << 14  # of the vocabulary, each some three times in its groups
FAR = 9  # outside the band


def runs_of(text: str) -> list[str]:
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def word_counts(docs: DataFrame, shortest: int = SHORTEST, typo: int = TYPO) -> DataFrame:
    """word and n: occurrences of words of at least ``shortest`` code points in the whole texts.

    A word is a lower-cased run; where ``typo`` divides the crc32 of "<doc_id>:<run>", it lacks one
    code point. A null text has no words, a null id reads as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words, counts = pa.array(found, pa.string()), pa.array(found.values(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                own = Counter(runs_of(text.as_py() or ""))
                for run, n in own.items():
                    if len(run) < shortest:
                        continue
                    h = zlib.crc32(run.encode(), start)
                    if h % typo == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    found[run] += n
            if len(found) >= HELD_WORDS:
                yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, padded with zeros to ``width``."""
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(words)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scan(stored: list[str], queries: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For words of the sorted list ``stored``: index and the indexes of all queries exactly one edit away."""
    width = max(map(len, stored + queries)) + 3
    points, asks = matrix(stored, width), matrix(queries, width)
    size = np.fromiter(map(len, queries), np.int64, len(queries))
    common = np.zeros(len(stored), np.int64)
    same = points[1:] == points[:-1]
    same[np.arange(len(stored) - 1), [len(w) for w in stored[:-1]]] = False
    common[1:] = same.argmin(1)
    # rows[d]: after d code points of the current word, the queries still near and their band, the
    # cells before, at and behind the diagonal.
    everyone = np.arange(len(queries))
    rows = [(everyone, *(np.full(len(queries), v, np.uint8) for v in (FAR, 0, 1)))]
    at = 0
    while at < len(stored):
        word = points[at]
        last = len(stored[at])
        depth = len(rows) - 1
        while depth < last and len(rows[depth][0]):
            alive, before, on, behind = rows[depth]
            point, own = word[depth], asks[alive]
            left = before + (own[:, depth - 1] != point) if depth else np.full(len(alive), FAR, np.uint8)
            left = np.minimum(left, on + 1)
            middle = np.minimum(np.minimum(on + (own[:, depth] != point), behind + 1), left + 1)
            right = np.minimum(behind + (own[:, depth + 1] != point), middle + 1)
            near = np.minimum(np.minimum(left, middle), right) <= 1
            rows.append((alive[near], left[near], middle[near], right[near]))
            depth += 1
        alive, *band = rows[depth]
        if depth == last and len(alive):
            over = size[alive] - last
            hits = np.zeros(len(alive), bool)
            for k, cell in enumerate(band):
                hits |= (over == k - 1) & (cell == 1)
            if hits.any():
                yield at, alive[hits]
        # The rows shared with the next word stay; words that share a prefix nobody is near are skipped.
        at += 1
        while at < len(stored) and not len(alive) and common[at] >= depth:
            at += 1
        if at < len(stored):
            del rows[min(depth, int(common[at])) + 1 :]


def _group_scan(backwards: bool, half: int, home: list[tuple[str, int]], queries: list[str]) -> dict[str, list]:
    """Per query with near words in the block: their number and the best (n, word); each pair in one group only."""
    plain = (lambda w: w[::-1]) if backwards else (lambda w: w)
    found: dict[str, list] = {}
    words = [w for w, _ in home]
    step = max(1, (4 * BLOCK_CHARS) // (max(map(len, queries)) + 3))
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        for k, hits in scan(words, some):
            word, n = plain(words[k]), home[k][1]
            for query in (some[q] for q in hits.tolist()):
                own = plain(query)
                # Of the groups that both words are in, the pair belongs to the one of half the longer
                # word, and to the first half if both halves are shared.
                if max(len(own), len(word)) // 2 != half or (backwards and own[:half] == word[:half]):
                    continue
                best = found.setdefault(own, [0, n, word])
                best[0] += 1
                if n > best[1] or (n == best[1] and word < best[2]):
                    best[1:] = n, word
    return found


def near_words(vocabulary: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """word, n_near, best_n, best: for words with near words, their number and the most frequent one.

    ``vocabulary`` has unique words and n. Of near words of equal n the smallest in code-point order is best.
    """
    length = F.length("word")
    halves = F.array_distinct(F.array(F.floor(length / 2).cast("int"), F.floor((length + 1) / 2).cast("int")))
    spelled = F.array(
        F.struct(F.lit(False).alias("backwards"), F.col("word").alias("w")),
        F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("w")),
    )
    dealt = (
        vocabulary.select("n", F.explode(spelled).alias("s"), halves.alias("halves"))
        .select("n", "s.backwards", "s.w", F.explode("halves").alias("half"))
        .withColumn("key", F.xxhash64("backwards", "half", F.expr("substr(w, 1, half)")))
    )
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("w")).alias("chars"))
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("chars") / chars)).cast("int")
    grouped = dealt.join(sizes.where("size > 1").select("key", parts.alias("parts")), "key")
    # Every word asks all blocks of its group and is stored in one of them.
    home = F.pmod(F.xxhash64("w"), F.col("parts"))
    sent = grouped.select(
        "key", "backwards", "half", "w", "n", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    ).withColumn("asks", F.col("part") != F.col("home"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, waiting, held = None, [], [], 0
        out: list[tuple] = []

        def ask(queries: list[str]) -> None:
            if home and queries:
                for word, best in _group_scan(group[2], group[3], home, queries).items():
                    out.append((word, *best))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                columns = list(zip(*out, strict=True))
                out.clear()
                types = (pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])

        for batch in batches:
            for *key, asks, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    ask(waiting)
                    group, home, waiting, held = key, [], [], 0
                waiting.append(w)
                held += len(w)
                if not asks:
                    home.append((w, n))  # sorted, and before all that only ask
                elif held > 4 * chars:
                    ask(waiting)
                    waiting, held = [], 0
            if len(out) > 10_000:
                yield from flush()
        ask(waiting)
        yield from flush()

    # Words are a small table and much work: tasks by their number, not by their bytes.
    tasks = max(1, -(-vocabulary.count() // WORDS_PER_TASK))
    found = (
        sent.select("key", "part", "backwards", "half", "asks", "w", "n")
        .repartition(tasks, "key", "part")
        .sortWithinPartitions("key", "part", "asks", "w")
        .mapInArrow(search, "word string, n_near long, best_n long, best string")
    )
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best")
    )


def roots_of(links: DataFrame) -> DataFrame:
    """word and root of the rows (word, form): the end of the chain of forms, by pointer doubling.

    A chain's counts at least double with each step, so that it has at most 63 and six rounds reach its end.
    """
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("via"), F.col("root").alias("end"))
        moved = now.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("end", "root").alias("root"), F.col("via").isNotNull().alias("moved")
        )
        now = stage(moved, "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have at least ``shortest`` code points and ``fewest`` occurrences. The form is the near word of
    largest n (ties: smallest in code-point order) if it occurs at least twice as often as the word,
    else null; the root is reached by following forms. Null and empty texts have no words; repeated
    rows count each; other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = stage(word_counts(docs, shortest).where(F.col("n") >= fewest), "vocabulary")
    near = near_words(vocabulary)
    often = F.col("best_n") >= F.col("n") * 2
    formed = stage(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best")).alias("form"),
            F.when(often, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = roots_of(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
