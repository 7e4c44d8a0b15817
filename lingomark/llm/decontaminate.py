"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' words, in blocks of bounded size, each by one task, and kept as
sorted arrays: some 16 bytes an edge. The documents stream through it word by word, many stretches of
text abreast. At each word the automaton gives the length of the longest match that ends there; a match
of ``min_words`` or more words, or one that ends a whole shorter item, marks its words as hit.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

MIN_WORDS = 10
MAX_COVERAGE = 0.5
BLOCK_BYTES = 1 << 20  # of item text per automaton
BLOCKS_PER_PASS = 8  # automata that a task holds
STRETCH = 512  # words of a stretch of text
ABREAST = 1 << 20  # words that are looked up together
WORD = rb"[0-9a-z\x80-\xff]+"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and characters beyond ASCII."""
    return re.findall(WORD, text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences, under construction.

    ``items[v]``: items with a window of ``width`` words that ends in state v (its string of that
    length), ``short[v]``: items of fewer words, by their length, that are v's string of that length.
    """

    def __init__(self, sequences: dict[object, list[bytes]], width: int = MIN_WORDS):
        self.width = width
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = {k: [self.codes.setdefault(w, len(self.codes)) for w in ws] for k, ws in sequences.items() if ws}
        for ws in coded.values():
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for k, ws in coded.items():
            v = n = 0
            for w in ws:
                v, n = self.next[v][w], n + 1
                at = v
                while self.length[self.link[at]] >= width:
                    at = self.link[at]
                if n >= width:
                    self.items.setdefault(at, set()).add(k)
            if n < width:
                self.short.setdefault(v, {}).setdefault(n, set()).add(k)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def packed(self) -> dict:
        """The automaton as arrays: edges sorted by state and word, suffix links, lengths, and what ends where.

        ``mark[v]`` is the nearest state up the suffix links, v included, in which a window or a short
        item ends, and ``need[v]`` the fewest matched words with which one does.
        """
        states, words = len(self.link), max(1, len(self.codes))
        count = sum(map(len, self.next))
        keys = np.fromiter((v * words + c for v, edges in enumerate(self.next) for c in edges), np.int64, count)
        targets = np.fromiter((u for edges in self.next for u in edges.values()), np.int32, count)
        order = np.argsort(keys)
        mark, need = np.full(states, -1, np.int32), np.full(states, np.iinfo(np.int32).max, np.int32)
        for v in sorted(range(states), key=self.length.__getitem__):
            above = need[self.link[v]] if v else need[0]
            own = [n for n in self.short.get(v, ())]
            if v in self.items and self.length[self.link[v]] < self.width:
                own.append(self.width)
            mark[v] = v if own else mark[self.link[v]] if v else -1
            need[v] = min([*own, above])
        names = {k: i for i, k in enumerate(sorted({k for own in self.items.values() for k in own}, key=str))}
        ending = sorted(v for v in self.items if self.length[self.link[v]] < self.width)
        listed = [np.array(sorted(names[k] for k in self.items[v]), np.int32) for v in ending]
        return {
            "width": self.width,
            "words": b"\0".join(self.codes),
            "keys": keys[order],
            "targets": targets[order],
            "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32),
            "mark": mark,
            "need": need,
            # Windows: their states, where the items of each begin, the items' numbers, and their keys.
            "ending": np.array(ending, np.int32),
            "begin": np.cumsum([0, *map(len, listed)]).astype(np.int32),
            "listed": np.concatenate(listed) if listed else np.zeros(0, np.int32),
            "names": list(names),
            "short": self.short,
        }


class Scanner:
    """A packed automaton that documents stream through."""

    def __init__(self, packed: dict):
        self.packed = packed
        words = packed["words"].split(b"\0") if packed["words"] else []
        self.codes = {w: k for k, w in enumerate(words)}

    def _steps(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, states and match lengths where a window or short item ends.

        A hit depends on the ``width`` words up to its end only. So texts are cut into stretches, each
        read with the words before it that matter, and all stretches take a step at a time.
        """
        p = self.packed
        keys, targets, link, length, need = p["keys"], p["targets"], p["link"], p["length"], p["need"]
        words, lead = max(1, len(self.codes)), p["width"] - 1
        sizes = np.diff(bounds)
        parts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), parts)
        first = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        behind = np.minimum(first + STRETCH, bounds[text + 1])
        start = np.maximum(first - lead, bounds[text])
        order = np.argsort(start - behind, kind="stable")  # longest first
        first, behind, start = first[order], behind[order], start[order]
        v, n = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        spans = behind - start
        for step in range(int(spans[0]) if len(spans) else 0):
            alive = int(np.searchsorted(-spans, -step, side="left"))
            at = start[:alive] + step
            c = codes[at]
            known = np.flatnonzero(c >= 0)
            v[:alive][c < 0] = 0
            n[:alive][c < 0] = 0
            while len(known):
                wanted = v[known].astype(np.int64) * words + c[known]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[place] == wanted
                met = known[hit]
                v[met] = targets[place[hit]]
                n[met] += 1
                known = known[~hit]
                v[known] = link[v[known]]  # every known word leads on from the root
                n[known] = length[v[known]]
            ends = np.flatnonzero((n[:alive] >= need[v[:alive]]) & (at >= first[:alive]))
            if len(ends):
                yield at[ends], v[ends], n[ends]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Per text: hit spans (first word, behind the last; sorted, apart from each other) and the items hit."""
        code = self.codes.get
        raw: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        begin = 0
        while begin < len(texts):  # texts of about ABREAST words together
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= ABREAST):
                held += len(texts[end])
                end += 1
            bounds = np.cumsum([0, *map(len, texts[begin:end])])
            codes = np.fromiter((code(w, -1) for ws in texts[begin:end] for w in ws), np.int64, held)
            for places, states, lengths in self._steps(codes, bounds):
                own = np.searchsorted(bounds, places, side="right") - 1
                for k, at, v, n in zip(own.tolist(), (places - bounds[own]).tolist(), states.tolist(), lengths.tolist(), strict=True):
                    self._collect(int(self.packed["mark"][v]), n, at + 1, raw[begin + k], found[begin + k])
            begin = end
        return [(_merged(spans), items) for spans, items in zip(raw, found, strict=True)]

    def _windows(self, state: int) -> list:
        """Keys of the items with a window that ends in the state."""
        p = self.packed
        at = int(np.searchsorted(p["ending"], state))
        if at == len(p["ending"]) or p["ending"][at] != state:
            return []
        return [p["names"][k] for k in p["listed"][p["begin"][at] : p["begin"][at + 1]].tolist()]

    def _collect(self, m: int, n: int, end: int, raw: list, found: set) -> None:
        short, link, mark, width = (self.packed[x] for x in ("short", "link", "mark", "width"))
        while m >= 0:
            if n >= width and (items := self._windows(m)):
                raw.append((end - width, end))
                found.update(items)
            for size, own in short.get(m, {}).items():
                if size <= n:
                    raw.append((end - size, end))
                    found |= own
            m = int(mark[link[m]]) if m else -1


def automata(items: DataFrame, width: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of items: block, and the packed automaton of its texts.

    Blocks are dealt by a hash, so that their size is even, and built by one task each.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, list[bytes]] = {}
        last = None

        def done() -> pa.RecordBatch:
            data = pickle.dumps(Automaton(own, width).packed())
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

        for batch in batches:
            for block, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last and own:
                    yield done()
                    own.clear()
                last = block
                # Keyed by number too: rows that repeat an id are items of their own with that id.
                own[item, len(own)] = words_of(text)
        if own:
            yield done()

    dealt = rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("long").alias("block"), "item_id", "text")
    made = dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(build, "block long, data binary")
    return stage(made, "automata")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(
    docs: DataFrame, items: DataFrame, width: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, remove: bool = False
) -> DataFrame:
    """The documents' columns plus n_words, n_hit, spans and items.

    ``spans`` holds first word and word behind the last of each hit run, ``items`` the ids (as
    strings, sorted) of the items that occur. Null texts and items have no words. Repeated items count
    by their id; a null id is the string ``null``. No items give no hits, no documents no rows.
    Existing columns of these names are replaced. A pass over the documents holds the automata of at most
    ``BLOCKS_PER_PASS`` blocks; where more are needed, the table is written between passes. With ``remove``
    the last pass also cuts the hit spans out of the texts.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "spans", "items")]
    runs = "array<struct<first:bigint,behind:bigint>>"
    rows = docs.select(
        *kept, F.lit(0).cast("long").alias("n_words"), F.array().cast(runs).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    built = automata(items, width, block_bytes)
    blocks = sorted(r[0] for r in built.select("block").collect())
    context = docs.sparkSession.sparkContext
    for start in range(0, max(1, len(blocks)), BLOCKS_PER_PASS):
        some = blocks[start : start + BLOCKS_PER_PASS]
        # A block's arrays are bounded by its text, so they may be sent to all tasks.
        held = [bytes(built.where(F.col("block") == k).first()["data"]) for k in some]
        if start:
            rows = stage(rows, "passed")
        last = start + BLOCKS_PER_PASS >= len(blocks)
        rows = _pass(rows, context.broadcast(held), len(kept), kept.index("text"), remove and last)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["behind"] - x["first"])
    return rows.select(*kept, "n_words", n_hit.alias("n_hit"), "spans", "items")


def _pass(rows: DataFrame, held, n_kept: int, text_at: int, remove: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(pickle.loads(data)) for data in held.value]
        run = pa.struct([("first", pa.int64()), ("behind", pa.int64())])
        for batch in batches:
            old = batch.columns
            texts = [words_of(text.as_py()) for text in old[text_at]]
            spans = [[(s["first"], s["behind"]) for s in own] for own in old[n_kept + 1].to_pylist()]
            items = [set(own) for own in old[n_kept + 2].to_pylist()]
            for scanner in scanners:
                for k, (own, found) in enumerate(scanner.scan(texts)):
                    if found:
                        spans[k] = _merged(spans[k] + own)
                        items[k] |= {"null" if item is None else item for item, _ in found}
            if remove and any(spans):
                left = old[text_at].to_pylist()
                for k, own in enumerate(spans):
                    if own:
                        left[k] = cut(left[k], own)
                old[text_at] = pa.array(left, old[text_at].type)
            listed = [[{"first": a, "behind": b} for a, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [*old[:n_kept], pa.array(map(len, texts), pa.int64()), pa.array(listed, pa.list_(run)),
                 pa.array(map(sorted, items), pa.list_(pa.string()))],
                names=batch.schema.names,
            )

    return rows.mapInArrow(scan, rows.schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs.select("doc_id", "text"), items, width).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(WORD, raw.lower())]
    out, at = [], 0
    for first, behind in spans:
        out.append(raw[at : places[first][0]])
        at = places[behind - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without hit spans; those hit on ``max_coverage`` of their words or more go whole.

    A column ``n_chars`` is counted anew where a text was cut. Clean documents are passed on as they
    are, and so are documents without words.
    """
    found = hits(docs, items, width, remove=True)
    cleaned = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words") * max_coverage))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*[c for c in docs.columns if c in cleaned.columns])


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sizes AS (SELECT DISTINCT least(len(words), 10) AS n FROM b WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
        FROM b WHERE len(words) > 0)),
seen AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM seen JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
