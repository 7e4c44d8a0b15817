"""SimHash near-duplicates, linked exactly with vantage-point trees.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit on one of their
32-bit halves. So one vantage-point tree per half, searched with radius one, finds every link. The
trees are built from a bounded sample of fingerprints and split the Hamming space into leaf shards; a
fingerprint is stored in one leaf and visits, by the triangle bounds, the leaves whose region its ball
overlaps. A leaf lists its fingerprints under their half; a visitor looks up the halves its ball holds and
compares all 64 bits there. Only a spanning forest of the links goes on, so a group of near copies costs
as many rows as it has fingerprints. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingomark.llm import graph
from lingomark.llm.columns import spare
from lingomark.session import stage

SHINGLE, BITS = 3, 3
SEED = 42
SAMPLE = 1 << 16  # fingerprints the trees are built from
LEAF = 2048  # fingerprints aimed at per leaf
BLOCK = 1 << 18  # stored fingerprints a task holds of a leaf
COMPARED = 1 << 21  # pairs of a block


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.array([digest(b" ".join(s), SEED) for s in joined], ">u8")
    ones = sum(
        np.unpackbits(hashes[k : k + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        for k in range(0, len(hashes), 65536)
    )
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of each row, from the whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def halves(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


def build_tree(points: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """A complete vantage-point tree as a heap of (vantage point, radius), with at least ``leaves`` leaves.

    Left is within the radius, right beyond. The vantage point of a node is the one of a few candidates
    whose distances spread most; the radius splits its points most evenly.
    """
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    nodes, level = [], [points]
    for _ in range(depth):
        below = []
        for own in level:
            candidates = own[:: max(1, len(own) // 8)][:8] if len(own) else np.zeros(1, np.uint32)
            distances = [np.bitwise_count(own ^ c) for c in candidates]
            best = int(np.argmax([d.std() if len(d) else 0 for d in distances]))
            d = distances[best]
            inside = np.cumsum(np.bincount(d, minlength=33)) if len(d) else np.zeros(33)
            radius = int(np.argmin(np.abs(inside - len(d) / 2)))
            nodes.append((int(candidates[best]), radius))
            below += [own[d <= radius], own[d > radius]]
        level = below
    return nodes


def visits(values: np.ndarray, tree: list[tuple[int, int]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, leaf and whether it is the own leaf, of every leaf a value's ball overlaps.

    Leaves before the own one are left out: the pair is found from the other side.
    """
    index, node, own = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    if tree:
        points = np.array([p for p, _ in tree], np.uint32)
        radii = np.array([r for _, r in tree], np.int64)
    while len(tree) and len(node) and node[0] < len(tree):
        d = np.bitwise_count(values[index] ^ points[node]).astype(np.int64)
        radius = radii[node]
        left, right = d <= radius, d > radius
        # Own leaf: one side. Other overlapping leaves: only those to the right of the own path.
        other = np.where(own, left & (d > radius - reach), False)
        stay_left = np.where(own, left, d <= radius + reach)
        stay_right = np.where(own, right, d > radius - reach)
        index = np.concatenate([index[stay_left], index[stay_right], index[other]])
        node = np.concatenate([2 * node[stay_left] + 1, 2 * node[stay_right] + 2, 2 * node[other] + 2])
        own = np.concatenate([own[stay_left], own[stay_right], np.zeros(int(other.sum()), bool)])
    return index, node - len(tree), own


def near_masks(reach: int) -> np.ndarray:
    """All 32-bit words of at most ``reach`` ones: what two halves within ``reach`` may differ in."""
    return np.array(
        [sum(1 << b for b in ones) for n in range(reach + 1) for ones in combinations(range(32), n)], np.uint32
    )


class Leaf:
    """Stored fingerprints of a leaf (or of one block of it), listed under their half."""

    def __init__(self, stored: np.ndarray, half: int, bits: int):
        self.half, self.bits = half, bits
        values = halves(stored, half)
        order = np.argsort(values, kind="stable")
        self.stored = stored[order]
        self.values, self.starts, self.sizes = np.unique(values[order], return_index=True, return_counts=True)
        self.masks = near_masks(bits // 2)

    def close(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``fps`` and in ``stored`` of all pairs within ``bits``, in blocks of bounded size."""
        step = max(1, COMPARED // len(self.masks))
        for start in range(0, len(fps), step):
            probes = halves(fps[start : start + step], self.half)[:, None] ^ self.masks
            at = np.minimum(np.searchsorted(self.values, probes), len(self.values) - 1)
            asks, which = np.nonzero(self.values[at] == probes)
            groups = at[asks, which]
            behind = np.cumsum(self.sizes[groups])
            first = 0
            while first < len(groups):
                done = behind[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(behind, done + COMPARED, side="right")))
                sizes = self.sizes[groups[first:last]]
                q = np.repeat(asks[first:last] + start, sizes)
                shift = self.starts[groups[first:last]] - (behind[first:last] - sizes - done)
                h = np.repeat(shift, sizes) + np.arange(len(q))
                near = np.bitwise_count((fps[q] ^ self.stored[h]).view(np.uint64)) <= self.bits
                yield q[near], h[near]
                first = last

    def links(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning forest (larger, smaller) of the links between ``fps`` and the stored fingerprints."""
        points, at = np.unique(np.concatenate([fps, self.stored]), return_inverse=True)
        label = np.arange(len(points))
        for q, h in self.close(fps):
            a, b = at[q], at[len(fps) + h]
            while True:
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
                while (label[label] != label).any():
                    label = label[label]
        moved = np.flatnonzero(label != np.arange(len(points)))
        return points[moved], points[label[moved]]


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints ``fp`` of the table linked by ``bits`` or fewer.

    A leaf that the sample shows to hold more than ``BLOCK`` fingerprints is stored in several blocks,
    each of which all its visitors ask: a task holds one block and a batch of visitors.
    """
    n = nodes.count()
    # A sample of bounded size, spread by a hash.
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64)
    leaves = min(-(-n // LEAF), SAMPLE // 8)
    reach = bits // 2
    trees, parts = [], []
    for half in (0, 1):
        tree = build_tree(halves(sample, half), leaves)
        _, leaf, own = visits(halves(sample, half), tree, reach)
        stored = np.bincount(leaf[own], minlength=len(tree) + 1) * (n / max(1, len(sample)))
        trees.append(tree)
        parts.append(np.maximum(1, np.ceil(stored / BLOCK)).astype(np.int64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                index, leaf, own = visits(halves(fps, half), tree, reach)
                many = parts[half][leaf]
                ask = np.repeat(np.arange(len(leaf)), many)
                no = np.arange(len(ask)) - np.repeat(np.cumsum(many) - many, many)
                home = own[ask] & (no == fps[index[ask]].view(np.uint64) % many[ask].astype(np.uint64))
                key = [pa.array(leaf[ask] * 2 + half, pa.int64()), pa.array(no, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*key, pa.array(~home), pa.array(fps[index[ask]])], ["leaf", "part", "asks", "fp"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, leaf = None, [], None
        for leaf_no, part, asks, fps in _runs(batches):
            if key != (leaf_no, part):
                if home:
                    yield _edges(Leaf(np.concatenate(home), key[0] % 2, bits))
                key, home, leaf = (leaf_no, part), [], None
            if not asks:
                home.append(fps)
                continue
            if home:
                leaf, home = Leaf(np.concatenate(home), leaf_no % 2, bits), []
                yield _edges(leaf)
            if leaf is not None:
                yield _edges(leaf, fps)
        if home:
            yield _edges(Leaf(np.concatenate(home), key[0] % 2, bits))

    return (
        nodes.select("fp")
        .mapInArrow(route, "leaf long, part long, asks boolean, fp long")
        .repartition("leaf", "part")
        .sortWithinPartitions("leaf", "part", "asks")
        .mapInArrow(search, "a long, b long")
    )


def _edges(leaf: Leaf, fps: np.ndarray | None = None) -> pa.RecordBatch:
    a, b = leaf.links(leaf.stored if fps is None else fps)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """Leaf, part, kind and fingerprints of each run of equal (leaf, part, kind), cut at batch ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, part, asks, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        changes = (np.diff(leaf) != 0) | (np.diff(part) != 0) | (asks[1:] != asks[:-1])
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(leaf)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(leaf[start]), int(part[start]), bool(asks[start]), fps[start:end]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Texts without words, null ones included, share the fingerprint 0 and are linked like others. Null
    ids are never the smallest; a component of null ids only has a null component_id. Repeated rows are
    kept. Other columns are ignored; an empty table stays empty.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = graph.components(links(nodes, bits))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents without those whose component has a smaller id.

    An id goes with all its rows if one of them has a smaller id in its component. Of rows that repeat an id the one with the longest text stays, then the one with the smallest hash of
    it. Rows without an id cannot be named: they are passed on, and do not make others go. Texts without
    words, null ones included, are one component. All columns are kept, whatever their names; an empty
    table stays empty.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    found = near_duplicates(named.select("doc_id", "text"), shingle, bits)
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    (rank,) = spare(docs.columns, "nth")
    best = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    left = named.join(others, "doc_id", "left_anti").withColumn(rank, F.row_number().over(best)).where(F.col(rank) == 1)
    return left.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
