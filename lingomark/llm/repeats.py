"""Removal of long repeated byte strings from a corpus, found with suffix arrays.

Every string of ``LENGTH`` bytes has an anchor: of its ``GRAM``-byte substrings the one with the smallest
hash, the first of equals. Equal strings have equal anchors at the same place in them, so it is enough
to compare the surroundings of equal anchors: the segment of all strings that can have the anchor.

1. Documents give anchors with a hash of their segment; anchors that occur once are dropped.
2. Segments that occur more than once are covered whole. This is a sum per hash, combined before the
   shuffle, however often a text was copied.
3. Different segments around one anchor are compared, a single copy of each. Their strings are taken in
   blocks; a block whose core, the bytes that all its strings share, occurs once by its hash is out.
4. The rest of an anchor's segments is brought together. Their suffixes are sorted (two-stage sorting,
   see ``suffixes``) and adjacent common prefixes give the repeats.
5. An anchor with very many different segments would make one task too large; their strings in the
   blocks left are counted by hash instead, spread over all tasks.

Texts are known by two hashes of theirs, so ids may be null or repeat. Text bytes are shuffled only for
documents that a bitmap of fixed size does not rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingomark.llm import suffixes
from lingomark.llm.columns import spare
from lingomark.session import stage

LENGTH = 400
GRAM = 100
SPREAD = LENGTH - GRAM  # how far before its anchor a string can start
BUFFER = 1 << 17  # bytes of a scanned block and of a suffix array: what a core's cache holds
CROWD = 512  # different segments of an anchor that still go into one suffix array
CORE = 16  # strings of a block
BLOCKS_PER_TASK = 1 << 13  # blocks whose strings a task sorts
FILTER_BITS = 24  # the bitmap has 2**24 bits
_KEY = ["h", "g"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.col("doc_id").cast("long").alias("doc"), F.encode(text, "UTF-8").alias("text"))


def anchors_of(text: bytes, tables) -> np.ndarray:
    """Rows (anchor, first and last start of the strings it is the anchor of), ascending."""
    found = []
    for start in range(0, len(text) - LENGTH + 1, BUFFER):
        found.append(_anchors(np.frombuffer(text[start : start + BUFFER + LENGTH - 1], np.uint8), None, tables) + start)
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    # A range that goes on behind the end of a block is one range.
    opens = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1])
    closes = np.concatenate([opens[1:], [len(rows)]]) - 1
    return np.stack([rows[opens, 0], rows[opens, 1], rows[closes, 2]], axis=1)


def _anchors(data: np.ndarray, ends: np.ndarray | None, tables) -> np.ndarray:
    """Anchors of all strings of a buffer; ``ends`` (behind each byte's text) keeps strings inside texts."""
    best = suffixes.window_hashes(data, GRAM, tables)
    if len(best) < SPREAD + 1:
        return np.zeros((0, 3), np.int64)
    # Place in the low bits: the smallest is then the first of equal hashes.
    mask = np.uint64((1 << 22) - 1)
    best = (best & ~mask) | np.arange(len(best), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD + 1:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = SPREAD + 1 - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    starts = np.arange(len(best))
    if ends is not None:
        inside = ends[: len(best)] - starts >= LENGTH
        best, starts = best[inside], starts[inside]
    places = (best & mask).astype(np.int64)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    opens = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    closes = np.concatenate([opens[1:], [len(places)]]) - 1
    return np.stack([places[opens], starts[opens], starts[closes]], axis=1)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = suffixes.powers(BUFFER + LENGTH)
        digest = xxhash.xxh3_64_intdigest

        def rows(group: list[tuple[int, bytes]]) -> tuple[list, list]:
            """Index of the text and anchor rows, of texts scanned in one buffer."""
            data = np.frombuffer(b"".join(t for _, t in group), np.uint8)
            sizes = np.fromiter((len(t) for _, t in group), np.int64, len(group))
            last = np.cumsum(sizes)
            found = _anchors(data, np.repeat(last, sizes), tables)
            own = np.searchsorted(last, found[:, 0], side="right")
            return [group[k][0] for k in own.tolist()], (found - (last - sizes)[own][:, None]).tolist()

        for batch in batches:
            texts = [t.as_py() for t in batch.column(3)]
            index: list[int] = []
            places: list[list[int]] = []
            group, size = [], 0
            for k, text in enumerate(texts):
                if len(text) > BUFFER // 2:
                    found = anchors_of(text, tables).tolist()
                    index += [k] * len(found)
                    places += found
                    continue
                if size + len(text) > BUFFER:
                    a, b = rows(group)
                    index, places, group, size = index + a, places + b, [], 0
                group.append((k, text))
                size += len(text)
            if group:
                a, b = rows(group)
                index, places = index + a, places + b
            if not index:
                continue
            anchor, segment = np.zeros(len(index), np.uint64), np.zeros(len(index), np.uint64)
            for n, (k, (place, first, last)) in enumerate(zip(index, places, strict=True)):
                text = texts[k]
                anchor[n] = digest(text[place : place + GRAM])
                segment[n] = digest(text[first : last + LENGTH], place - first)
            take, where = pa.array(index, pa.int64()), np.array(places, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in range(3)), *(pa.array(where[:, c]) for c in range(3)),
                 pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))],
                ["h", "g", "doc", "place", "first", "last", "anchor", "segment"],
            )

    long_enough = docs.where(F.octet_length("text") >= LENGTH)
    return long_enough.mapInArrow(scan, "h long, g int, doc long, place long, first long, last long, anchor long, segment long")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the low hash bits that occur: a fixed 2 MB, whatever the number of keys."""
    low = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    parts = keys.groupBy(F.shiftright(low, 15).alias("part")).agg(
        F.bitmap_construct_agg(low.bitwiseAND((1 << 15) - 1)).alias("bits")
    )
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["part"] * 4096 : r["part"] * 4096 + len(own)] = own
    return np.unpackbits(bits, bitorder="little").view(bool)


def _likely(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose text's hash may be among the keys."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(keys)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).view(bool)
        for batch in batches:
            low = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            yield batch.filter(pa.array(known[low]))

    return docs.mapInArrow(choose, docs.schema)


def _work(rows: DataFrame) -> DataFrame:
    """Per text: its places with what is to be done there (covered whole, compared, compared by hash)."""
    # Numbers by anchor are added up in the map tasks and written: a join of two tables without a step in
    # between is one whose hot anchors the adaptive planner can split.
    times = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"))
    common = stage(times.where(F.col("times") > 1).select("anchor"), "common")
    again = stage(rows.join(common, "anchor", "left_semi"), "anchors-again")
    one = F.xxhash64("h", "g", "place")
    kinds = stage(
        again.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("chosen")), "kinds"
    )
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    known = kinds.join(stage(several, "several-kinds"), "anchor", "left").na.fill(1, ["kinds"])
    # A segment that occurs once is compared for itself, one of several as their representative.
    compared = (F.col("kinds") > 1) & ((F.col("times") == 1) | (one == F.col("chosen")))
    flagged = again.join(known, ["anchor", "segment"]).select(
        "h", "g", "doc", "place", "first", "last", "anchor", (F.col("times") > 1).alias("covered"),
        compared.alias("compared"), (F.col("kinds") > CROWD).alias("crowd"),
    ).where("covered OR compared")
    # Copies of a text say the same: once per text and place, before anything is gathered.
    unique = flagged.groupBy("h", "g", "place", "first", "last", "anchor", "covered", "compared", "crowd").agg(F.min("doc").alias("doc"))
    return unique.groupBy("h", "g").agg(
        F.min("doc").alias("doc"), F.collect_list(F.struct("place", "first", "last", "anchor", "covered", "compared", "crowd")).alias("places")
    )


def _texts_to_compare(docs: DataFrame, work: DataFrame) -> DataFrame:
    """(h, g, places, text) of one row of each text that has a place to compare."""
    chosen = work.select("h", "g", "doc", F.filter("places", lambda p: p["compared"]).alias("places")).where(F.size("places") > 0)
    chosen = chosen.select(
        "h", "g", F.col("doc").alias("reader"), F.transform("places", lambda p: F.struct(p["place"], p["first"], p["last"], p["anchor"], p["crowd"])).alias("places")
    )
    return _likely(docs, chosen).alias("d").join(
        chosen.alias("c"), (F.col("d.h") == F.col("c.h")) & (F.col("d.g") == F.col("c.g")) & F.col("d.doc").eqNullSafe(F.col("c.reader"))
    ).select("d.h", "d.g", "c.places", "d.text")


def _runs(h: list, g: list, starts: list, ends: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
        ["h", "g", "start", "behind"],
    )


def _sorted_runs(texts: DataFrame, tasks: int) -> DataFrame:
    """Repeated runs at the anchors without a crowd, by suffix arrays over whole groups of equal anchors.

    ``texts`` has the blocks whose core repeats; the parts of a segment without one cannot repeat.
    """

    def parts(place: dict, blocks: set[int]) -> list[tuple[int, int]]:
        return merged([
            (max(at, place["first"]), min(at + CORE - 1, place["last"]) + LENGTH) for at in _blocks(place) if at in blocks
        ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, g, places, text, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = set(ats)
                for p in places:
                    if not p["crowd"]:
                        rows += [(p["anchor"], h, g, a, text[a:b]) for a, b in parts(p, blocks)]
            if rows:
                anchor, h, g, start, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(data, pa.binary())],
                    ["anchor", "h", "g", "start", "data"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [r for own in held.values() if len(own) > 1 for r in own]
            held.clear()
            numbers: dict[tuple[int, int], int] = {}
            places = np.array([(numbers.setdefault((h, g), len(numbers)) << 40) + start for h, g, start, _ in rows], np.int64)
            runs = suffixes.repeats([r[3] for r in rows], places, LENGTH)
            if runs:
                yield _runs(
                    [rows[k][0] for k, _, _ in runs], [rows[k][1] for k, _, _ in runs],
                    [rows[k][2] + a for k, a, _ in runs], [rows[k][2] + b for k, _, b in runs],
                )

        for batch in batches:
            for anchor, h, g, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= BUFFER:
                    yield from flush()
                    size = 0
                last = anchor
                held.setdefault(anchor, []).append((h, g, start, data))
                size += len(data)
        yield from flush()

    return (
        texts.mapInArrow(cut, "anchor long, h long, g int, start long, data binary")
        .repartition(tasks, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, "h long, g int, start long, behind long")
    )


_ENTRY = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("h", "<i8"), ("g", "<i4"), ("many", "?"), ("at", "<i8")])
_BUCKET_BYTES = 32 << 20  # entries of a bucket that a task holds


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by hash; whether each opens a hash; whether its hash is at two starts, or marked."""
    rows = rows[np.lexsort((rows["at"], rows["g"], rows["h"], rows["hi"], rows["lo"]))]
    opens, other = np.ones(len(rows), bool), np.ones(len(rows), bool)
    opens[1:] = (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])
    other[1:] = opens[1:] | (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1]) | (rows["at"][1:] != rows["at"][:-1])
    group = np.cumsum(opens) - 1
    again = (np.bincount(group, weights=other) > 1) | (np.bincount(group, weights=rows["many"]) > 0)
    return rows, opens, again[group]


def _by_text(rows: np.ndarray) -> pa.RecordBatch:
    """(h, g, ats): the starts of each text."""
    rows = rows[np.lexsort((rows["at"], rows["g"], rows["h"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
    cuts = np.concatenate([np.flatnonzero(new), [len(rows)]])
    ats = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rows["at"]))
    return pa.RecordBatch.from_arrays([pa.array(rows["h"][new]), pa.array(rows["g"][new]), ats], ["h", "g", "ats"])


def _buckets(texts: DataFrame, step: int) -> int:
    """Buckets for the hashes of every ``step``-th start of the texts: their number follows the input."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1 << 12, -(-size // step * _ENTRY.itemsize // _BUCKET_BYTES))


def _counted(texts: DataFrame, starts_of, width: int, skip: int, buckets: int) -> DataFrame:
    """(h, g, ats): starts whose ``width`` bytes, ``skip`` behind them, occur at two starts or more.

    Starts that already repeat inside a batch are told by the batch, and only one of them goes on to the
    others. Hashes travel packed, those of a bucket in one row.
    """
    made = "bucket int, data binary, h long, g int, ats array<long>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            entries = []
            for h, g, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in starts_of(text, places):
                    code = digest(text[at + skip : at + skip + width])
                    entries.append((code & (1 << 64) - 1, code >> 64, h, g, False, at))
            if not entries:
                continue
            rows, opens, again = _grouped(np.array(entries, _ENTRY))
            rows["many"] = again
            told = _by_text(rows[again])
            none = len(told)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), *told.columns], ["bucket", "data", "h", "g", "ats"]
            )
            rows = rows[opens]
            bucket = (rows["lo"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            n = len(cuts) - 1
            packed = [rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                ["bucket", "data", "h", "g", "ats"],
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and held:
                    rows, _, again = _grouped(np.frombuffer(b"".join(held), _ENTRY))
                    # Marked starts were told by their batch.
                    yield _by_text(rows[again & ~rows["many"]])
                    held = []
                last = bucket
                held.append(data)
        if held:
            rows, _, again = _grouped(np.frombuffer(b"".join(held), _ENTRY))
            yield _by_text(rows[again & ~rows["many"]])

    parts = stage(texts.mapInArrow(local, made), "counted")
    others = (
        parts.where(F.col("bucket").isNotNull()).select("bucket", "data")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "h long, g int, ats array<long>")
    )
    return parts.where(F.col("bucket").isNull()).select("h", "g", "ats").union(others)


def _compared_runs(docs: DataFrame, work: DataFrame) -> DataFrame:
    """(h, g, runs) at the places where different segments share an anchor."""
    texts = stage(_texts_to_compare(docs, work), "compared")
    # Blocks are counted from the anchor, so that equal surroundings have equal blocks.
    blocks = _counted(texts, _block_starts, LENGTH - CORE + 1, CORE - 1, _buckets(texts, CORE))
    chosen = blocks.groupBy("h", "g").agg(F.flatten(F.collect_list("ats")).alias("ats"))
    kept = stage(texts.join(chosen, _KEY).select("h", "g", "places", "text", "ats"), "repeating")
    # Sorting is much work on few bytes: tasks by the blocks to sort.
    blocks_left = kept.agg(F.sum(F.size("ats").cast("long"))).first()[0] or 0
    runs = _sorted_runs(kept, max(1, -(-blocks_left // BLOCKS_PER_TASK))).select("h", "g", F.array(F.struct("start", "behind")).alias("runs"))
    crowds = kept.where(F.exists("places", lambda p: p["crowd"]))
    if not crowds.limit(1).count():
        return runs
    singles = _counted(
        crowds.select("h", "g", F.struct("places", "ats").alias("places"), "text"), _single_starts, LENGTH, 0, _buckets(crowds, 1)
    )
    counted = singles.select("h", "g", F.transform("ats", lambda a: F.struct(a.alias("start"), (a + LENGTH).alias("behind"))).alias("runs"))
    return runs.union(counted)


def _blocks(place: dict) -> Iterator[int]:
    """Starts of the blocks that hold strings of this anchor; they are counted from the anchor."""
    for at in range(place["place"] - SPREAD, place["place"] + 1, CORE):
        if at <= place["last"] and at + CORE > place["first"]:
            yield at


def _block_starts(text: bytes, places: list[dict]) -> list[int]:
    return sorted({at for p in places for at in _blocks(p)})


def _single_starts(text: bytes, found: dict) -> list[int]:
    """Starts of the strings in the repeating blocks of crowded anchors."""
    blocks = set(found["ats"])
    return sorted({
        s for p in found["places"] if p["crowd"] for at in _blocks(p) if at in blocks
        for s in range(max(at, p["first"]), min(at + CORE - 1, p["last"]) + 1)
    })


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(docs: DataFrame) -> DataFrame:
    """(h, g, spans, n_removed) of each text with repeats; spans are maximal, apart and ascending."""
    work = stage(_work(stage(_anchor_rows(docs), "anchors")), "work")
    whole = work.select(
        "h", "g",
        F.transform(
            F.filter("places", lambda p: p["covered"]),
            lambda p: F.struct(p["first"].alias("start"), (p["last"] + LENGTH).alias("behind")),
        ).alias("runs"),
    ).where(F.size("runs") > 0)
    runs = whole.union(_compared_runs(docs, work))
    gathered = runs.groupBy("h", "g").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("behind", pa.int64())])
        for batch in batches:
            spans = [merged([(r["start"], r["behind"]) for r in own.as_py()]) for own in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([[{"start": a, "behind": b} for a, b in own] for own in spans], pa.list_(span)),
                 pa.array([sum(b - a for a, b in own) for own in spans], pa.int64())],
                ["h", "g", "spans", "n_removed"],
            )

    made = "h long, g int, spans array<struct<start:bigint,behind:bigint>>, n_removed long"
    return stage(gathered.mapInArrow(join_up, made), "covered")


def remaining(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["behind"]
    return b"".join([*out, text[at:]])


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_run, passage.

    ``longest_run`` is the longest removed run in bytes; ``passage`` says that a part of the text goes and
    not the text as a whole, as it does for texts that occur twice.

    A byte goes if a string of 400 bytes over it also starts anywhere else, in the same text too. A null
    text is empty; texts of fewer than 400 bytes lose nothing; rows with equal texts, repeated rows among
    them, lose their texts whole if these are long enough. Ids may be null. Other columns are ignored;
    an empty table stays empty.
    """
    keyed = _keyed(docs)
    covered = _covered(keyed)
    rows = keyed.select("doc", "h", "g", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    # Only texts of which a part stays have to be read again.
    partial = covered.select("h", "g", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                hashlib.sha256(remaining(text.as_py(), spans.as_py())).hexdigest()
                for text, spans in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], ["h", "g", "kept"])

    whole = rows.select("h", "g", "n_bytes").distinct()
    partial = partial.join(covered.join(whole, _KEY).where(F.col("n_removed") < F.col("n_bytes")).select("h", "g"), _KEY, "left_semi")
    cut = (
        _likely(keyed.select("h", "g", "text"), partial).join(partial, _KEY).select("h", "g", "text", "spans")
        .mapInArrow(digest, "h long, g int, kept string")
    )
    longest = F.array_max(F.transform("spans", lambda s: s["behind"] - s["start"])).alias("longest")
    shares = covered.select("h", "g", "n_removed", F.size("spans").cast("long").alias("n_spans"), longest)
    # Written, so that the one join of the rows is of two plain tables and its hot texts can be split.
    told = stage(shares.join(cut.dropDuplicates(_KEY), _KEY, "left"), "told")
    return (
        rows.join(told, _KEY, "left")
        .select(
            F.col("doc").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
            F.when(F.col("n_removed").isNull(), F.col("sha"))
            .when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256))
            .otherwise(F.col("kept")).alias("kept_sha256"),
            F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
            F.coalesce(F.col("n_removed") < F.col("n_bytes"), F.lit(False)).alias("passage"),
        )
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the removed bytes cut out of ``text``; characters cut in two go whole."""
    h, g, spans_of = spare(docs.columns, "h", "g", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64(text).alias(h), F.hash(text).alias(g)]
    covered = _covered(_keyed(docs)).select(F.col("h").alias(h), F.col("g").alias(g), F.col("spans").alias(spans_of))
    rows = docs.select(*docs.columns, *key).join(covered, [h, g], "left").select(*docs.columns, spans_of)
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(len(docs_columns)).to_pylist()):
                if spans:
                    texts[k] = remaining(texts[k].encode("utf-8", "surrogatepass"), spans).decode("utf-8", "ignore")
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = list(docs.columns)
    return rows.mapInArrow(cut, docs.schema)
