"""Language identification by interpolated Kneser-Ney character models.

Letters are folded to 39 classes (a-z, and 13 for all other letters) and runs of anything else to one
blank, so a four-gram packs into a number below 40**4: this bounds the model of a language whatever
the corpus. Counts cover all training documents: dense per task, summed by Spark. The models are kept
as one sorted array of packed four-grams with a log probability per language, plus the tables of the
shorter contexts. The language with the lowest cross-entropy per symbol wins; documents whose
cross-entropy is far above that of training documents of their language and length are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

SYMBOLS, ORDER = 40, 4
GRAMS, CONTEXTS = SYMBOLS**4, SYMBOLS**3
BLOCK_CHARS = 2 << 20
HELD_LANGUAGES = 16  # dense count arrays in a task before they are handed on
DEVIATIONS, SLACK, FEWEST = 6.0, 0.5, 30
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1-26 for a-z, 27-39 for other letters."""
    points = range(0x110000)
    table = np.zeros(0x110000, np.uint8)
    letters = np.flatnonzero(np.fromiter(map(str.isalpha, map(chr, points)), bool, 0x110000))
    lower = np.fromiter((ord(chr(p).lower()[0]) for p in letters), np.int64, len(letters))
    plain = (lower >= 97) & (lower <= 122)
    table[letters] = np.where(plain, lower - 96, 27 + (lower * 2654435761 >> 12) % 13)
    return table


def grams_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed four-grams of all texts, the first gram of each text (and the end), letters per text."""
    joined = "\n\n\n" + "\n\n\n".join(texts)
    raw = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    ends = np.cumsum(lengths)
    starts = ends - lengths
    pad = np.zeros(len(raw), bool)
    for k in range(3):
        pad[starts + k] = True
    keep = raw > 0
    letters = np.add.reduceat(keep, starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    keep[1:] |= raw[:-1] > 0
    keep |= pad
    symbols, own = raw[keep].astype(np.int32), ~pad[keep]
    packed = np.zeros(len(symbols), np.int32)
    packed[3:] = ((symbols[:-3] * SYMBOLS + symbols[1:-2]) * SYMBOLS + symbols[2:-1]) * SYMBOLS + symbols[3:]
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(keep & ~pad, starts, dtype=np.int64))])
    return packed[own], bounds, letters


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Position and texts of consecutive blocks of about ``most`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def held_out(doc_id: Column) -> Column:
    """True for documents that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)
    return docs.where(usable & ~held_out(F.col("doc_id")))


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, dense in sums.items():
                seen = np.flatnonzero(dense)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(dense[seen], pa.int64())],
                    ["lang", "gram", "n"],
                )
            sums.clear()

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
                if lang not in sums and len(sums) >= HELD_LANGUAGES:
                    yield from flush()
                total = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                for _, block in blocks(texts):
                    total += np.bincount(grams_of(block, table)[0], minlength=GRAMS)
        yield from flush()

    local = rows.select("lang", "text").mapInArrow(count, "lang string, gram int, n long")
    return local.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _level(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities and log back-off weights of one order; counts (contexts, symbols)."""
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    discount = once / (once + 2 * twice) if once else 0.5
    total = counts.sum(1)
    seen = np.count_nonzero(counts, axis=1)
    used = np.maximum(total, 1)
    weight = np.where(total > 0, discount * seen / used, 1.0)
    own = np.maximum(counts - discount, 0) / used[:, None]
    return own + weight[:, None] * lower, np.log(weight)


def fit(counts: DataFrame) -> dict:
    """The models of all languages; ``counts`` holds at most 40**4 rows per language."""
    by_lang: dict[str, list] = {}
    for lang in sorted(r[0] for r in counts.select("lang").distinct().collect()):
        found = counts.where(F.col("lang") == lang).select("gram", "n").toPandas()
        by_lang[lang] = [found["gram"].to_numpy(), found["n"].to_numpy()]
    keys = np.unique(np.concatenate([g for g, _ in by_lang.values()] or [np.zeros(0, np.int32)])).astype(np.int32)
    logp = np.zeros((len(by_lang), len(keys)), np.float32)
    back = np.zeros((len(by_lang), CONTEXTS), np.float32)
    lower = np.zeros((len(by_lang), CONTEXTS), np.float32)
    for k, (grams, n) in enumerate(by_lang.values()):
        dense = np.zeros(GRAMS, np.int64)
        dense[grams] = n
        # Continuation counts: in how many different left contexts a shorter gram occurs.
        c3 = np.count_nonzero(dense.reshape(SYMBOLS, CONTEXTS), axis=0)
        c2 = np.count_nonzero(c3.reshape(SYMBOLS, -1), axis=0)
        c1 = np.count_nonzero(c2.reshape(SYMBOLS, -1), axis=0)
        p1, _ = _level(c1.reshape(1, -1), np.full((1, SYMBOLS), 1 / SYMBOLS))
        p2, _ = _level(c2.reshape(-1, SYMBOLS), p1)
        p3, _ = _level(c3.reshape(-1, SYMBOLS), np.tile(p2, (SYMBOLS, 1)))
        p4, back[k] = _level(dense.reshape(-1, SYMBOLS), np.tile(p3, (SYMBOLS, 1)))
        logp[k], lower[k] = np.log(p4.reshape(-1)[keys]), np.log(p3.reshape(-1))
    return {"langs": list(by_lang), "keys": keys, "logp": logp, "back": back, "lower": lower}


def look_up(model: dict, grams: np.ndarray) -> np.ndarray:
    """Log probabilities (languages, grams): from the sorted array, else by backing off."""
    if not len(model["keys"]):
        return np.zeros((len(model["langs"]), len(grams)))
    at = np.minimum(np.searchsorted(model["keys"], grams), len(model["keys"]) - 1)
    values = model["logp"][:, at]
    missing = np.flatnonzero(model["keys"][at] != grams)
    rest = grams[missing]
    values[:, missing] = model["back"][:, rest // SYMBOLS] + model["lower"][:, rest % CONTEXTS]
    return values


def cross_entropies(model: dict, texts: list[str], table: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: mean negative log probability per language (texts, languages), symbols, letters."""
    grams, bounds, letters = grams_of(texts, table)
    n = np.diff(bounds)
    present = np.flatnonzero(np.bincount(grams, minlength=GRAMS)).astype(np.int32)
    place[present] = np.arange(len(present), dtype=np.int32)
    rows = place[grams]
    sums = np.zeros((len(texts), len(model["langs"])))
    some = np.flatnonzero(n)
    if len(some):
        for k, values in enumerate(look_up(model, present)):
            sums[some, k] = np.add.reduceat(values[rows].astype(np.float64), bounds[:-1][some])
    return -sums / np.maximum(n, 1)[:, None], n, letters


def _scores(docs: DataFrame, model: dict, limits: dict, added: str) -> DataFrame:
    kept = docs.columns
    at = kept.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, place = sent.value, symbol_table(), np.zeros(GRAMS, np.int32)
        langs = known["langs"]
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "").to_pylist()
            pred, score, entropy, size, out = [], [], [], [], []
            for _, block in blocks(texts):
                ces, n, letters = cross_entropies(known, block, table, place)
                for ce, length, some in zip(ces, n.tolist(), letters.tolist(), strict=True):
                    if not some or not langs:
                        pred.append(UNKNOWN), score.append(0.0), entropy.append(None), out.append(True)
                    else:
                        best = int(ce.argmin())
                        lang, low = langs[best], float(ce[best])
                        pred.append(lang), entropy.append(low)
                        score.append(float(1 / np.exp((low - ce) * min(length, 50)).sum()))
                        out.append(low > limits.get((lang, length.bit_length()), limits.get((lang, None), np.inf)))
                    size.append(length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(entropy, pa.float64()), pa.array(size, pa.int64()), pa.array(out, pa.bool_())],
                [*kept, "lang_pred", "score", "entropy", "n_symbols", "rejected"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{types}, {added}")


_ADDED = "lang_pred string, score double, entropy double, n_symbols long, rejected boolean"


def calibrate(rows: DataFrame, model: dict) -> dict:
    """Highest accepted cross-entropy by language and power of two of the length, from training rows.

    Mean plus six deviations (and a small slack) of the training documents that are assigned to their
    language; lengths with few of them use the language's figures over all lengths.
    """
    size = F.length(F.bin("n_symbols"))
    scored = _scores(rows.select("lang", "text"), model, {}, _ADDED).where(F.col("lang") == F.col("lang_pred"))
    moments = scored.groupBy("lang", size.alias("bits")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("entropy").alias("s"), F.sum(F.col("entropy") ** 2).alias("s2")
    )
    limits: dict = {}
    overall: dict[str, np.ndarray] = {}
    for r in moments.collect():  # languages times at most 64 lengths
        own = np.array([r["n"], r["s"], r["s2"]])
        overall[r["lang"]] = overall.get(r["lang"], 0) + own
        if r["n"] >= FEWEST:
            limits[r["lang"], r["bits"]] = _limit(own)
    return limits | {(lang, None): _limit(own) for lang, own in overall.items() if own[0] >= FEWEST}


def _limit(moments: np.ndarray) -> float:
    n, s, s2 = moments
    return float(s / n + DEVIATIONS * np.sqrt(max(s2 / n - (s / n) ** 2, 0)) + SLACK)


def identify(docs: DataFrame) -> DataFrame:
    """The documents' columns plus held_out, lang_pred, score, entropy, n_symbols and rejected.

    Models are learned from all documents that are not held out and have an id, a text and a lang. A
    null text or one without letters is ``und`` with score 0 and rejected; so is every document if no
    language could be learned. Of equal cross-entropies the first language by name wins. ``score`` is
    the share of the winner among the languages over at most 50 symbols. Languages with fewer than 30
    training documents reject nothing. Existing columns of these names are replaced.
    """
    rows = training(docs)
    # Written: the fit reads the counts once per language, and not the texts.
    model = fit(stage(gram_counts(rows), "grams"))
    limits = calibrate(rows, model)
    added = ("held_out", "lang_pred", "score", "entropy", "n_symbols", "rejected")
    plain = docs.select(*[c for c in docs.columns if c.lower() not in added])
    return _scores(plain, model, limits, _ADDED).withColumn("held_out", held_out(F.col("doc_id")))


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, entropy, rejected."""
    return identify(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, unchanged."""
    return identify(docs).where(~F.col("rejected")).select(*docs.columns)
