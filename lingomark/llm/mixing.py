"""Soft-membership mixing: rates per document that bring expected domain token totals to targets.

A classifier trained on labelled documents gives every document a posterior over the domains. With
t_i tokens and posterior p_i, rates x_i >= 0 are fitted for which sum_i x_i t_i p_i meets the targets:
least squares by projected gradients, each step one or two aggregations over all documents. The steps
are a few numbers per domain, from which a document's rate follows. Only DataFrame operations and
Spark ML run on the executors.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.llm.columns import spare
from lingomark.session import stage

LOG = logging.getLogger(__name__)

TRAIN_ROWS = 20_000  # bound of the labelled sample the classifier is fitted on
FEATURES = 1 << 12
TOLERANCE = 1e-6  # of the token total, by which a domain may miss its target
PROGRESS = 1e-3  # of the squared misses, which a step has to take off
RIDGE = 1e-9  # keeps the dual steps finite where no rates meet the targets
OPTIMUM = 1e-9  # slope, in shares of all tokens, at which no step betters the rates
NEWTON_LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03)
GRADIENT_LENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
STEPS_PER_STAGE = 8  # steps between writing the rates, and in one expression
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, else high or low by quality. Rows without an id or mark are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return (
        labels.select("doc_id", domain.alias("domain"))
        .where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("domain").alias("domain"))
    )


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Input columns plus ``n_tokens`` (white-space words) and ``p_0 ... p_k``, one per domain.

    The classifier is fitted on at most ``train_rows`` labelled documents, the first by a hash of their
    id. With fewer than two domains among them the posterior is that domain's, or even without any.
    A null text counts as empty.
    """
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    text, words, hashed, vector, label, p, raw, best = spare(
        docs.columns, "text_", "words", "hashed", "vector", "label", "probability", "raw", "best"
    )
    # Bounded by train_rows, so it may be broadcast.
    chosen = (
        labelled.where(F.col("domain").isin(domains))
        .select("doc_id", at.cast("double").alias(label))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    sample = texts.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select(text, label)
    counts = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")
    seen = sorted(int(r[0]) for r in chosen.select(label).distinct().collect())
    if len(seen) < 2:
        even = [1.0 / len(domains) if not seen else float(k in seen) for k in range(len(domains))]
        return texts.select(*docs.columns, counts, *[F.lit(p).alias(f"p_{k}") for k, p in enumerate(even)])
    features = [
        RegexTokenizer(inputCol=text, outputCol=words, pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol=words, outputCol=hashed, numFeatures=FEATURES),
        Normalizer(inputCol=hashed, outputCol=vector),
    ]
    fit = LogisticRegression(
        featuresCol=vector, labelCol=label, probabilityCol=p, rawPredictionCol=raw,
        predictionCol=best, family="multinomial", maxIter=15, regParam=1e-3,
    )
    scored = Pipeline(stages=[*features, fit]).fit(sample).transform(texts)
    shares = vector_to_array(p)
    # Domains behind the last one seen have no entry in the model.
    return scored.select(
        *docs.columns, counts, *[F.coalesce(F.try_element_at(shares, F.lit(k + 1)), F.lit(0.0)).alias(f"p_{k}") for k in range(len(domains))]
    )


def _pull(u: np.ndarray) -> Column:
    return sum((F.col(f"p_{d}") * float(u[d]) for d in range(1, len(u))), F.col("p_0") * float(u[0]))


def _walked(start: Column, steps: list[np.ndarray]) -> Column:
    """The rate after projected steps: each moves along the posterior and is cut at 0."""
    for u in steps:
        start = F.greatest(F.lit(0.0), start - _pull(u))
    return start


def _dual_rates(known: DataFrame, target: np.ndarray, all_tokens: float, tolerance: float) -> tuple[Column, np.ndarray]:
    """Rates nearest to 1 that meet the targets, or come nearest to them where no rates do, and the misses.

    They are max(0, 1 - u p_i); Newton steps on the dual find u, one number per domain. Used where
    projected steps stall, as they do on the way to targets that no rates meet.
    """
    k = len(target)
    p = [F.col(f"p_{d}") for d in range(k)]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value, domain totals and Gram matrix of the rows with a rate, as shares of all tokens."""
        rated = known.select("t", *p, _walked(F.lit(1.0), [u]).alias("x"))
        held = F.when(F.col("x") > 0, F.col("t")).otherwise(0.0)
        now = rated.agg(
            F.sum(F.col("t") * F.col("x") * F.col("x")),
            *[F.sum(F.col("x") * F.col("t") * p[d]) for d in range(k)],
            *[F.sum(held * p[a] * p[b]) for a, b in pairs],
        ).first()
        gram = np.zeros((k, k))
        for (a, b), value in zip(pairs, now[k + 1 :], strict=True):
            gram[a, b] = gram[b, a] = value / all_tokens
        return now[0] / all_tokens / 2 + u @ target + RIDGE / 2 * (u @ u), np.array(now[1 : k + 1]) / all_tokens, gram

    u = np.zeros(k)
    value, sums, gram = at(u)
    while np.abs(sums - target).max() > tolerance:
        slope = target - sums + RIDGE * u
        if np.abs(slope).max() <= OPTIMUM + 1e-14 * np.abs(u).max():  # the rest is rounding
            break
        move = -np.linalg.solve(gram + RIDGE * np.eye(k), slope)
        length = 1.0
        while length > 1e-12:
            found = at(u + length * move)
            if found[0] < value and found[0] <= value + 1e-4 * length * (slope @ move):
                break
            length /= 4
        else:
            break  # no descent is left that doubles can tell
        u = u + length * move
        value, sums, gram = found
    return _walked(F.lit(1.0), [u]), sums - target


def fit_rates(rows: DataFrame, shares: list[float], budget: float | None = None, steps: int | None = None) -> Column:
    """The rate expression for rows with ``n_tokens`` and ``p_0 ...``; ``shares`` are the target weights.

    Projected-gradient least squares on the rates, from 1: with the misses r of the domain totals, the
    gradient of half their square is r p_i for document i, so that a step x_i <- max(0, x_i - u p_i) is
    told by one number u_d per domain. Two directions are tried at several lengths in one aggregation:
    the gradient over its largest curvature, and Newton's for the documents that are free to move, those
    with a rate or with a gradient that raises it. The best one is taken.

    ``budget`` is the wanted token total (all tokens there are, if not given). Steps end when every
    domain meets its target within ``TOLERANCE``. Where a step no longer takes ``PROGRESS`` off the squared
    misses, hardly any document is free or no rates meet the targets: :func:`_dual_rates` settles it. A
    miss that is left is logged as a warning, as it is when ``steps``, if given, run out. Without tokens
    all rates are 1.
    """
    k = len(shares)
    t = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}") for d in range(k)]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    known = rows.select(t.alias("t"), *p, F.lit(1.0).alias("x"))
    all_tokens = known.agg(F.sum("t")).first()[0]
    if not all_tokens:
        return F.lit(1.0)
    scale = 1.0 if budget is None else float(budget) / all_tokens
    target = np.array(shares) / sum(shares) * scale

    def gram(free: Column) -> np.ndarray:
        held = F.when(free, F.col("t")).otherwise(0.0)
        sums = known.agg(*[F.sum(held * p[a] * p[b]) for a, b in pairs]).first()
        out = np.zeros((k, k))
        for (a, b), value in zip(pairs, sums, strict=True):
            out[a, b] = out[b, a] = value / all_tokens
        return out

    def misses(moves: list[np.ndarray]) -> np.ndarray:
        """What the domains miss after each of the moves, as shares of all tokens."""
        rates = known.select("t", *p, *[_walked(F.col("x"), [u]).alias(f"x_{n}") for n, u in enumerate(moves)])
        sums = rates.agg(*[F.sum(F.col("t") * F.col(f"x_{n}") * p[d]) for n in range(len(moves)) for d in range(k)]).first()
        return np.array(sums).reshape(len(moves), k) / all_tokens - target

    steepest = float(np.linalg.eigvalsh(gram(F.lit(True)))[-1])
    miss = misses([np.zeros(k)])[0]
    done: list[np.ndarray] = []
    while np.abs(miss).max() > TOLERANCE * scale and (steps is None or len(done) < steps):
        free = gram((F.col("x") > 0) | (_pull(miss) < 0))
        newton, gradient = np.linalg.pinv(free, rcond=1e-10) @ miss, miss / steepest
        moves = [length * newton for length in NEWTON_LENGTHS] + [length * gradient for length in GRADIENT_LENGTHS]
        found = misses(moves)
        best = int(np.argmin((found**2).sum(1)))
        if (found[best] ** 2).sum() > (1 - PROGRESS) * (miss**2).sum():
            rate, miss = _dual_rates(known.select("t", *p), target, all_tokens, TOLERANCE * scale)
            break
        miss = found[best]
        done.append(moves[best])
        known = known.withColumn("x", _walked(F.col("x"), [moves[best]]))
        if len(done) % STEPS_PER_STAGE == 0:
            known = stage(known, "rates")
    else:
        rate = None
    if np.abs(miss).max() > TOLERANCE * scale:
        LOG.warning("rates miss the targets by %s of the token total after %d steps", np.round(miss / scale, 6).tolist(), len(done))
    if rate is not None:
        return rate
    if len(done) <= STEPS_PER_STAGE:
        return _walked(F.lit(1.0), done)
    # Many steps are a constant array that is folded over, not an expression of that depth.
    path = F.lit([u.tolist() for u in done])
    cut = lambda x, u: F.greatest(F.lit(0.0), x - sum((u[d] * p[d] for d in range(1, k)), u[0] * p[0]))
    return F.aggregate(path, F.lit(1.0), cut)


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    budget: float | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Input columns (or those to ``keep``) plus n_tokens, posteriors (by sorted domain name), rate, copies.

    ``copies`` is the rate rounded up or down by a hash of id and text, so that its expectation is the
    rate. Repeated rows get the same posterior and rate; null ids and texts are rated like others.
    Existing columns of these names are replaced. An empty table stays empty.
    """
    domains = sorted(targets)
    inner = [f"p_{d}" for d in range(len(domains))]
    added = ("n_tokens", "posteriors", "rate", "copies")
    kept = list(keep or [c for c in docs.columns if c.lower() not in added])
    own = [f"own_{k}" for k in range(len(kept))]
    base = docs.select("doc_id", "text", *[F.col(c).alias(o) for c, o in zip(kept, own, strict=True)])
    even = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # One scoring pass; the steps read its table, not the texts.
    rows = stage(
        posteriors(base, labelled, domains).select(*own, "n_tokens", even.alias("even"), *inner), "posteriors"
    )
    rate = fit_rates(rows, [targets[d] for d in domains], budget)
    return rows.withColumn("rate", rate).select(
        *[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], "n_tokens",
        F.array(*inner).alias("posteriors"),
        "rate", F.floor(F.col("rate") + F.col("even")).cast("int").alias("copies"),
    )
