"""URL filter: a fixed rule list, and association rules that FP-growth mines from labelled pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict and host/path of the rules that come before the mined ones.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "label:"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits a host (or its subdomains) and path start."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def step(rest: Column, rule: tuple[str, str]) -> Column:
        verdict, text = rule
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        return F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(rest)

    return reduce(step, reversed(longest), F.lit(None).cast("struct<rule:string,verdict:string>"))


def url_tokens(url: Column) -> Column:
    """Distinct words of host and path, told apart; numbers count as one token."""

    def words(text: Column, mark: str) -> Column:
        parts = F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(parts, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))

    return F.array_distinct(F.concat(words(host_of(url), "h:"), words(path_of(url), "p:")))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """Rules (rule_id, tokens, key, verdict, confidence) from pages with a verdict (url, verdict).

    ``key`` is the rarest token of a rule, under which the inverted index lists it. No labelled page
    gives no rule. Lift keeps rules that merely repeat the share of a verdict among all pages out.
    """
    baskets = labelled.select(
        F.array_union(url_tokens(F.col("url")), F.array(F.concat(F.lit(_LABEL), F.col("verdict")))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    label = F.col("consequent")[0]
    rules = model.associationRules.where(
        label.startswith(_LABEL)
        & ~F.exists("antecedent", lambda t: t.startswith(_LABEL))
        & (F.col("lift") >= min_lift)
    ).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(label, len(_LABEL) + 1, 100).alias("verdict"),
        "confidence",
    )
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
        .join(counts, "token")
        .groupBy("tokens", "verdict", "confidence")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    return rarest.withColumn("rule_id", F.concat_ws(" ", F.col("tokens")))


def mined_verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict of the surest rule for each distinct url that any rule fits; the others keep the default."""
    tokens = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", url_tokens(F.col("url")).alias("own"))
    found = (
        tokens.select("url", "own", F.explode("own").alias("key"))
        .join(rules, "key")
        .where(F.size(F.array_except("tokens", "own")) == 0)
    )
    best = F.max(F.struct("confidence", F.size("tokens").alias("n"), (F.col("verdict") != default).alias("other"), "rule_id", "verdict"))
    return found.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.rule_id").alias("mined_rule"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule.

    The list's verdict comes first, then the mined rules', then the default. A null url or one without
    ``://`` has an empty host and path, no rule and the default verdict. Repeated rows and urls are judged alike.
    """
    base = pages.select("page_id", "url")
    judged = mined_verdicts(base, mine_rules(labelled), default)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (
        base.join(judged, "url", "left")
        .select("page_id", host.alias("host"), path.alias("path"), "mined", "mined_rule")
        .withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
        .select(
            "page_id", "host", "path", F.col("listed.rule").alias("rule"),
            F.coalesce(F.col("listed.verdict"), F.col("mined"), F.lit(default)).alias("verdict"),
            F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"),
        )
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with the verdict of their label (page_id = doc_id): block if toxic or of low quality."""
    votes = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad")
    )
    joined = pages.select("page_id", "url").join(votes, F.col("page_id") == F.col("doc_id"))
    return joined.where(F.col("url").isNotNull()).select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
