"""Text features, chunking, rule passes and score parsing as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words (Unicode white space plus 0x1c-0x1f).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_BLANKS = " " * len(WHITESPACE)

# Sentences folded at a time when a text is cut into chunks.
FOLD_BLOCK = 256

# Sentence mark, chunk limit, score range and mark.
SENTENCE_MARK = ". "
CHUNK_LIMIT = 500
SCORE_MIN, SCORE_MAX = 0.0, 5.0
SCORE_MARK = "Score:"

# The rubric prompt around a transcript, and the prefix of correction requests.
PROMPT_HEAD = (
    "<|system|>You are an English grammar evaluator. Rate the grammar quality of the following "
    "transcript from 0 (worst) to 5 (perfect grammar).<|end|>\n<|user|>Transcript: "
)
PROMPT_TAIL = "<|end|>\n<|assistant|>Score:"
CORRECTION_PREFIX = "gec: "

# Word substitutions in the order they are applied.
WORD_SUBSTITUTIONS = (
    ("i", "I"),
    ("im", "I'm"),
    ("ur", "your"),
    ("u", "you"),
    ("r", "are"),
    ("y", "why"),
)


class Rule(NamedTuple):
    """One rule of a rule table: a Java regular expression and its replacement."""

    rule_id: str
    pattern: str
    replacement: str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Non-empty tokens between white space.

    Mapping every separator to a blank first keeps the split on its one-character fast path.
    """
    return F.array_remove(F.split(F.translate(text, WHITESPACE, _BLANKS), " "), "")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_nonblank(text: Column) -> Column:
    """True for a string with at least one non-white-space character; never NULL."""
    return F.coalesce(strip(text) != "", F.lit(False))


def num_words(text: Column, at_least_one: bool = False) -> Column:
    n = F.array_size(words(text))
    return F.greatest(n, F.lit(1)) if at_least_one else n


def avg_word_len(tokens: Column) -> Column:
    """Mean token length; 0 for a text without tokens."""
    return F.length(F.array_join(tokens, "")) / F.greatest(F.array_size(tokens), F.lit(1))


def text_length(text: Column) -> Column:
    return F.length(text)


def grammar_ratio(num_errors: Column, n_words: Column) -> Column:
    return num_errors / F.greatest(n_words, F.lit(1))


def sentences(text: Column) -> Column:
    return F.split(text, r"\. ")


def chunk_starts(parts: Column, limit: int = CHUNK_LIMIT) -> Column:
    """0-based index of the sentence that opens each chunk.

    ``aggregate`` copies its state at every step, so one fold over a long text would take
    quadratic time. The sentences are folded in blocks: the inner state holds the starts of one
    block only, the outer one grows once per block.
    """

    def add(state: Column, sentence: Column) -> Column:
        length = F.length(sentence)
        grown = state["size"] + length
        joins = (grown < limit) | (state["at"] == 0)
        return F.struct(
            F.when(joins, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["at"])))
            .alias("starts"),
            (F.when(joins, grown).otherwise(length) + len(SENTENCE_MARK)).alias("size"),
            (state["at"] + 1).alias("at"),
        )

    def add_block(state: Column, block: Column) -> Column:
        fresh = F.struct(
            F.array().cast("array<int>").alias("starts"), state["size"].alias("size"), state["at"].alias("at")
        )
        return let(
            F.aggregate(block, fresh, add),
            lambda done: F.struct(
                F.concat(state["starts"], done["starts"]).alias("starts"),
                done["size"].alias("size"),
                done["at"].alias("at"),
            ),
        )

    firsts = F.sequence(F.lit(1), F.array_size(parts), F.lit(FOLD_BLOCK))
    blocks = F.transform(firsts, lambda first: F.slice(parts, first, F.lit(FOLD_BLOCK)))
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at"))
    return F.aggregate(blocks, start, add_block, lambda state: state["starts"])


def chunks(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    """Pack sentences greedily into chunks.

    A sentence joins the open chunk while the characters of both stay below ``limit``; the mark
    that follows a sentence is written but not counted for the sentence being added. Chunks are
    stripped. A sentence that reaches the limit alone becomes one long chunk.
    """

    def cut(parts: Column, starts: Column) -> Column:
        def chunk(first: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.array_size(parts))
            joined = F.array_join(F.slice(parts, first + 1, stop - first), SENTENCE_MARK)
            return strip(F.concat(joined, F.lit(SENTENCE_MARK)))

        return F.transform(starts, chunk)

    return let(
        sentences(text),
        lambda parts: let(chunk_starts(parts, limit), lambda starts: cut(parts, starts)),
    )


def correction_units(text: Column, limit: int = CHUNK_LIMIT, original_when_single: bool = True) -> Column:
    """The strings a corrector sees: the chunks, or the untouched text when there is only one."""
    if not original_when_single:
        return chunks(text, limit)
    return let(
        chunks(text, limit),
        lambda cs: F.when(F.array_size(cs) == 1, F.array(text)).otherwise(cs),
    )


def join_chunks(corrected: Column) -> Column:
    return F.array_join(corrected, " ")


def build_prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), text, F.lit(PROMPT_TAIL))


def clamp(value: Column, low: float = SCORE_MIN, high: float = SCORE_MAX) -> Column:
    """Limit to a range; NULL stays NULL (``greatest`` alone would skip it).

    The value is bound once: a plain CASE would compute it for the test and for the result.
    """
    return let(
        value, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))
    )


def parse_score(reply: Column) -> Column:
    """Score in a free-text reply, or NULL.

    Takes the first token after the last mark (of the whole reply when there is no mark), keeps
    its digits and dots and clamps the number, so ``4/5`` reads 45 and becomes 5.
    """
    token = F.get(words(F.substring_index(reply, SCORE_MARK, -1)), F.lit(0))
    digits = F.regexp_replace(token, "[^0-9.]", "")
    return clamp(digits.try_cast("double"))


def word_diff_score(original: Column, corrected: Column) -> Column:
    """``max(0, 1 - changed / words)`` over word positions both texts have.

    Words past the shorter text count neither as equal nor as changed.
    """

    def score(pair: Column) -> Column:
        before, after = pair["before"], pair["after"]
        shared = F.least(F.array_size(before), F.array_size(after))
        changed = F.array_size(
            F.filter(
                F.zip_with(
                    F.slice(before, F.lit(1), shared),
                    F.slice(after, F.lit(1), shared),
                    lambda a, b: a != b,
                ),
                lambda differs: differs,
            )
        )
        share = F.greatest(F.lit(0.0), 1 - changed / F.greatest(F.array_size(before), F.lit(1)))
        return F.when(before.isNotNull() & after.isNotNull(), share)

    return let(
        F.struct(words(original).alias("before"), words(corrected).alias("after")), score
    )


def rule_table(table: DataFrame, order: str = "position") -> Column:
    """The rules of a table ``rule_id, pattern, replacement`` as one array, in the order of a column.

    A scalar subquery, to be made a column before :func:`table_hits` and :func:`apply_table` use it:
    the rules go from the table to the tasks, whatever their number, and are collected nowhere.
    """
    rules = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *Rule._fields)))
    return table.agg(rules).scalar()


def table_hits(text: Column, rules: Column) -> Column:
    """:func:`rule_hits` for the array of :func:`rule_table`."""
    return F.transform(
        rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), F.regexp_count(text, r["pattern"]).alias("hits"))
    )


def apply_table(text: Column, rules: Column) -> Column:
    """:func:`apply_rules` for the array of :func:`rule_table`."""
    return F.aggregate(rules, text, lambda t, r: F.regexp_replace(t, r["pattern"], r["replacement"]))


def rule_hits(text: Column, rules: Sequence[Rule]) -> Column:
    """Array of ``(rule_id, hits)``, one element per rule."""
    return F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.regexp_count(text, F.lit(r.pattern)).alias("hits"),
            )
            for r in rules
        ]
    )


def rule_error_count(text: Column, rules: Sequence[Rule]) -> Column:
    """All rule hits in a text."""
    total = F.lit(0)
    for r in rules:
        total = total + F.regexp_count(text, F.lit(r.pattern))
    return total


def apply_rules(text: Column, rules: Iterable[Rule]) -> Column:
    """Apply the rules one after the other, in the given order."""
    for r in rules:
        text = F.regexp_replace(text, r.pattern, r.replacement)
    return text


def word_rule(word: str, replacement: str) -> Rule:
    """Rule for a whole word between ASCII word boundaries.

    The Java ``\\b`` also looks at accented letters, hence the explicit class. Testing the letter
    before the look-behind lets the matcher skip most positions.
    """
    body = re.escape(word)
    edge = "[A-Za-z0-9_]"
    pattern = f"{body}(?<!{edge}{body})(?!{edge})"
    return Rule(f"word_{word}", pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))


WORD_RULES: tuple[Rule, ...] = tuple(word_rule(w, r) for w, r in WORD_SUBSTITUTIONS)


def substitute_words(text: Column) -> Column:
    """The built-in substitutions, case-sensitive and in their fixed order."""
    return apply_rules(text, WORD_RULES)


def token_hash(token: Column) -> Column:
    """Non-negative 32-bit hash of a token that every SQL engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def token_batch(text: Column, max_length: int, vocabulary: int = 30522, pad: bool = True) -> Column:
    """Struct of ``input_ids`` and ``attention_mask``, truncated and padded to ``max_length``.

    Ids are hashed words in ``1 .. vocabulary - 1``; 0 is the padding id.
    """

    def fill(kept: Column) -> Column:
        ids = F.transform(kept, lambda w: token_hash(w) % (vocabulary - 1) + 1)
        mask = F.array_repeat(F.lit(1), F.array_size(kept))
        if pad:
            missing = F.lit(max_length) - F.array_size(kept)
            ids = F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), missing))
            mask = F.concat(mask, F.array_repeat(F.lit(0), missing))
        return F.struct(ids.alias("input_ids"), mask.alias("attention_mask"))

    return let(F.slice(words(text), 1, max_length), fill)


def error_text(message: Column) -> Column:
    return F.concat(F.lit("Error: "), message)


def choose_text(text_input: Column, transcript: Column, prefer_audio: bool = False) -> Column:
    """Typed text wins when it is non-empty; with ``prefer_audio`` the transcript does."""
    first, second = (transcript, text_input) if prefer_audio else (text_input, transcript)
    return F.when(F.length(first) > 0, first).otherwise(F.coalesce(second, F.lit("")))


def clean_name(path: Column) -> Column:
    """Base name of a path: blanks trimmed, back slashes turned, folders dropped."""
    return F.substring_index(F.translate(strip(path), "\\", "/"), "/", -1)


def safe_name(name: Column) -> Column:
    """ASCII file name: separators to blanks, runs of white space to one ``_``, other marks gone."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"[/\\]", " "), r"[^\x00-\x7f]", "")
    joined = F.array_join(words(spaced), "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
