"""Equivalent DuckDB SQL of the registered queries, for checking their results."""

from __future__ import annotations

import math

from lingomark.functions.text import (
    CORRECTION_PREFIX,
    PROMPT_HEAD,
    PROMPT_TAIL,
    WHITESPACE,
    WORD_SUBSTITUTIONS,
)
from lingomark.plans.request import NO_INPUT

FRAME, HOP, VECTOR_SIZE = 16, 8, 64

# Character class of all separators, as code points.
BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"

# The example rule table in RE2 syntax.
RULES = (
    ("word_the the", r"\bthe the\b", "the"),
    ("mark_run", "[!?]{2,}", "!"),
    ("symbol_run", r"#+|\*{2,}", ""),
    ("article", r"\b([aA]) ([aeiou])", r"\1n \2"),
    ("long_number", "[0-9]{3,}", "number"),
)

SHORTHAND = (("the", "u"), ("of", "i"), ("and", "r"), ("to", "im"), ("in", "ur"), ("de", "y"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"[w for w in string_split_regex({text}, '{BLANK}+') if w <> '']"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def substituted(text: str) -> str:
    for word, replacement in WORD_SUBSTITUTIONS:
        text = f"regexp_replace({text}, '\\b{word}\\b', {quoted(replacement)}, 'g')"
    return text


def ruled(text: str, rules=RULES) -> str:
    for _, pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', {quoted(replacement)}, 'g')"
    return text


def shorthand(text: str) -> str:
    for word, short in SHORTHAND:
        text = f"replace({text}, ' {word} ', ' {short} ')"
    return text


def diff_score(before: str, after: str) -> str:
    """Positional word comparison of two word lists."""
    shared = f"least(len({before}), len({after}))"
    changed = f"len([i for i in range(1, {shared} + 1) if {before}[i] <> {after}[i]])"
    return f"greatest(0.0, 1 - {changed}::DOUBLE / greatest(len({before}), 1))"


def chunk_ctes(source: str, key: str = "id", text: str = "text") -> str:
    """CTEs ``sentence``, ``fold`` and ``chunk(id, chunk_no, chunk)`` over ``source(id, text)``."""
    return f"""
sentence AS (
  SELECT {key} AS id, unnest(string_split({text}, '. ')) AS s,
         generate_subscripts(string_split({text}, '. '), 1) AS i
  FROM {source}),
fold AS (
  SELECT id, i, length(s) + 2 AS size, 0 AS chunk_no FROM sentence WHERE i = 1
  UNION ALL
  SELECT n.id, n.i,
         CASE WHEN f.size + length(n.s) < 500 THEN f.size + length(n.s) + 2 ELSE length(n.s) + 2 END,
         CASE WHEN f.size + length(n.s) < 500 THEN f.chunk_no ELSE f.chunk_no + 1 END
  FROM fold f JOIN sentence n ON n.id = f.id AND n.i = f.i + 1),
chunk AS (
  SELECT id, chunk_no, {strip("string_agg(s || '. ', '' ORDER BY i)")} AS chunk
  FROM fold JOIN sentence USING (id, i) GROUP BY id, chunk_no)"""


def cascade_ctes(source: str, rules=(), model=substituted) -> str:
    """Adds ``corrected(id, text, fixed)``: model and rules per unit, join, rules again."""
    per_chunk = ruled(model("chunk"), rules)
    single = ruled(model("t.text"), rules)
    several = ruled("p.joined", rules)
    return f"""{chunk_ctes(source)},
pieces AS (
  SELECT id, count(*) AS n, string_agg({per_chunk}, ' ' ORDER BY chunk_no) AS joined
  FROM chunk GROUP BY id),
corrected AS (
  SELECT t.id, t.text, CASE WHEN p.n = 1 THEN {single} ELSE {several} END AS fixed
  FROM {source} t JOIN pieces p USING (id))"""


SCORE5 = f"round(least(5.0, {diff_score('before', 'after')} * 5), 9)"
DOCS = "source AS (SELECT doc_id AS id, text FROM documents)"


def scored_sql(source: str) -> str:
    """CTE ``scored(id, text, fixed, score)`` over ``source(id, text, fixed)``."""
    return f"""
scored AS (
  SELECT id, text, fixed, {SCORE5} AS score
  FROM (SELECT *, {words('text')} AS before, {words('fixed')} AS after FROM {source}))"""


SCORED = scored_sql("corrected")

TOKEN_HASH = "('0x' || substr(md5({w}), 1, 8))::BIGINT"


def uniform(name: str) -> str:
    return f"(({TOKEN_HASH.format(w=name)}) + 0.5) / 4294967296.0"


LABELLED = """labelled AS (
  SELECT d.doc_id, quality * 4.0::DOUBLE + 0.5 AS actual, (n_chars % 50)::DOUBLE / 10 AS predicted,
         ((n_chars + toxic) % 40)::DOUBLE / 8 AS second
  FROM documents d JOIN labels l USING (doc_id))"""

OUTCOMES = """outcomes AS (
  SELECT conv_id || '-' || turn AS key, role,
         CASE WHEN length(text) >= 120 THEN text END AS transcript,
         CASE WHEN length(text) >= 120 THEN (length(text) % 50)::DOUBLE / 10 END AS grammar_score,
         CASE WHEN length(text) < 120 THEN 'too short: ' || length(text) END AS error
  FROM conversations)"""

SIGNS = "[CASE WHEN v > 0 THEN 1.0::DOUBLE WHEN v < 0 THEN -1.0 ELSE 0.0 END for v in embedding]"
ZCR = f"list_sum([abs(({SIGNS})[i + 1] - ({SIGNS})[i]) for i in range(1, len(embedding))]) / (len(embedding) - 1)"
RMS = "sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in embedding]) / len(embedding))"

REPLY = """CASE n_chars % 7
  WHEN 0 THEN 'Score: ' || n_chars % 9
  WHEN 1 THEN 'Score:' || n_chars % 9 || '/5 because'
  WHEN 2 THEN 'I say Score: 1 and then Score: ' || n_chars % 9 || '.25'
  WHEN 3 THEN 'Score: n/a'
  WHEN 4 THEN n_chars % 9 || ' without a mark'
  WHEN 5 THEN 'Score: -' || n_chars % 9
  ELSE 'Score:' || chr(10) || '1.2.' || n_chars % 9 END"""


def parsed_score(reply: str) -> str:
    token = f"({words(f'list_last(string_split({reply}, {quoted('Score:')}))')})[1]"
    number = f"try_cast(regexp_replace({token}, '[^0-9.]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN {number} IS NOT NULL THEN least(greatest({number}, 0.0), 5.0) END"


def split_sql(share: float, key: str = "doc_id") -> str:
    rank = f"row_number() OVER (ORDER BY md5('42:' || {key}), {key})"
    return f"CASE WHEN {rank} <= ceil((count(*) OVER ()) * {share}::DOUBLE) THEN 'val' ELSE 'train' END"


DAMAGED = f"""damaged AS (
  SELECT vec_id, label,
    CASE vec_id % 5
      WHEN 1 THEN [CASE WHEN i = 4 THEN 'nan'::DOUBLE ELSE embedding[i]::DOUBLE END for i in range(1, 65)]
      WHEN 2 THEN embedding[1:63]::DOUBLE[] WHEN 3 THEN NULL ELSE embedding::DOUBLE[] END AS e
  FROM embeddings),
guarded AS (
  SELECT vec_id, CASE WHEN vec_id % 5 IN (1, 2, 3) THEN [0.0::DOUBLE for i in range(0, 64)] ELSE e END AS e
  FROM damaged)"""

SIGNAL = f"""signal AS (
  SELECT vec_id AS doc_id, len(embedding) / 16000.0::DOUBLE AS duration,
         {ZCR} AS zero_crossing_rate, {RMS} AS rmse FROM embeddings)"""

# 64 samples in one centred frame of 2048: samples sit at positions 1024 .. 1087 of the frame.
WAV = f"""clip AS (
  SELECT vec_id, [greatest(-32768, least(32767, floor(v::DOUBLE * 32768 + 0.5))) / 32768 for v in embedding] AS y
  FROM embeddings),
bin AS (SELECT unnest(range(0, 1025)) AS k),
point AS (
  SELECT j, 0.5 - 0.5 * cos(2 * pi() * (1024 + j) / 2048) AS w FROM (SELECT unnest(range(0, 64)) AS j)),
turn AS (
  SELECT k, j, w * cos(2 * pi() * ((k * (1024 + j)) % 2048) / 2048) AS c,
         w * sin(2 * pi() * ((k * (1024 + j)) % 2048) / 2048) AS s FROM bin, point),
sample AS (SELECT vec_id, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS j FROM clip),
magnitude AS (
  SELECT vec_id, k, sqrt(sum(v * c) ** 2 + sum(v * s) ** 2) AS m
  FROM sample JOIN turn USING (j) GROUP BY vec_id, k),
running AS (
  SELECT vec_id, k, m, sum(m) OVER (PARTITION BY vec_id ORDER BY k) AS upto,
         sum(m) OVER (PARTITION BY vec_id) AS total FROM magnitude),
spectrum AS (
  SELECT vec_id, sum(m * k * 7.8125::DOUBLE) / sum(m) AS centroid,
         min(k * 7.8125::DOUBLE) FILTER (upto >= 0.85 * total) AS rolloff FROM running GROUP BY vec_id)"""


# Clips of twenty vectors: samples, then frames of 2048 around every 512th sample.
CLIPS = """sample AS (
  SELECT vec_id // 20 AS clip, vec_id, i, greatest(-32768, least(32767, floor(v::DOUBLE * 32768 + 0.5))) / 32768 AS y
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
numbered AS (
  SELECT clip, y, row_number() OVER (PARTITION BY clip ORDER BY vec_id, i) - 1 AS pos FROM sample),
moved AS (
  SELECT clip, pos, y, coalesce((y < 0) <> (lag(y) OVER w < 0), false) AS changed,
         abs(sign(y) - sign(lag(y) OVER w)) AS step
  FROM numbered WINDOW w AS (PARTITION BY clip ORDER BY pos)),
whole AS (
  SELECT clip, count(*) AS n_samples, avg(step) AS zero_crossing_global, sqrt(avg(y * y)) AS rms_global
  FROM moved GROUP BY clip),
frame AS (
  SELECT clip, unnest(range(0, n_samples // 512 + 1)) AS f FROM whole),
level AS (
  SELECT clip, f, sqrt(sum(y * y) / 2048) AS rms,
         count(*) FILTER (changed AND pos > f * 512 - 1024) / 2048.0::DOUBLE AS crossings
  FROM frame JOIN moved USING (clip) WHERE pos >= f * 512 - 1024 AND pos < f * 512 + 1024 GROUP BY clip, f),
clip AS (
  SELECT clip, n_samples, n_samples / 16000.0::DOUBLE AS duration, zero_crossing_global, rms_global,
         avg(crossings) AS zero_crossing_rate, avg(rms) AS rmse
  FROM level JOIN whole USING (clip) GROUP BY ALL)"""

UPLOADS = """upload AS (
  SELECT key, text, CASE WHEN damaged THEN 16 WHEN emptied THEN 44 ELSE 44 + strlen(text) END AS size,
         CASE WHEN damaged THEN 'file does not start with RIFF id' WHEN emptied OR text = '' THEN 'no audio data' END AS broken
  FROM (SELECT conv_id || '-' || turn AS key, text, conv_id % 5 = 0 AS damaged, turn % 4 = 3 AS emptied FROM conversations)),
judged AS (
  SELECT key, text, size > 700 AS large, broken,
         'File size (' || size || ' bytes) exceeds maximum allowed size (700 bytes)' AS too_large FROM upload)"""


# Columns that are 32-bit integers in Spark, where DuckDB yields 64 bits.
INTEGERS = {
    "text_features": ("num_words", "text_length"),
    "sentence_counts": ("sentences",),
    "correct_cascade": ("variant_length",),
    "rule_error_counts": ("hits",),
    "rule_table_counts": ("hits",),
    "grammar_ratio": ("num_errors", "num_words"),
    "prompt_build": ("request_length",),
    "vector_guards": ("dim",),
    "zero_replace": ("dim",),
    "feature_merge": ("num_words", "text_length"),
    "history_latest10": ("rank",),
    "stream_history": ("rank",),
    "mean_pool": ("dim",),
    "masked_token_pool": ("dim",),
    "combined_features": ("num_words", "text_length"),
    "hashed_embedding": ("dim",),
    "delivered_tables": ("transcript_length", "corrected_length"),
    "feature_file": ("dim",),
    "clip_features": ("sr", "channels"),
    "feature_dataset": ("num_words", "text_length"),
    "training_rows": ("num_words",),
    "resumed_features": ("num_words", "text_length"),
    "full_contract": ("num_words", "num_errors", "size"),
    "nonblank_texts": ("text_length",),
}


def oracle_sql() -> dict[str, str]:
    """SQL per query, with the integer widths of the Spark results."""
    sql = _statements()
    for name, columns in INTEGERS.items():
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
        sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]})"
    return sql


def article(text: str) -> str:
    """What the example model makes of a unit."""
    return f"replace({text}, ' the ', ' a ')"


# A text with a unit that the example model refuses stays as it is.
REFUSING = """
answered AS (
  SELECT id, text, CASE WHEN contains(text, '###') THEN text ELSE fixed END AS fixed,
         CASE WHEN contains(text, '###') THEN 'refused' END AS error FROM corrected)"""


def response_sql(source: str, cascade: str | None = None, fixed: str = "corrected") -> str:
    """CTEs that answer ``source(key, typed, heard, lost)``."""
    return f"""{source},
chosen AS (
  SELECT key, coalesce(heard, '') AS transcription,
    CASE WHEN length(typed) > 0 THEN typed ELSE coalesce(heard, '') END AS text,
    CASE WHEN heard IS NULL AND lost IS NULL AND coalesce(length(typed), 0) = 0 THEN {quoted(NO_INPUT)}
         WHEN (heard IS NOT NULL OR lost IS NOT NULL) AND lost IS NOT NULL THEN lost
         WHEN coalesce(length(typed), 0) = 0 AND coalesce(length(heard), 0) = 0 THEN 'No text to process.'
    END AS error FROM asked),
asked_text AS (SELECT key AS id, text FROM chosen),
{cascade or cascade_ctes("asked_text")},{scored_sql(fixed)},
answer AS (
  SELECT key, CASE WHEN error IS NULL THEN transcription ELSE '' END AS transcription,
         CASE WHEN error IS NULL THEN c.text ELSE '' END AS originalText,
         CASE WHEN error IS NULL THEN fixed ELSE '' END AS correctedText,
         CASE WHEN error IS NULL THEN score ELSE 0.0 END AS grammarScore, error
  FROM chosen c JOIN scored s ON s.id = c.key)"""


def _statements() -> dict[str, str]:
    emb = ", ".join(f"embedding[{i + 1}]::DOUBLE AS emb_{i}" for i in range(VECTOR_SIZE))
    radius = uniform("vec_id || ':' || i || ':r'")
    angle = uniform("vec_id || ':' || i || ':a'")
    conversation_text = "source AS (SELECT conv_id || '-' || turn AS id, text FROM conversations)"
    history = """
SELECT user_id, rank, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events) WHERE rank <= 10"""
    summary = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM features"""
        for c in ("num_words", "avg_word_len", "text_length")
    )
    features = f"""features AS (
  SELECT doc_id, len({words('text')}) AS num_words,
    length(regexp_replace(text, '{BLANK}+', '', 'g'))::DOUBLE / greatest(len({words('text')}), 1) AS avg_word_len,
    length(text) AS text_length FROM documents)"""
    hits = " UNION ALL ".join(
        f"SELECT doc_id, '{rule}' AS rule_id, len(regexp_extract_all(text, '{pattern}')) AS hits FROM documents"
        for rule, pattern, _ in RULES
    )
    errors = " + ".join(f"len(regexp_extract_all(text, '{pattern}'))" for _, pattern, _ in RULES)
    shown = f"'{CORRECTION_PREFIX}'"
    frame_count = (VECTOR_SIZE - FRAME) // HOP + 1
    token_bucket = TOKEN_HASH.format(w="w")
    refused = f"""WITH RECURSIVE {DOCS}, {cascade_ctes('source', RULES[:1], article)},{REFUSING}
SELECT id AS doc_id, fixed AS corrected_text, error FROM answered"""
    trained = f"""SELECT vec_id, label * 0.5::DOUBLE AS label, true AS in_range, true AS mse_below_variance,
  {split_sql(0.15, 'vec_id')} AS split FROM embeddings"""
    requests = """asked AS (
  SELECT conv_id || '-' || turn AS key, CASE WHEN role = 'user' THEN text END AS typed,
         CASE WHEN role = 'assistant' THEN text END AS heard,
         CASE WHEN role = 'system' AND conv_id % 2 = 0
              THEN 'Audio file not found: ' || conv_id || '-' || turn END AS lost FROM conversations)"""
    clip_rows = f"""WITH RECURSIVE {CLIPS},
source AS (SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id)),
{cascade_ctes('source', RULES[:1], article)},{REFUSING},
compared AS (SELECT id, text, fixed, {words('text')} AS before, {words('fixed')} AS after FROM answered)
SELECT id::VARCHAR AS filename, round(duration, 9) AS duration, round(zero_crossing_rate, 9) AS zero_crossing_rate,
  round(rmse, 9) AS rmse, round({diff_score('before', 'after')}, 9) AS grammar_score_model, text AS original_text,
  fixed AS corrected_text, greatest(len(before), 1) AS num_words,
  round(length(regexp_replace(text, '{BLANK}+', '', 'g'))::DOUBLE / greatest(len(before), 1), 9) AS avg_word_len,
  length(text) AS text_length, CASE WHEN id % 7 > 0 THEN quality * 5.0::DOUBLE END AS label,
  CASE WHEN clip IS NULL THEN 'Audio file not found: ' || id WHEN {strip('text')} = '' THEN 'No transcript'
       WHEN id % 7 = 0 THEN 'No numeric label' END AS error
FROM compared JOIN labels ON doc_id = id LEFT JOIN clip ON clip = id"""
    heard = """asked AS (
  SELECT key, NULL::VARCHAR AS typed, CASE WHEN NOT large AND broken IS NULL AND length(text) % 11 > 0 THEN text END AS heard,
         CASE WHEN large THEN 'Invalid audio file: ' || too_large WHEN broken IS NOT NULL THEN 'Invalid audio file: ' || broken
              WHEN length(text) % 11 = 0 THEN 'Error processing input: cannot make out ' || length(text) END AS lost FROM judged)"""
    by_model = f"{cascade_ctes('asked_text', RULES[:1], article)},{REFUSING}"
    return {
        "flagship": f"""WITH RECURSIVE {DOCS}, {cascade_ctes('source')},{SCORED}
SELECT id AS filename, score AS label FROM scored""",
        "text_features": f"""WITH {features}
SELECT doc_id, num_words, round(avg_word_len, 9) AS avg_word_len, text_length FROM features""",
        "text_chunks": f"""WITH RECURSIVE {DOCS}, {chunk_ctes('source')}
SELECT id AS doc_id, chunk_no, chunk FROM chunk""",
        "sentence_counts": "SELECT doc_id, len(string_split(text, '. ')) AS sentences FROM documents",
        "rule_correct": f"""SELECT doc_id, {substituted(shorthand('text'))} AS substituted,
  {ruled('text')} AS rule_corrected FROM documents""",
        "correct_cascade": f"""WITH RECURSIVE {DOCS}, {cascade_ctes('source', RULES)},
variant AS (
  SELECT id, length(string_agg({substituted('chunk')}, ' ' ORDER BY chunk_no)) AS variant_length
  FROM chunk GROUP BY id)
SELECT id AS doc_id, fixed AS corrected_text, variant_length FROM corrected JOIN variant USING (id)""",
        "chunk_predictor": refused,
        "distinct_predictor": refused,
        "word_diff_score": f"""SELECT doc_id, round({diff_score('before', 'after')}, 9) AS grammar_score_model
FROM (SELECT doc_id, {words('text')} AS before, {words(ruled('text'))} AS after FROM documents)""",
        "rule_error_counts": hits,
        "rule_table_counts": hits,
        "rule_dictionary_counts": f"""WITH run AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents),
example AS ({hits})
SELECT doc_id, 'word_' || w AS rule_id, count(*) AS hits FROM run WHERE regexp_full_match(w, '[A-Za-z]{{5,}}') GROUP BY ALL
UNION ALL SELECT doc_id, rule_id, hits::BIGINT FROM example WHERE hits > 0""",
        "made_sounds": """SELECT s_suppkey, 90 + s_suppkey % 3 * 30 AS beats, true AS tempo_found,
  true AS power_grows_with_the_square, true AS level_found FROM supplier""",
        "rule_table_correct": f"SELECT doc_id, {ruled('text')} AS rule_corrected FROM documents",
        "grammar_ratio": f"""SELECT doc_id, num_errors, num_words,
  round(num_errors::DOUBLE / greatest(num_words, 1), 9) AS grammar_ratio
FROM (SELECT doc_id, {errors} AS num_errors, greatest(len({words('text')}), 1) AS num_words FROM documents)""",
        "prompt_build": f"""SELECT doc_id, {quoted(PROMPT_HEAD)} || text || {quoted(PROMPT_TAIL)} AS prompt,
  length({shown} || text) AS request_length FROM documents""",
        "score_parse": f"SELECT doc_id, {parsed_score(f'({REPLY})')} AS grammar_score FROM documents",
        "rubric_scores": """SELECT doc_id, least(5.0, (length(text) % 11)::DOUBLE / 2) AS grammar_score
FROM documents""",
        "token_pad_mask": f"""SELECT doc_id,
  list_aggregate(list_concat([(({TOKEN_HASH.format(w='w')}) % 30521 + 1)::VARCHAR for w in kept],
    ['0' for i in range(0, 128 - len(kept))]), 'string_agg', ' ') AS input_ids,
  list_aggregate(list_concat(['1' for w in kept], ['0' for i in range(0, 128 - len(kept))]),
    'string_agg', ' ') AS attention_mask
FROM (SELECT doc_id, ({words('text')})[1:128] AS kept FROM documents)""",
        "submission": """SELECT doc_id AS filename, quality * 5.0::DOUBLE AS label
FROM documents JOIN labels USING (doc_id)""",
        "index_export": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id AS filename,
  quality * 5.0::DOUBLE AS label FROM documents JOIN labels USING (doc_id)""",
        "index_import": """SELECT doc_id AS filename, quality * 5.0::DOUBLE AS label
FROM documents JOIN labels USING (doc_id)""",
        "widen_embedding": f"SELECT vec_id, {emb} FROM embeddings",
        "vector_guards": f"""WITH {DAMAGED}
SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(e) AS value FROM guarded""",
        "zero_replace": f"""WITH {DAMAGED},
long AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS v FROM guarded)
SELECT vec_id, i AS dim, round(CASE WHEN vec_id % 5 IN (1, 2, 3)
  THEN sqrt(-2.0 * ln({radius})) * cos({2 * math.pi!r} * {angle}) * 0.01 ELSE v END, 9) AS value FROM long""",
        "null_fill": """SELECT doc_id, CASE WHEN lang <> 'en' THEN lang ELSE '' END AS lang,
  coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
        "target_mean_fill": """SELECT doc_id,
  round(coalesce(quality::DOUBLE, (SELECT avg(quality) FROM documents JOIN labels USING (doc_id))), 9) AS quality
FROM documents LEFT JOIN labels USING (doc_id)""",
        "any_null": """WITH t AS (SELECT n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'n_chars' AS column_name, bool_or(n_chars IS NULL) AS has_null FROM t
UNION ALL SELECT 'quality', bool_or(quality IS NULL) FROM t
UNION ALL SELECT 'toxic', bool_or(toxic IS NULL) FROM t""",
        "manifest_resolve": """SELECT d.doc_id,
  CASE WHEN l.quality IS NULL THEN 'Audio file not found: ' || d.doc_id END AS error
FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "manifest_missing": """SELECT doc_id, lang FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""",
        "manifest_existing": """SELECT doc_id, lang FROM documents
WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""",
        "missing_embeddings": """SELECT doc_id FROM documents
WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)""",
        "feature_merge": f"""WITH {SIGNAL}
SELECT doc_id, round(duration, 9) AS duration, round(zero_crossing_rate, 9) AS zero_crossing_rate,
  round(rmse, 9) AS rmse, len({words('text')}) AS num_words, length(text) AS text_length
FROM signal JOIN documents USING (doc_id)""",
        "combined_features": f"""WITH RECURSIVE {SIGNAL}, {WAV}, {DOCS}, {cascade_ctes('source')},
compared AS (SELECT id, text, {words('text')} AS before, {words('fixed')} AS after FROM corrected)
SELECT doc_id, round(duration, 9) AS duration, round(zero_crossing_rate, 9) AS zero_crossing_rate,
  round(centroid, 6) AS spectral_centroid, round(rmse, 9) AS rmse,
  round({diff_score('before', 'after')}, 9) AS grammar_score_model, greatest(len(before), 1) AS num_words,
  round(length(regexp_replace(text, '{BLANK}+', '', 'g'))::DOUBLE / greatest(len(before), 1), 9) AS avg_word_len,
  length(text) AS text_length
FROM signal JOIN compared ON id = doc_id JOIN spectrum ON vec_id = doc_id""",
        "masked_token_pool": """WITH cell AS (
  SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings),
marked AS (
  SELECT vec_id, p % 8 AS dim, v, CASE WHEN (vec_id + p // 8 * 8 + 1) % 5 > 1 THEN 1 ELSE 0 END AS mask FROM cell)
SELECT vec_id, dim, round(sum(v * mask) / greatest(sum(mask)::DOUBLE, 1e-9), 9) AS value
FROM marked GROUP BY vec_id, dim""",
        "default_audio": f"""WITH {SIGNAL}
SELECT doc_id, round(coalesce(duration, 0.0), 9) AS duration,
  round(coalesce(zero_crossing_rate, 0.0), 9) AS zero_crossing_rate, 0.0::DOUBLE AS spectral_centroid,
  round(coalesce(rmse, 0.0), 9) AS rmse, 0.0::DOUBLE AS grammar_score_model
FROM documents LEFT JOIN signal USING (doc_id)""",
        "positional_concat": """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id FROM documents),
e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, vec_id, label FROM embeddings)
SELECT row_index, doc_id::DOUBLE AS doc_id, vec_id::DOUBLE AS vec_id, label::DOUBLE AS label
FROM d FULL JOIN e USING (row_index)""",
        "error_policy_keep": f"""WITH {OUTCOMES}
SELECT key, CASE WHEN error IS NULL THEN transcript ELSE 'Error: ' || error END AS transcript,
  CASE WHEN error IS NULL THEN grammar_score ELSE 0.0 END AS grammar_score FROM outcomes""",
        "error_policy_drop": f"""WITH {OUTCOMES}
SELECT key, transcript, grammar_score FROM outcomes WHERE error IS NULL""",
        "error_log": f"WITH {OUTCOMES} SELECT key || ': ' || error AS value FROM outcomes WHERE error IS NOT NULL",
        "progress_counts": f"""WITH {OUTCOMES}
SELECT role, count(*) AS found, count(*) FILTER (error IS NULL) AS processed,
  count(*) FILTER (error IS NOT NULL) AS failed FROM outcomes GROUP BY role""",
        "error_text": f"WITH {OUTCOMES} SELECT key, 'Error: ' || error AS message FROM outcomes",
        "union_outcomes": f"""WITH {OUTCOMES}
SELECT key, transcript, NULL AS error FROM outcomes WHERE error IS NULL
UNION ALL SELECT key, NULL, error FROM outcomes WHERE error IS NOT NULL""",
        "request_response_json": f"""WITH RECURSIVE {response_sql('''asked AS (
  SELECT conv_id || '-' || turn AS key, CASE WHEN role = 'system' THEN '' ELSE text END AS typed,
         NULL::VARCHAR AS heard, NULL::VARCHAR AS lost FROM conversations)''')}
SELECT key, CASE WHEN error IS NULL
  THEN to_json(struct_pack(transcription := transcription, originalText := originalText,
       correctedText := correctedText, grammarScore := grammarScore))::VARCHAR
  ELSE to_json(struct_pack(transcription := transcription, originalText := originalText,
       correctedText := correctedText, grammarScore := grammarScore, error := error))::VARCHAR
  END AS response FROM answer""",
        "json_field": """SELECT event_id, coalesce(props ->> '$.k', '') AS k, coalesce(props ->> '$.text', '') AS text
FROM events""",
        "describe_features": f"WITH {features} {summary}",
        "split_exact": f"""SELECT doc_id, {split_sql(0.15)} AS split_15, {split_sql(0.2)} AS split_20
FROM documents""",
        "split_metrics": f"""WITH {LABELLED}, parts AS (SELECT *, {split_sql(0.2)} AS split FROM labelled)
SELECT split, count(*) AS n_samples, round(avg((actual - predicted) ** 2), 9) AS mse,
  round(avg(abs(actual - predicted)), 9) AS mae,
  round(1 - avg((actual - predicted) ** 2) / var_pop(actual), 9) AS r2 FROM parts GROUP BY split""",
        "metrics_record": f"""WITH {LABELLED},
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM labelled)
SELECT row // 100 AS block_no,
  (SELECT round(avg((actual - predicted) ** 2), 9) FROM labelled) AS mse,
  (SELECT round(avg(abs(actual - predicted)), 9) FROM labelled) AS mae,
  string_agg(round(predicted * 10)::INT::VARCHAR, ' ' ORDER BY row) AS val_predictions,
  (SELECT count(*) FROM labelled) AS n_samples FROM numbered GROUP BY block_no""",
        "ensemble_compare": f"""WITH {LABELLED}
SELECT doc_id, predicted AS first_score, second AS second_score, round(second - predicted, 9) AS difference,
  round((predicted + second) / 2, 9) AS ensemble FROM labelled""",
        "history_latest10": history,
        "stream_history": history,
        "batch_numbers": """SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 8 AS batch_no
FROM events""",
        "signal_global": f"""SELECT vec_id, len(embedding) / 16000.0::DOUBLE AS duration,
  {ZCR} AS zero_crossing_rate, round({RMS}, 9) AS rmse,
  round(list_max([embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE for i in range(1, len(embedding))]), 9)
  AS largest_step FROM embeddings""",
        "frame_features": f"""WITH frame AS (
  SELECT vec_id, embedding[f * {HOP} + 1 : f * {HOP} + {FRAME}] AS part
  FROM embeddings, (SELECT unnest(range(0, {frame_count})) AS f))
SELECT vec_id, round(avg(sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in part]) / {FRAME})), 9) AS rmse
FROM frame GROUP BY vec_id""",
        "mean_pool": """WITH long AS (
  SELECT label, CASE WHEN vec_id % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS mask,
         unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, dim, round(sum(v * mask) / greatest(sum(mask), 1e-9), 9) AS value FROM long GROUP BY label, dim""",
        "hashed_embedding": f"""WITH word AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents),
counted AS (SELECT doc_id, ({token_bucket}) % 64 AS dim, count(*) AS n FROM word GROUP BY ALL),
length AS (SELECT doc_id, sqrt(sum(n::DOUBLE * n)) AS norm FROM counted GROUP BY doc_id)
SELECT d.doc_id, d.dim, round(coalesce(n / norm, 0.0), 9) AS value
FROM (SELECT doc_id, unnest(range(0, 64)) AS dim FROM documents) d
LEFT JOIN counted USING (doc_id, dim) LEFT JOIN length ON length.doc_id = d.doc_id""",
        "wav_roundtrip_features": f"""WITH {WAV}
SELECT vec_id, 16000 AS sr, 64::BIGINT AS n_samples, round(64 / 16000.0::DOUBLE, 6) AS duration,
  round(len([i for i in range(1, 64) if (y[i] < 0) <> (y[i + 1] < 0)]) / 2048.0::DOUBLE, 6) AS zero_crossing_rate,
  round(centroid, 6) AS spectral_centroid,
  round(sqrt(list_sum([v * v for v in y]) / 2048), 6) AS rmse, round(rolloff, 6) AS spectral_rolloff
FROM clip JOIN spectrum USING (vec_id)""",
        "clip_features": f"""WITH {CLIPS}
SELECT clip::VARCHAR AS filename, 16000 AS sr, 1 AS channels, n_samples, round(duration, 9) AS duration,
  round(zero_crossing_rate, 9) AS zero_crossing_rate, round(rmse, 9) AS rmse,
  round(zero_crossing_global, 9) AS zero_crossing_global, round(rms_global, 9) AS rms_global, NULL::VARCHAR AS error
FROM clip""",
        "feature_dataset": clip_rows,
        "training_rows": f"""SELECT filename, CASE WHEN error IS NULL THEN label END AS label,
  CASE WHEN error IS NULL THEN num_words END AS num_words, filename || ': ' || error AS line FROM ({clip_rows})""",
        "validate_clips": f"""WITH {UPLOADS}
SELECT key AS filename, NOT large AND broken IS NULL AS valid,
  CASE WHEN large THEN too_large ELSE 'Invalid or unsupported audio file format: ' || broken END AS reason FROM judged""",
        "upload_stream": f"""WITH RECURSIVE {UPLOADS}, {response_sql(heard, by_model, 'answered')}
SELECT key AS filename, transcription, originalText, correctedText, grammarScore, error FROM answer""",
        "resumed_features": f"WITH {features} SELECT doc_id, num_words, text_length FROM features",
        "directory_job": f"""WITH RECURSIVE source AS (
  SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE length(text) % 11 <> 0),
{cascade_ctes('source', RULES[:1], article)},{REFUSING},{scored_sql('answered')}
SELECT id AS filename, text AS transcript, score AS label FROM scored
UNION ALL SELECT conv_id || '-' || turn, 'Error: cannot make out ' || length(text), 0.0
FROM conversations WHERE length(text) % 11 = 0""",
        "delivered_tables": f"""WITH RECURSIVE source AS (
  SELECT doc_id AS id, ' "' || text || '",' || chr(10) || ' ' AS text FROM documents), {cascade_ctes('source')},{SCORED}
SELECT id::VARCHAR AS filename, length(text) AS transcript_length, length(fixed) AS corrected_length,
  score AS grammar_score, true AS same FROM scored""",
        "feature_file": """SELECT vec_id, unnest(range(0, 64)) AS dim, round(unnest(embedding)::DOUBLE, 9) AS value
FROM embeddings""",
        "saved_scorer": "SELECT doc_id, true AS same, doc_id % 5 > 0 AS scored FROM documents",
        "train_score_gbt": trained,
        "train_score_rf": trained,
        "stacked_score": "SELECT doc_id, true AS in_range, true AS mse_below_variance FROM documents",
        "full_contract": f"""WITH bag AS (
  SELECT doc_id, sum(n::DOUBLE * n) > 0 AS filled FROM (
    SELECT doc_id, ({token_bucket}) % 384 AS dim, count(*) AS n
    FROM (SELECT doc_id, unnest({words('text')}) AS w FROM documents) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, true AS in_range, true AS mse_below_variance, true AS mean_of_both, num_words, num_errors,
  round(num_errors::DOUBLE / greatest(num_words, 1), 9) AS grammar_ratio, 384 AS size,
  CASE WHEN filled THEN 1.0 ELSE 0.0 END::DOUBLE AS square_sum
FROM (SELECT doc_id, {errors} AS num_errors, len({words('text')}) AS num_words FROM documents) LEFT JOIN bag USING (doc_id)""",
        "text_source_choice": """SELECT conv_id || '-' || turn AS key,
  CASE WHEN role = 'user' THEN text WHEN role <> 'system' THEN 'heard ' || text ELSE '' END AS text_first,
  CASE WHEN role <> 'system' THEN 'heard ' || text ELSE '' END AS audio_first FROM conversations""",
        "nonblank_texts": f"""SELECT doc_id, length(text) AS text_length FROM (
  SELECT doc_id, CASE WHEN n_chars % 9 <> 0 THEN
    CASE WHEN n_chars % 4 = 0 THEN regexp_replace(text, '[^ \\n]', '', 'g') ELSE text END END AS text
  FROM documents) WHERE text IS NOT NULL AND {strip('text')} <> ''""",
        "head_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5",
        "clean_names": f"""SELECT page_id, regexp_extract({strip("url || ' '")}, '[^/]*$') AS base_name,
  regexp_replace(regexp_replace(
    list_aggregate({words("replace(replace(url, '/', ' '), chr(92), ' ')")}, 'string_agg', '_'),
    '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS safe_name FROM pages""",
        "display_score": """SELECT doc_id, round((n_chars % 501)::DOUBLE / 100, 1) AS shown,
  round((n_chars % 501)::DOUBLE / 100 / 5 * 100, 6) AS percent,
  least(greatest((n_chars % 501)::DOUBLE / 100 * 2 - 2, 0.0), 5.0) AS clamped FROM documents""",
        "cast_labels": """SELECT doc_id,
  try_cast(CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE quality::VARCHAR END AS DOUBLE) AS label FROM labels""",
        "date_text": """SELECT event_id, epoch_us(ts) // 1000 AS item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date
FROM events""",
        "model_apply_errors": """SELECT conv_id || '-' || turn AS key,
  CASE WHEN length(text) % 10 > 1 THEN '<' || text || '>' END AS corrected_text,
  CASE length(text) % 10 WHEN 0 THEN 'refused ' || length(text) WHEN 1 THEN 'out of memory' END AS error
FROM conversations""",
        "batch_job": f"""WITH RECURSIVE source AS (SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id)),
{cascade_ctes('source')},{SCORED}
SELECT doc_id AS filename, coalesce(s.text, 'Error: Audio file not found: ' || doc_id) AS transcript,
  coalesce(score, 0.0) AS grammar_score, coalesce(fixed, 'Error: Audio file not found: ' || doc_id) AS corrected_text
FROM documents LEFT JOIN scored s ON s.id = doc_id""",
        "request_job": f"""WITH RECURSIVE {response_sql(requests)}
SELECT key, transcription, originalText, correctedText, grammarScore, error FROM answer""",
        "request_job_predictor": f"""WITH RECURSIVE {response_sql(requests, by_model, 'answered')}
SELECT key, transcription, originalText, correctedText, grammarScore, error FROM answer""",
        "batch_job_predictor": f"""WITH RECURSIVE source AS (SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id)),
{cascade_ctes('source', RULES[:1], article)},{REFUSING},{scored_sql('answered')}
SELECT doc_id::VARCHAR AS filename, coalesce(s.text, 'Error: Audio file not found: ' || doc_id) AS transcript,
  coalesce(score, 0.0) AS grammar_score, coalesce(fixed, 'Error: Audio file not found: ' || doc_id) AS corrected_text
FROM documents LEFT JOIN scored s ON s.id = doc_id""",
        "stream_score": f"""WITH RECURSIVE {conversation_text}, {cascade_ctes('source')},{SCORED}
SELECT id AS key, text AS originalText, fixed AS correctedText, score AS grammarScore FROM scored""",
    }
