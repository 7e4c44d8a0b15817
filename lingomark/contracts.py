"""Named feature contracts: the ordered numeric columns a scoring model is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names and their order per contract.
AUDIO_COLUMNS = ("duration", "zero_crossing_rate", "spectral_centroid", "rmse")
TEXT_COLUMNS = ("num_words", "avg_word_len", "text_length")
CONTRACTS: dict[str, tuple[str, ...]] = {
    "basic3": TEXT_COLUMNS,
    "hybrid7": AUDIO_COLUMNS + TEXT_COLUMNS,
    "scorer8": AUDIO_COLUMNS + ("grammar_score_model",) + TEXT_COLUMNS,
}
FULL_HEAD = (
    "num_words",
    "num_errors",
    "grammar_ratio",
    "avg_word_len",
    "text_length",
    "duration",
    "zero_crossing_rate",
    "spectral_centroid",
    "rmse",
    "grammar_score_model",
)
EMBEDDING_PREFIX = "emb_"
EMBEDDING_SIZE = 384


def embedding_columns(size: int = EMBEDDING_SIZE) -> tuple[str, ...]:
    return tuple(f"{EMBEDDING_PREFIX}{i}" for i in range(size))


def contract_columns(name: str, embedding_size: int = EMBEDDING_SIZE) -> tuple[str, ...]:
    """Ordered columns of a contract; ``emb384`` and ``full`` depend on the embedding size."""
    if name == "emb384":
        return embedding_columns(embedding_size)
    if name == "full":
        return FULL_HEAD + embedding_columns(embedding_size)
    if name not in CONTRACTS:
        raise KeyError(f"Unknown feature contract: {name}")
    return CONTRACTS[name]


def scalar_columns(name: str) -> tuple[str, ...]:
    """Columns of a contract besides its embedding, where that is kept as one array."""
    heads = {"emb384": (), "full": FULL_HEAD}
    if name not in heads:
        raise KeyError(f"Feature contract without an embedding: {name}")
    return heads[name]


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job starts when a column is absent, naming every absent column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def select_contract(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to ``keep`` and then the contract columns in the contract's order."""
    require_columns(df, [*keep, *columns])
    return df.select(*keep, *columns)


def prefixed_columns(df: DataFrame, prefix: str = EMBEDDING_PREFIX) -> list[str]:
    """All columns that start with ``prefix``, in table order; fails if there is none."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"No columns with prefix {prefix!r} found")
    return found


def widen(df: DataFrame, vector: str, size: int, prefix: str = EMBEDDING_PREFIX) -> DataFrame:
    """Replace an array column by ``size`` scalar columns, for wide exports."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.get(F.col(vector), i).alias(f"{prefix}{i}") for i in range(size)])


def narrow(df: DataFrame, vector: str, prefix: str = EMBEDDING_PREFIX) -> DataFrame:
    """Inverse of :func:`widen`."""
    wide = prefixed_columns(df, prefix)
    rest = [c for c in df.columns if c not in set(wide)]
    return df.select(*rest, F.array(*[F.col(c) for c in wide]).alias(vector))


def schema_listing(df: DataFrame) -> DataFrame:
    """Columns of a table as a table: position, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")
