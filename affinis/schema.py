"""Declared schemas and the checks of required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published columns of BLAST tabular output (outfmt 6), which has no header.
BLAST_HITS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("qseqid", "sseqid")]
    + [T.StructField("pident", T.DoubleType())]
    + [T.StructField(n, T.IntegerType()) for n in ("length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send")]
    + [T.StructField(n, T.DoubleType()) for n in ("evalue", "bitscore")]
)


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], context: str) -> DataFrame:
    """The same frame, or ValueError naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")
    return df


def keep_present(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column."""
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    return df.select(*(F.nanvl(c, F.lit(None).cast(dict(df.dtypes)[c])).alias(c) if c in floats else F.col(c) for c in df.columns))
