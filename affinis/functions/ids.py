"""Column expressions that bring loosely spelled identifiers into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def molecule_key(c: Column) -> Column:
    """``CHEMBL`` plus digits without leading zeros, whatever the case, blanks or separators between and around them.

    Ids of another make are only trimmed and upper-cased.  NULL and blank ids give NULL.
    """
    t = F.regexp_replace(F.upper(F.regexp_replace(c, r"[\s:_\-]+", "")), "^CHEMBL0+([0-9])", "CHEMBL$1")
    return F.when(t.rlike(r"^[A-Z0-9]+$"), t).otherwise(F.nullif(F.trim(F.upper(c)), F.lit("")))


def pair_key(c: Column) -> Column:
    """``MOLECULE_TARGET`` of a pair id with any separator, case and surrounding blanks.

    An id that is not two ``CHEMBL`` numbers is trimmed and upper-cased; NULL and blank ids give NULL.
    """
    t = F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    two = F.regexp_replace(t, r"^(CHEMBL)[ :_\-]?([0-9]+)[^A-Z0-9]+(CHEMBL)[ :_\-]?([0-9]+)$", "$1$2_$3$4")
    return F.nullif(two, F.lit(""))


def target_of_pair(pair: Column) -> Column:
    """The target half of a normalised pair key; NULL when there is none."""
    return F.nullif(F.substring_index(pair, "_", -1), pair)
