"""Measured quantities recorded in different units, brought to one unit per kind of quantity."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.unit_parse import MASS, TIME, parse_unit

ENDPOINT = r"(?:ic50|ec50|ac50|ki|kd|potency)"
# The same test twice: Spark drops other rows before Python sees them.
CONCENTRATION_TYPE = rf"(?i)(^|[^a-z])p?{ENDPOINT}([^a-z]|$)"
TIME_TYPE = r"(?i)^\s*(t\s*1/2|t½|half[\s\-_]*life)"
_TYPE = re.compile(rf"^\s*(?P<log>-?\s*log(?:10)?\s*[(\s]*|p(?={ENDPOINT}))?\s*(?P<name>{ENDPOINT})(?![a-z])(?P<rest>.*)$", re.I)
_TIME = re.compile(TIME_TYPE + r"(?P<rest>.*)$")
_NO_UNIT = {"", "unknown", "n/a", "na", "none", "null", "?", "-"}
_LOG_UNIT = {"", "log", "-", "unitless", "log m", "log10 m", "log(m)", "log10(m)", "none", "n/a"}
_NUMBER = re.compile(r"(?<![A-Za-z\d.^'\-])(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s*[x×*·]\s*10\s*\^?\s*([-−+]?\d+))?\s*\(?\s*((?:10\s*\^?'?\s*-\d+\s*)?[A-Za-zµμ][^\s,;()]*(?:\s[lL]-1)?)")
_STATED = re.compile(r"(?:\b(?:in|as|units?)\b\s*[:=]?|:)\s*((?:10\s*\^?'?\s*-\d+\s*)?[A-Za-zµμ][^\s,;()]*(?:\s[lL]-1)?)")
_OTHER = re.compile(r"(?:\b(?:at|to|dose|with|from|conc(?:entration)?)\.?|[@<>])\s*$", re.I)
_SAID = re.compile(rf"(?:(?<![a-z]){ENDPOINT}(?![a-z])|\bresult|\bmeasured|\bvalue|half[\s-]*life|t\s*1/2)", re.I)


@lru_cache(maxsize=65536)
def _kind(kind: str) -> tuple[str, int, str] | None:
    """(field, sign of the logarithm or 0, unit named in the type) of a standard_type."""
    if m := _TYPE.match(kind):
        log = (m["log"] or "").strip().lower()
        sign = 0 if not log else -1 if log[0] in "-p" else 1
        unit = re.sub(r"^[\s,_(\[/)]*(?:in\s+)?", "", m["rest"]).strip(" )]_")
        return "concentration", sign, unit
    if m := _TIME.match(kind):
        return "time", 0, re.sub(r"^[\s,_(\[)]*(?:in\s+)?", "", m["rest"]).strip(" )]_")
    return None


@lru_cache(maxsize=65536)
def _comment(text: str, field: str):
    """(unit stated for the row's own value, (number, unit) of a result written in the text)."""
    result = stated = None
    for clause in re.split(r";|,\s", text):
        for m in _NUMBER.finditer(clause):
            before = clause[: m.start()]
            unit = parse_unit(m[3], field)
            if result is None and unit and not _OTHER.search(before) and _SAID.search(before):
                result = (float(m[1]) * 10.0 ** int((m[2] or "0").replace("−", "-")), unit)
        for m in _STATED.finditer(clause):
            stated = stated or parse_unit(m[1], field)
    return stated, result


def _common(kind, value, units, comment, weight) -> float | None:
    """The value in mol/L or seconds, or None where the row does not tell it."""
    known = _kind(kind)
    if known is None:
        return None
    field, log, named = known
    own = (units or "").strip()
    given = value is not None and math.isfinite(value)
    if log:
        if not given or own.lower() not in _LOG_UNIT or abs(value) > 30:
            return None
        return 10.0 ** (value if log > 0 else -value)
    unit = None
    if own.lower() not in _NO_UNIT:
        unit = parse_unit(own, field)
        if unit is None:
            return None
    elif named:
        unit = parse_unit(named, field)
    if given:
        if unit is None and comment:
            unit = _comment(comment, field)[0]
        if unit is None or value <= 0:
            return None
    else:
        result = _comment(comment, field)[1] if comment else None
        if result is None or result[0] <= 0:
            return None
        value, unit = result
    if unit.dimension == MASS:
        if weight is None or not math.isfinite(weight) or weight <= 0:
            return None
        return value * unit.factor / weight
    return value * unit.factor if field != "time" or unit.dimension == TIME else None


def _rounded(kind, value, units, comment, weight) -> int | None:
    """The value in pM or s as the nearest whole number; None beyond the range of a long."""
    base = _common(kind, value, units, comment, weight)
    if base is None:
        return None
    scaled = math.floor(min(base * (1.0 if _kind(kind)[0] == "time" else 1e12), 1e19) + 0.5)
    return scaled if scaled < 9_000_000_000_000_000_000 else None


@F.pandas_udf(T.LongType())
def _to_common(kind: pd.Series, value: pd.Series, units: pd.Series, comment: pd.Series, weight: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or x != x else x
    return pd.Series(
        [_rounded(k, none(v), none(u), none(c), none(w)) if k is not None else None for k, v, u, c, w in zip(kind, value, units, comment, weight)],
        dtype="Int64",
    )


def common_units(
    df: DataFrame,
    kind: str = "standard_type",
    value: str = "standard_value",
    units: str = "standard_units",
    comment: str = "activity_comment",
    weight: str = "full_mwt",
    unit_column: str = "common_unit",
    value_column: str = "common_value",
) -> DataFrame:
    """Adds the common unit (``pM`` or ``s``) and the value in it, rounded to the nearest whole number.

    Rows keep their other columns; both new columns are NULL where the row does not tell the value: another kind of
    measurement, NULL, NaN, zero or negative value, unusable or missing unit, mass units without a molecular weight.
    A unit comes from the unit column, else the type (``Ki [uM]``), else a comment about the value; a missing value
    comes from a comment that states the result.  Columns of the new names are replaced.  No shuffle; an empty table
    gives an empty table.
    """
    is_time = F.col(kind).rlike(TIME_TYPE)
    mine = is_time | F.col(kind).rlike(CONCENTRATION_TYPE)
    # rows of another kind go to Python as NULLs, which cost next to nothing; so the table is read once
    told = lambda c: F.when(mine, F.col(c).cast("double") if c in (value, weight) else F.col(c))
    # said to be nondeterministic, so that a filter on the result reads it instead of having it computed a second time
    told_value = _to_common.asNondeterministic()(*map(told, (kind, value, units, comment, weight)))
    return df.withColumn(value_column, told_value).withColumn(unit_column, F.when(F.col(value_column).isNotNull(), F.when(is_time, "s").otherwise("pM")))


def converted_elsewhere(df: DataFrame) -> DataFrame:
    """Rows of ``activities`` whose unit is not already the usual one (``nM``, for half-lives ``hr``) and whose value is told."""
    usual = F.when(F.col("standard_type").rlike(TIME_TYPE), "hr").otherwise("nM")
    odd = df.filter(~F.col("standard_units").eqNullSafe(usual)).filter(F.col("standard_type").rlike(CONCENTRATION_TYPE) | F.col("standard_type").rlike(TIME_TYPE))
    return common_units(odd).filter(F.col("common_unit").isNotNull()).select("activity_id", "common_unit", "common_value")
