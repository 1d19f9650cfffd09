"""Bins, labels and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the size bins by heavy atoms.
SIZE_BINS = ((15, "01_15"), (20, "16_20"), (25, "21_25"), (30, "26_30"), (35, "31_35"), (40, "36_40"))
LAST_SIZE_BIN = "41_plus"
# Factors to micromolar by unit as written, lower case; other units have no factor.
TO_MICROMOLAR = (
    (("nm", "nanomolar"), 1e-3),
    (("um", "µm", "μm", "micromolar"), 1.0),
    (("pm", "picomolar"), 1e-6),
    (("mm", "millimolar"), 1e3),
)
# Fixed values of the wider unit set.
TO_MICROMOLAR_WIDE = (*TO_MICROMOLAR, (("m", "molar"), 1e6), (("fm", "femtomolar"), 1e-9))
# Similarity thresholds (2D, 3D) by preset.
THRESHOLDS = {"none": (0.0, 0.0), "stp2014": (0.30, 0.65), "stp2019": (0.65, 0.85)}


def micromolar(value: Column, unit: Column, units=TO_MICROMOLAR) -> Column:
    """The value in micromolar, or NULL for an unknown or missing unit; NaN counts as missing."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    u = F.lower(F.trim(unit))
    out = F.lit(None).cast("double")
    for names, factor in units:
        out = F.when(u.isin(*names), v * F.lit(factor)).otherwise(out)
    return out


def activity_label(um: Column, active_below: float = 10.0, inactive_from: float = 500.0) -> Column:
    """Active below the first bound, Inactive from the second, Ambiguous between and where nothing is known."""
    return F.when(um < active_below, "Active").when(um >= inactive_from, "Inactive").otherwise("Ambiguous")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ha_bin(heavy_atoms: Column) -> Column:
    return clamp(heavy_atoms, 10, 60)


def size_bin(heavy_atoms: Column) -> Column:
    """The size bin; NULL falls into the last one."""
    out = F.lit(LAST_SIZE_BIN)
    for bound, label in reversed(SIZE_BINS):
        out = F.when(heavy_atoms <= bound, label).otherwise(out)
    return out


def threshold_normalised(similarity: Column, threshold: float) -> Column:
    """(s - t) / (1 - t), held within 0..1."""
    return clamp((similarity - F.lit(threshold)) / F.lit(1.0 - threshold), 0.0, 1.0)


def number(text: Column, fill: float | None = None) -> Column:
    """A text as a number; what is none, NaN and NULL become ``fill``."""
    v = F.nanvl(F.trim(text.cast("string")).try_cast("double"), F.lit(None).cast("double"))
    return v if fill is None else F.coalesce(v, F.lit(fill))


def or_sentinel(size: Column, sentinel: int = 9999) -> Column:
    """A size, or a number above every limit where it is unknown or no number."""
    return F.coalesce(size.try_cast("int"), F.lit(sentinel))


def md5_order(*columns: Column, seed: str = "42") -> Column:
    """A key whose order is a fixed shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(c.cast("string") for c in columns)))
