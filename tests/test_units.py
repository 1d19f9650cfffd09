import math

import pytest

from affinis.functions.unit_parse import MASS, MOLAR, parse_unit
from affinis.operators.units import common_units

SCHEMA = "activity_id long, standard_type string, standard_value double, standard_units string, activity_comment string, full_mwt double, common_unit string, base string"


@pytest.mark.parametrize(
    "text, dimension, factor",
    [("nM", MOLAR, 1e-9), ("NM", MOLAR, 1e-9), ("um", MOLAR, 1e-6), ("PM", MOLAR, 1e-12), ("10^-6 M", MOLAR, 1e-6), ("10'-9 mol/L", MOLAR, 1e-9), ("umol.L-1", MOLAR, 1e-6), ("µg/ml", MASS, 1e-3), ("mg l-1", MASS, 1e-3), ("ng.mL-1", MASS, 1e-6), ("M", MOLAR, 1.0)],
)
def test_parse(text, dimension, factor):
    unit = parse_unit(text, "concentration")
    assert unit.dimension == dimension and math.isclose(unit.factor, factor)


@pytest.mark.parametrize("text", ["", "%", "AU", "mg/kg", "ug", "unknown", "log M", "1e", "nM nM", "x" * 500])
def test_no_unit(text):
    assert parse_unit(text, "concentration") is None


def test_common_units(spark):
    rows = [
        (1, "IC50", 15.6, "10^-6 M", None, None), (2, "Ki [uM]", 2.0, None, None, None), (3, "pIC50", 6.0, "-", None, None), (4, "log10 Kd [M]", -9.0, "log M", None, None),
        (5, "t1/2", 2.0, "h", None, None), (6, "EC50", 5.0, "mg/L", None, 500.0), (7, "EC50", 5.0, "mg/L", None, None), (8, "Ki", None, None, "tested up to 25 uM; Ki 1.5 nM", None),
        (9, "Ki", 4.0, None, "unit missing in the report; dose 10 uM", None), (10, "Ki", 4.0, "", "values in µM", None), (11, "Inhibition", 4.0, "%", "at 1 uM", None), (12, "Kd", -1.0, "nM", None, None),
        (13, "Kd", float("nan"), None, "Kd: 3.2 x 10^-5mM", None), (14, None, 1.0, "nM", None, None), (15, "Kd", 0.0, "nM", None, None), (16, "IC50", None, None, "not active at 50 uM", None), (17, "t1/2", 400.0, "days", None, None),
    ]
    df = spark.createDataFrame([(*r, "old", "x") for r in rows], SCHEMA)
    got = {r["activity_id"]: (r["common_unit"], r["common_value"]) for r in common_units(df).collect()}
    assert len(got) == len(rows)
    told = {1: ("pM", 15_600_000), 2: ("pM", 2_000_000), 3: ("pM", 1_000_000), 4: ("pM", 1000), 5: ("s", 7200), 6: ("pM", 10_000_000), 8: ("pM", 1500), 10: ("pM", 4_000_000), 13: ("pM", 32_000), 17: ("s", 34_560_000)}
    for k, v in got.items():
        assert v == told.get(k, (None, None)), k


def test_empty(spark):
    assert common_units(spark.createDataFrame([], SCHEMA)).count() == 0
