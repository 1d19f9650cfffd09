"""The core operators on NULLs in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from affinis.operators.skew import key_statistics, target_statistics
from affinis.operators.units import common_units, converted_elsewhere

CLASHES = "common_unit common_value key tag value part m n e lead share is_heavy n_rows all_rows __base __pair __mol __um".split()


def hard(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def test_units(spark):
    rows = [(1, "IC50", 2.0, "uM", None, 300.0), (1, "IC50", 2.0, "uM", None, 300.0), (2, None, 1.0, "uM", "x", 1.0), (3, "IC50", None, "uM", None, 1.0), (4, "IC50", float("nan"), "uM", "", None)]
    rows += [(5, "IC50", 1.0, None, None, None), (6, "", 1.0, "", "", 0.0), (7, "IC50", 1.0, "u" * 50_000, "c" * 50_000, 1.0), (8, "IC50", float("inf"), "M", None, 1.0), (None,) * 6, (9, "IC50", 1.0, "ug/mL", None, None)]
    df = hard(spark.createDataFrame(rows, "activity_id bigint, standard_type string, standard_value double, standard_units string, activity_comment string, full_mwt double"))
    out = common_units(df)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows)
    told = out.filter("common_unit IS NOT NULL").select("activity_id", "common_unit", "common_value").collect()
    assert [tuple(r) for r in told] == [(1, "pM", 2_000_000)] * 2
    assert converted_elsewhere(df).count() == 2
    assert common_units(df.limit(0)).count() == 0


def test_statistics(spark):
    rows = [("CHEMBL1", "CHEMBL5_CHEMBL1", "CHEMBL5", 1.0)] * 40 + [("CHEMBL1", None, None, None), ("CHEMBL1", "", "", float("nan")), ("", "a_b", "m", 1.0), (None, "a_b", "m", 1.0), ("CHEMBL2", "x" * 50_000, "y" * 50_000, float("inf")), ("t" * 50_000, None, None, None)]
    df = hard(spark.createDataFrame(rows, "target_chembl_id string, pair_id string, mol_chembl_id string, activity_um double"))
    got = {r["target_chembl_id"]: r for r in target_statistics(df).collect()}
    assert set(got) == {"CHEMBL1", "", "CHEMBL2", "t" * 50_000}
    hot = got["CHEMBL1"]
    assert (hot["n_rows"], hot["n_pairs"], hot["n_molecules"], hot["n_measured"], hot["is_heavy"]) == (42, 1, 1, 40, True)
    assert target_statistics(df.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_one_key(spark, partitions):
    """All rows on one key, in ties: the borders cut through it and nothing counts twice."""
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") % 700).cast("string").alias("v"), F.lit(2.0).alias("x"))
    r = key_statistics(df, "k", {"n_v": "v"}, "x", partitions=partitions).collect()
    assert [(x["key"], x["n_rows"], x["n_v"], x["sum_measured"]) for x in r] == [("k", 5000, 700, 10_000.0)]
