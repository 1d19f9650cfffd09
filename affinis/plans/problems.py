"""Queries of the general data problems, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.skew import target_statistics
from affinis.operators.units import common_units, converted_elsewhere


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_elsewhere(table(spark, sf_dir, "activities"))


def p3_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each unit as written could be converted, and to what."""
    d = common_units(table(spark, sf_dir, "activities"))
    return d.groupBy(F.trim("standard_units").alias("written_unit"), "common_unit").agg(F.count(F.lit(1)).alias("n_rows"), F.min("common_value").alias("least"), F.max("common_value").alias("most"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_statistics(table(spark, sf_dir, "final_training_meta")).filter("is_heavy").select("target_chembl_id")


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = target_statistics(table(spark, sf_dir, "final_training_meta"))
    return d.select("target_chembl_id", "n_rows", "n_pairs", "n_molecules", "n_measured", F.round("sum_measured", 3).alias("sum_um"), F.col("min_measured").alias("min_um"), F.col("max_measured").alias("max_um"), "is_heavy")


QUERIES = {"p3_found": p3_found, "p3_by_type": p3_by_type, "p4_found": p4_found, "p4_targets": p4_targets}

PAIR_SQL = r"nullif(regexp_replace(upper(trim(regexp_replace(pair_id, '\s+', ' ', 'g'))), '^(CHEMBL)[ :_\-]?([0-9]+)[^A-Z0-9]+(CHEMBL)[ :_\-]?([0-9]+)$', '\1\2_\3\4'), '')"
MOLECULE_SQL = r"regexp_replace(upper(regexp_replace(mol_chembl_id, '[\s:_\-]+', '', 'g')), '^CHEMBL0+([0-9])', 'CHEMBL\1')"

_UNIT_FACTORS = {
    1e-9: "nm nmol/l nmoll-1 nanomolar 10'-9mol/l", 1e-6: "um umol/l umoll-1 micromolar 10^-6m", 1e-3: "mm mmol/l mmoll-1 millimolar 10^-3m",
    1e-12: "pm pmol/l pmoll-1 picomolar 10^-12m", 1e-15: "fm fmol/l femtomolar", 1.0: "m mol/l moll-1 molar",
}
_MASS_FACTORS = {1e-3: "mg/l mgl-1 ug/ml ugml-1 microg/ml", 1e-6: "ng/ml ngml-1 ug/l", 1.0: "g/l mg/ml mgml-1"}
_TIME_FACTORS = {1: "s sec seconds", 60: "min mins minutes", 3600: "h hr hrs hour hours", 86400: "d day days"}


def _factor_sql(factors: dict) -> str:
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())
    return "CASE " + " ".join(f"WHEN k IN ({quoted(words)}) THEN {f!r}::DOUBLE" for f, words in factors.items()) + " END"


ORACLE = {
    "p3_found": rf"""
WITH a AS (SELECT activity_id, lower(trim(standard_type, ' ')) AS t, standard_type AS ty, CASE WHEN isnan(standard_value) THEN NULL ELSE standard_value END AS v,
    coalesce(standard_units, '') AS raw, trim(coalesce(standard_units, ''), ' ') AS u, coalesce(activity_comment, '') AS c, full_mwt AS mw FROM activities),
b AS (SELECT *, regexp_matches(t, '^(t1/2|half[ -]?life)') AS is_time, regexp_matches(t, '(^|[^a-z])p?(ic50|ec50|ac50|ki|kd|potency)([^a-z]|$)') AS is_conc,
    CASE WHEN t LIKE '-log%' OR regexp_matches(t, '^p(ic50|ec50|ac50|ki|kd|potency)$') THEN -1 WHEN t LIKE 'log%' THEN 1 ELSE 0 END AS lg,
    regexp_extract(c, '(?:IC50|EC50|AC50|Ki|Kd|Potency|result)(?: of|:| =|=)? ?([0-9.]+(?:[eE][-+]?[0-9]+)?)(?: x 10\^([-0-9]+))? ?\(?([^,)]+?)\)?(?:,.*)?$', ['n', 'e', 'u']) AS r FROM a),
d AS (SELECT *, CASE WHEN lg <> 0 THEN NULL WHEN v IS NOT NULL THEN v WHEN r.n <> '' THEN try_cast(r.n AS DOUBLE) * pow(10.0::DOUBLE, coalesce(try_cast(r.e AS INTEGER), 0)) END AS x,
    CASE WHEN u NOT IN ('', 'unknown', 'n/a') THEN u WHEN v IS NULL THEN r.u
      WHEN regexp_matches(ty, '(IC50|EC50|AC50|Ki|Kd|Potency).*[A-Za-z]') THEN regexp_extract(ty, '(?:IC50|EC50|AC50|Ki|Kd|Potency)[ _,]*(?:in )?[\[(]?([^\])]+)', 1)
      ELSE regexp_extract(c, '(?:values in|unit:|all results given as|reported in) (.+?)(?: by the laboratory)?$', 1) END AS unit FROM b WHERE is_time OR is_conc),
e AS (SELECT *, replace(replace(lower(regexp_replace(unit, '[ .()]', '', 'g')), 'µ', 'u'), 'μ', 'u') AS k FROM d),
f AS (SELECT *, CASE WHEN is_time THEN x * {_factor_sql(_TIME_FACTORS)}
    WHEN lg <> 0 THEN CASE WHEN lower(u) IN ('', 'log', '-', 'unitless', 'log m') THEN pow(10.0::DOUBLE, lg * v) * 1e12::DOUBLE END
    ELSE coalesce(x * {_factor_sql(_UNIT_FACTORS)}, x * {_factor_sql(_MASS_FACTORS)} / mw) * 1e12::DOUBLE END AS y FROM e)
SELECT activity_id, CASE WHEN is_time THEN 's' ELSE 'pM' END AS common_unit, floor(y + 0.5::DOUBLE)::BIGINT AS common_value FROM f
WHERE y > 0 AND raw <> CASE WHEN is_time THEN 'hr' ELSE 'nM' END""",
    "p4_found": """
SELECT target_chembl_id FROM final_training_meta WHERE target_chembl_id IS NOT NULL GROUP BY 1
HAVING count(*) >= 0.02 * (SELECT count(target_chembl_id) FROM final_training_meta)""",
    "p4_targets": f"""
WITH b AS (
  SELECT target_chembl_id, {PAIR_SQL} AS p, {MOLECULE_SQL} AS m, CASE WHEN isnan(activity_um) THEN NULL ELSE activity_um END AS a
  FROM final_training_meta WHERE target_chembl_id IS NOT NULL)
SELECT target_chembl_id, count(*) AS n_rows, count(DISTINCT p) AS n_pairs, count(DISTINCT m) AS n_molecules, count(a) AS n_measured,
  round(sum(a), 3) AS sum_um, min(a) AS min_um, max(a) AS max_um,
  count(*) >= 0.02 * (SELECT count(*) FROM b) AS is_heavy
FROM b GROUP BY 1""",
}
