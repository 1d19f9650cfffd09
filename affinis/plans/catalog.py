"""Registered queries of the reference's operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import bins
from affinis.functions.descriptors import shape_descriptor
from affinis.functions.ids import molecule_key, pair_key
from affinis.functions.similarity import pack_signs, popcount
from affinis.operators import calibrate, curate, evaluate, models, pairs
from affinis.operators.similarity import Params, keep_rule, loo_scores, similarity_candidates, summary_features, topk_features
from affinis.plans.problems import MOLECULE_SQL, PAIR_SQL, table
from affinis.session import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _r(c: str, n: int = 6) -> Column:
    return F.round(c, n).alias(c)


# ------------------------------------------------------------------------------------------------ curation

_ACT_SQL = f"""
act AS (SELECT activity_id, molregno, {MOLECULE_SQL} AS mol, target_chembl_id, organism, standard_type, publication_year,
  CASE WHEN isnan(standard_value) THEN NULL
    WHEN lower(trim(standard_units, ' ')) IN ('nm', 'nanomolar') THEN standard_value * 1e-3
    WHEN lower(trim(standard_units, ' ')) IN ('um', 'µm', 'μm', 'micromolar') THEN standard_value * 1.0::DOUBLE
    WHEN lower(trim(standard_units, ' ')) IN ('pm', 'picomolar') THEN standard_value * 1e-6
    WHEN lower(trim(standard_units, ' ')) IN ('mm', 'millimolar') THEN standard_value * 1e3 END AS um
  FROM activities),
lab AS (SELECT *, CASE WHEN um < 10 THEN 'Active' WHEN um >= 500 THEN 'Inactive' ELSE 'Ambiguous' END AS label FROM act)"""


def _activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "activities").select("activity_id", "molregno", molecule_key(F.col("mol_chembl_id")).alias("mol"), "target_chembl_id", "organism", "standard_type", "standard_value", "standard_units", "publication_year")
    return curate.with_activity(a)


@query(f"WITH {_ACT_SQL} SELECT activity_id, round(um, 9) AS um FROM act WHERE um IS NOT NULL")
def unit_normalise(spark, sf_dir):
    return _activities(spark, sf_dir).filter("activity_um IS NOT NULL").select("activity_id", F.round("activity_um", 9).alias("um"))


@query(f"WITH {_ACT_SQL} SELECT standard_type, label, count(*) AS n FROM lab GROUP BY 1, 2")
def label_cut(spark, sf_dir):
    return _activities(spark, sf_dir).groupBy("standard_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ACT_SQL}, c AS (SELECT *, min(label) OVER w AS lo, max(label) OVER w AS hi FROM lab WHERE label <> 'Ambiguous' WINDOW w AS (PARTITION BY mol, target_chembl_id))
SELECT activity_id, mol, target_chembl_id, label FROM c WHERE lo = hi""")
def conflict_filter(spark, sf_dir):
    return curate.without_conflicts(_activities(spark, sf_dir), ["mol", "target_chembl_id"]).select("activity_id", "mol", "target_chembl_id", "label")


_CURATED_SQL = f"""{_ACT_SQL}, c AS (SELECT *, min(label) OVER w AS lo, max(label) OVER w AS hi FROM lab WHERE label <> 'Ambiguous' WINDOW w AS (PARTITION BY mol, target_chembl_id)),
cur AS (SELECT * EXCLUDE (rn, lo, hi) FROM (SELECT *, row_number() OVER (PARTITION BY mol, target_chembl_id ORDER BY activity_id) AS rn FROM c
  WHERE lo = hi AND mol IS NOT NULL AND target_chembl_id IS NOT NULL) WHERE rn = 1)"""


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = curate.without_conflicts(_activities(spark, sf_dir), ["mol", "target_chembl_id"]).na.drop(subset=["mol", "target_chembl_id"])
    return curate.keep_first(d, ["mol", "target_chembl_id"], F.col("activity_id"))


@query(f"WITH {_CURATED_SQL} SELECT activity_id, mol, target_chembl_id, label, round(um, 9) AS um FROM cur")
def dedup_keep_first(spark, sf_dir):
    return _curated(spark, sf_dir).select("activity_id", "mol", "target_chembl_id", "label", F.round("activity_um", 9).alias("um"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber, p_brand, s_name, n_name, r_name, c_mktsegment FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderpriority IS NOT NULL""")
def star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    d = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    d = d.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    d = d.join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    d = d.filter(F.col("r_name").isin("ASIA", "EUROPE") & F.col("o_orderpriority").isNotNull())
    return d.select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name", "r_name", "c_mktsegment").distinct()


_HUMAN = "lower(trim({0}, ' ')) IN ('human', 'homo sapiens', 'h. sapiens')"


def _human(c: str) -> Column:
    return F.lower(F.trim(c)).isin("human", "homo sapiens", "h. sapiens")


@query(f"""SELECT size_bin, count(*) AS n_rows, count(DISTINCT compound_id) AS n_compounds, count(DISTINCT target_id) AS n_targets FROM p4_0_generate_cv_predictions
WHERE target_id IN (SELECT target_id FROM target_table WHERE {_HUMAN.format('species')}) AND compound_id IN (SELECT compound_id FROM compound_table) GROUP BY 1""")
def semi_chain(spark, sf_dir):
    log = table(spark, sf_dir, "p4_0_generate_cv_predictions")
    human = table(spark, sf_dir, "target_table").filter(_human("species")).select("target_id")
    known = table(spark, sf_dir, "compound_table").select("compound_id")
    d = log.join(human, "target_id", "left_semi").join(known, "compound_id", "left_semi")
    return d.groupBy("size_bin").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("compound_id").alias("n_compounds"), F.count_distinct("target_id").alias("n_targets"))


_FAMILY_SQL = "nullif(regexp_replace(target_name, ' [0-9]+$', ''), '')"
_EDGES_SQL = f"""fam AS (SELECT DISTINCT target_id AS t, {_FAMILY_SQL} AS f FROM target_table WHERE target_name IS NOT NULL),
edges AS (SELECT a.t AS src, b.t AS dst FROM fam a JOIN fam b USING (f) WHERE a.t <> b.t)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.nullif(F.regexp_replace("target_name", " [0-9]+$", ""), F.lit(""))
    return curate.paralog_edges(table(spark, sf_dir, "target_table"), "target_id", family)


@query(f"""WITH {_CURATED_SQL}, {_EDGES_SQL}, blocked AS (SELECT mol, target_chembl_id FROM cur UNION SELECT mol, dst FROM cur JOIN edges ON src = target_chembl_id)
SELECT target_chembl_id, count(*) AS n_blocked FROM blocked GROUP BY 1""")
def paralog_anti(spark, sf_dir):
    blocked = curate.blocked_pairs(_curated(spark, sf_dir), _edges(spark, sf_dir), "mol", "target_chembl_id")
    return blocked.groupBy("target_chembl_id").agg(F.count(F.lit(1)).alias("n_blocked"))


_BUCKET = "(('0x' || substr(md5('42|' || {0}), 1, 8))::BIGINT % {1})"


_NEG_SQL = f"""{_CURATED_SQL}, {_EDGES_SQL}, blocked AS MATERIALIZED (SELECT mol, target_chembl_id FROM cur UNION SELECT mol, dst FROM cur JOIN edges ON src = target_chembl_id),
nb AS (SELECT greatest(1, count(DISTINCT mol) // 12) AS b FROM cur),
pool AS (SELECT DISTINCT mol, {_BUCKET.format('mol', 'b')} AS bucket FROM cur, nb),
pos AS MATERIALIZED (SELECT DISTINCT mol AS pos, target_chembl_id, mol || '_' || target_chembl_id AS pair_id FROM cur WHERE label = 'Active'),
ask AS (SELECT DISTINCT pos.*, {_BUCKET.format("pair_id || '|' || i", 'b')} AS bucket FROM pos, nb, (SELECT unnest([0, 1, 2]) AS i)),
met AS (SELECT pair_id, ask.target_chembl_id, pool.mol FROM ask JOIN pool USING (bucket) ANTI JOIN blocked x ON x.mol = pool.mol AND x.target_chembl_id = ask.target_chembl_id WHERE pool.mol <> pos),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5('42|' || pair_id || '|' || mol), mol)::INTEGER AS rank FROM met),
full10 AS (SELECT pair_id FROM rk WHERE rank = 10),
short AS MATERIALIZED (SELECT pos.* FROM pos ANTI JOIN full10 USING (pair_id)),
allowed AS (SELECT t.target_chembl_id, p.mol FROM (SELECT DISTINCT target_chembl_id FROM short) t CROSS JOIN (SELECT DISTINCT mol FROM cur) p ANTI JOIN blocked x ON x.mol = p.mol AND x.target_chembl_id = t.target_chembl_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id ORDER BY md5('42|' || target_chembl_id || '|' || mol), mol) - 1 AS i FROM allowed),
again AS (SELECT s.*, e, least(e, 11) AS k, unnest(range(least(e, 11))) AS j FROM short s JOIN (SELECT target_chembl_id, count(*) AS e FROM allowed GROUP BY 1 HAVING count(*) >= 10) USING (target_chembl_id)),
picked AS (SELECT a.pair_id, a.pos, a.target_chembl_id, j * e // k + ('0x' || substr(md5('42|again|' || pair_id || '|' || j), 1, 8))::BIGINT % ((j + 1) * e // k - j * e // k) AS i FROM again a),
drawn AS (SELECT p.pair_id, p.target_chembl_id, n.mol, row_number() OVER (PARTITION BY pair_id ORDER BY md5('42|' || pair_id || '|' || n.mol), n.mol)::INTEGER AS rank FROM picked p JOIN numbered n USING (target_chembl_id, i) WHERE n.mol <> p.pos),
neg AS (SELECT pair_id, mol, target_chembl_id, rank FROM rk SEMI JOIN full10 USING (pair_id) WHERE rank <= 10
  UNION ALL SELECT pair_id, mol, target_chembl_id, rank FROM drawn SEMI JOIN (SELECT pair_id FROM drawn WHERE rank = 10) x USING (pair_id) WHERE rank <= 10)"""


def _negatives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curated measurements, blocked pairs, negatives); the curated rows are written once and read by every step."""
    cur = cut_lineage(_curated(spark, sf_dir).select("activity_id", "molregno", "mol", "target_chembl_id", "organism", "publication_year", "activity_um", "label"))
    mols = cur.select("mol").distinct()
    buckets = max(1, mols.count() // 12)
    blocked = cut_lineage(curate.blocked_pairs(cur, _edges(spark, sf_dir), "mol", "target_chembl_id"))
    return cur, blocked, pairs.sample_negatives(cur.filter("label = 'Active'"), mols, blocked, "mol", "target_chembl_id", 10, buckets, 3)


@query(f"WITH {_NEG_SQL} SELECT pair_id, mol, target_chembl_id, rank FROM neg")
def neg_sample(spark, sf_dir):
    return _negatives(spark, sf_dir)[2]


# ------------------------------------------------------------------------------------------------ pairs

_META_SQL = f"""meta AS (SELECT row_id, molregno, {MOLECULE_SQL} AS mol, target_chembl_id, heavy_atoms, ha_bin, set_type, {PAIR_SQL} AS pair_id, cv_fold, publication_year,
  source_version, CASE WHEN isnan(activity_um) THEN NULL ELSE activity_um END AS activity_um FROM final_training_meta)"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "final_training_meta").select(
        "row_id", "molregno", molecule_key(F.col("mol_chembl_id")).alias("mol"), "target_chembl_id", "heavy_atoms", "ha_bin", "set_type", pair_key(F.col("pair_id")).alias("pair_id"),
        "cv_fold", "publication_year", "source_version", F.nanvl("activity_um", F.lit(None).cast("double")).alias("activity_um"),
    )


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).filter("pair_id IS NOT NULL")


@query(f"""WITH {_META_SQL}, g AS (SELECT pair_id, count(*) AS n, count(*) FILTER (set_type = 'Positive') AS pos, count(*) FILTER (set_type = 'Negative') AS neg,
  count(DISTINCT target_chembl_id) AS t, count(DISTINCT cv_fold) AS f FROM meta WHERE pair_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (n < 8) AS rows_below, count(*) FILTER (n > 11) AS rows_above, count(*) FILTER (pos <> 1) AS positives_not_one,
  count(*) FILTER (neg < 7) AS negatives_below, count(*) FILTER (neg > 10) AS negatives_above, count(*) FILTER (t <> 1) AS targets_not_one, count(*) FILTER (f <> 1) AS folds_not_one FROM g""")
def pair_rule(spark, sf_dir):
    return pairs.pair_metrics(_paired(spark, sf_dir), "pair_id", "target_chembl_id", "cv_fold", 7, 10)


@query(f"""WITH {_META_SQL}, g AS (SELECT pair_id, count(*) FILTER (set_type = 'Negative') AS neg, count(molregno) - count(DISTINCT molregno) AS rep FROM meta WHERE pair_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (neg < 10) AS below, count(*) FILTER (neg = 10) AS exact, count(*) FILTER (neg > 10) AS above, sum(rep)::BIGINT AS repeated_molecules FROM g""")
def pair_manifest(spark, sf_dir):
    return pairs.pair_manifest(_paired(spark, sf_dir), "pair_id", "molregno", 10)


@query(f"WITH {_META_SQL} SELECT mol, target_chembl_id FROM meta WHERE set_type = 'Positive' INTERSECT SELECT mol, target_chembl_id FROM meta WHERE set_type = 'Negative'")
def overlap_check(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return curate.common_keys(m.filter("set_type = 'Positive'"), m.filter("set_type = 'Negative'"), "mol", "target_chembl_id")


@query("SELECT DISTINCT target_id FROM target_table EXCEPT SELECT target_chembl_id FROM final_training_meta")
def targets_without_rows(spark, sf_dir):
    return curate.missing_keys(table(spark, sf_dir, "target_table").select("target_id"), table(spark, sf_dir, "final_training_meta").select(F.col("target_chembl_id").alias("target_id")), "target_id")


@query(f"""WITH {_META_SQL}, g AS (SELECT pair_id, CASE WHEN count(*) FILTER (set_type = 'Positive') = 1 THEN max(publication_year) FILTER (set_type = 'Positive') ELSE max(publication_year) END AS y
  FROM meta WHERE pair_id IS NOT NULL GROUP BY 1)
SELECT coalesce(y > 2018, false) AS is_future, set_type, count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs FROM meta JOIN g USING (pair_id) GROUP BY 1, 2""")
def temporal_split(spark, sf_dir):
    d = pairs.temporal_split(_paired(spark, sf_dir), "pair_id", "publication_year", 2018)
    return d.groupBy("is_future", "set_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pair_id").alias("n_pairs"))


@query(f"""WITH {_META_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY activity_um IS NULL, activity_um DESC NULLS LAST, publication_year NULLS LAST, molregno NULLS LAST, row_id) AS rn
  FROM meta WHERE pair_id IS NOT NULL AND set_type = 'Negative')
SELECT row_id, pair_id FROM r WHERE rn <= 7 UNION ALL SELECT row_id, pair_id FROM meta WHERE pair_id IS NOT NULL AND set_type = 'Positive'""")
def trim_negatives(spark, sf_dir):
    return pairs.trim_negatives(_paired(spark, sf_dir), "pair_id", 7).select("row_id", "pair_id")


_FILL_SQL = f"""{_META_SQL}, {_CURATED_SQL}, have AS (SELECT * FROM meta WHERE pair_id IS NOT NULL),
need AS (SELECT pair_id, min(target_chembl_id) AS target_chembl_id, count(*) FILTER (set_type = 'Negative') AS n_neg FROM have GROUP BY 1 HAVING count(*) FILTER (set_type = 'Negative') < 10),
cand AS (SELECT DISTINCT target_chembl_id, mol, CASE WHEN um >= 100 THEN 1 ELSE 2 END AS tier FROM lab WHERE label <> 'Active' AND mol IS NOT NULL AND target_chembl_id IS NOT NULL),
held AS (SELECT DISTINCT pair_id, mol FROM have),
offer AS (SELECT need.pair_id, need.n_neg, cand.* FROM need JOIN cand USING (target_chembl_id) ANTI JOIN held ON held.pair_id = need.pair_id AND held.mol = cand.mol),
added AS (SELECT pair_id, mol, tier FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY tier, md5('42|' || target_chembl_id || '|' || mol), mol) AS k FROM offer) WHERE k <= 10 - n_neg)"""


def _filled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    have = _paired(spark, sf_dir)
    a = _activities(spark, sf_dir).filter("label <> 'Active'").na.drop(subset=["mol", "target_chembl_id"])
    cand = a.select("target_chembl_id", "mol", F.when(F.col("activity_um") >= 100, 1).otherwise(2).alias("tier"))
    return have, pairs.quota_fill(have, cand, "pair_id", "target_chembl_id", "mol", 10)


@query(f"WITH {_FILL_SQL} SELECT pair_id, mol, tier FROM added")
def quota_fill(spark, sf_dir):
    return _filled(spark, sf_dir)[1]


@query(f"""WITH {_FILL_SQL} SELECT need.pair_id, need.target_chembl_id, n_neg AS have_neg, coalesce(a.n, 0) AS added, 10 - n_neg AS need, 10 - n_neg - coalesce(a.n, 0) AS shortage
FROM need LEFT JOIN (SELECT pair_id, count(*) AS n FROM added GROUP BY 1) a USING (pair_id)""")
def shortage_log(spark, sf_dir):
    have, added = _filled(spark, sf_dir)
    return pairs.shortage_log(have, added, "pair_id", "target_chembl_id", 10)


_GROUPS_SQL = f"{_META_SQL}, grp AS (SELECT pair_id, min(target_chembl_id) AS target_chembl_id, max(ha_bin) // 10 AS decade FROM meta WHERE pair_id IS NOT NULL GROUP BY 1)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("pair_id").agg(F.min("target_chembl_id").alias("target_chembl_id"), F.floor(F.max("ha_bin") / 10).cast("int").alias("decade"))


@query(f"""WITH {_GROUPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id, decade ORDER BY md5('42|' || pair_id), pair_id) AS rn, count(*) OVER (PARTITION BY target_chembl_id, decade) AS n FROM grp)
SELECT pair_id, target_chembl_id, decade FROM r WHERE rn <= least(n, greatest(1, round_even(n * 0.2::DOUBLE, 0)))""")
def strat_subset(spark, sf_dir):
    return pairs.stratified_subset(_groups(spark, sf_dir), "pair_id", ["target_chembl_id", "decade"], 0.2, 1)


_SIZE_SQL = "CASE WHEN {0} <= 15 THEN '01_15' WHEN {0} <= 20 THEN '16_20' WHEN {0} <= 25 THEN '21_25' WHEN {0} <= 30 THEN '26_30' WHEN {0} <= 35 THEN '31_35' WHEN {0} <= 40 THEN '36_40' ELSE '41_plus' END"


@query(f"""WITH r AS (SELECT compound_id, {_SIZE_SQL.format('heavy_atom_count')} AS size_bin FROM compound_table),
k AS (SELECT *, row_number() OVER (PARTITION BY size_bin ORDER BY md5('42|' || compound_id), compound_id) AS rn FROM r)
SELECT compound_id, size_bin FROM k WHERE rn <= 300""")
def size_bin_sample(spark, sf_dir):
    c = table(spark, sf_dir, "compound_table").select("compound_id", bins.size_bin(F.col("heavy_atom_count")).alias("size_bin"))
    return pairs.capped_sample(c, "size_bin", "compound_id", 300)


@query(f"""WITH {_GROUPS_SQL}, d AS (SELECT pair_id, target_chembl_id, md5('42|' || pair_id) AS k FROM grp),
r AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id ORDER BY k, pair_id) - 1 AS place FROM d)
SELECT pair_id, target_chembl_id, ((place + {_BUCKET.format("coalesce(target_chembl_id, '')", '10')}) % 10 + 1)::INTEGER AS fold FROM r""")
def cv_folds(spark, sf_dir):
    return pairs.stratified_folds(_groups(spark, sf_dir), "pair_id", "target_chembl_id", 10)


@query()
def group_folds(spark, sf_dir):
    f = pairs.group_folds(table(spark, sf_dir, "final_training_meta"), ["scaffold_smiles"], 10)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


@query("""WITH g AS (SELECT set_type, count(*) AS n FROM final_training_meta WHERE set_type IS NOT NULL GROUP BY 1)
SELECT set_type, n, round(sum(n) OVER () / (2.0::DOUBLE * n), 9) AS weight FROM g""")
def class_weights(spark, sf_dir):
    return pairs.class_weights(table(spark, sf_dir, "final_training_meta").filter("set_type IS NOT NULL"), "set_type").withColumn("weight", F.round("weight", 9))


@query(f"""WITH {_CURATED_SQL} SELECT t.organism, coalesce(n_targets, 0) AS n_targets, coalesce(n_molecules, 0) AS n_molecules, coalesce(n_rows, 0) AS n_rows
FROM (SELECT unnest(['Homo sapiens', 'Mus musculus', 'Rattus norvegicus', 'All (Total)']) AS organism) t LEFT JOIN (
  SELECT CASE WHEN grouping(organism) = 1 THEN 'All (Total)' ELSE organism END AS organism, count(DISTINCT target_chembl_id) AS n_targets, count(DISTINCT mol) AS n_molecules, count(*) AS n_rows
  FROM cur WHERE label = 'Active' GROUP BY ROLLUP (organism)) s USING (organism)""")
def species_rollup(spark, sf_dir):
    return curate.species_summary(_curated(spark, sf_dir).filter("label = 'Active'"), "organism", "target_chembl_id", "mol", ["Homo sapiens", "Mus musculus", "Rattus norvegicus"])


@query(f"""WITH {_ACT_SQL} SELECT CASE WHEN grouping(standard_type) = 1 THEN 'ALL' ELSE standard_type END AS standard_type, count(um) AS n_measured, count(*) FILTER (um < 1) AS below_1, count(*) FILTER (um < 10) AS below_10,
count(*) FILTER (um < 100) AS below_100, count(*) FILTER (um >= 100) AS from_100 FROM act GROUP BY ROLLUP (standard_type)""")
def threshold_counts(spark, sf_dir):
    return curate.threshold_counts(_activities(spark, sf_dir), "standard_type", "activity_um")


@query("""SELECT least(floor(heavy_atoms / 2.0::DOUBLE), 41)::INTEGER AS bin, count(*) AS n, least(floor(heavy_atoms / 2.0::DOUBLE), 41)::INTEGER * 2.0::DOUBLE AS bin_low
FROM (SELECT DISTINCT molregno, heavy_atoms FROM final_training_meta) WHERE heavy_atoms BETWEEN 0 AND 84 GROUP BY 1, 3""")
def hist_fixed(spark, sf_dir):
    m = table(spark, sf_dir, "final_training_meta").select("molregno", "heavy_atoms").distinct()
    return curate.fixed_histogram(m, "heavy_atoms", 0.0, 84.0, 2.0)


@query("SELECT publication_year, count(*) AS n, median(heavy_atoms) AS median_atoms, max(heavy_atoms) AS max_atoms FROM final_training_meta WHERE publication_year IS NOT NULL GROUP BY 1")
def year_counts(spark, sf_dir):
    d = table(spark, sf_dir, "final_training_meta").filter("publication_year IS NOT NULL")
    return d.groupBy("publication_year").agg(F.count(F.lit(1)).alias("n"), F.percentile("heavy_atoms", F.lit(0.5)).alias("median_atoms"), F.max("heavy_atoms").alias("max_atoms"))


@query("SELECT source_version AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM final_training_meta GROUP BY 1")
def value_counts(spark, sf_dir):
    return curate.value_counts(table(spark, sf_dir, "final_training_meta"), "source_version").withColumn("share", F.round("share", 9))


@query("SELECT count(*) AS n, min(row_id) AS low, max(row_id) AS high, count(DISTINCT row_id) AS n_distinct, min(row_id) = 0 AND max(row_id) = count(*) - 1 AND count(DISTINCT row_id) = count(*) AS dense FROM final_training_meta")
def index_check(spark, sf_dir):
    return curate.index_check(table(spark, sf_dir, "final_training_meta"), "row_id")


@query(f"""WITH fam AS (SELECT DISTINCT target_id AS t, target_name AS name, species, {_FAMILY_SQL} AS f FROM target_table WHERE target_name IS NOT NULL)
SELECT a.t AS target_id, count(*) AS n_homologues, arg_min(b.t, ('0x' || substr(md5(a.t || b.t), 1, 4))::BIGINT * 10000000 + substr(b.t, 7)::BIGINT) AS nearest FROM fam a JOIN fam b USING (f) WHERE a.t <> b.t GROUP BY 1""")
def homology_map(spark, sf_dir):
    targets = table(spark, sf_dir, "target_table")
    rank = F.conv(F.substring(F.md5(F.concat("src", "dst")), 1, 4), 16, 10).cast("double") * 10000000 + F.substring("dst", 7, 20).cast("double")
    hits = _edges(spark, sf_dir).select(F.col("src").alias("qseqid"), F.col("dst").alias("sseqid"), rank.alias("evalue"), F.lit(90.0).alias("pident"))
    m = curate.homology_map(hits, targets.filter("target_name IS NOT NULL"))
    return m.select("target_id", F.size("homologues").cast("long").alias("n_homologues"), F.col("homologues")[0]["id"].alias("nearest"))


# ------------------------------------------------------------------------------------------------ similarity

_P = Params(k=1, policy="paired_sum", threshold_2d=0.30, threshold_3d=0.85, normalise=True, dims=64)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    bits = pack_signs(F.col("embedding"), 2, 32)
    conformer = F.array(F.transform("embedding", lambda x: x.cast("double")))
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("target"), bits.alias("bits"), conformer.alias("conformers"), (F.col("vec_id") % 51 + 10).cast("int").alias("heavy_atoms"),
        (F.col("vec_id") % 7).cast("string").alias("scaffold"), (F.col("vec_id") % 10).cast("int").alias("fold"), F.lit(0).alias("assay"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    keep = ["bits", "conformers", "scaffold", "fold", "assay"]
    return v.select(F.col("id").alias("query_id"), "target", "heavy_atoms", *keep), v.select(F.col("id").alias("active_id"), "target", *keep)


def _word_sql(column: str, word: int) -> str:
    return "(" + " + ".join(f"CASE WHEN {column}[{word * 32 + i + 1}] > 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32)) + ")"


_SIM_SQL = f"""
vec AS (SELECT vec_id AS id, label::BIGINT AS target, embedding::DOUBLE[] AS e, {_word_sql('embedding', 0)} AS w0, {_word_sql('embedding', 1)} AS w1, (vec_id % 51 + 10)::INTEGER AS heavy_atoms,
  (vec_id % 7) AS scaffold, (vec_id % 10)::INTEGER AS fold FROM embeddings),
raw AS (SELECT q.id AS query_id, a.target, a.id AS active_id, q.target AS own, q.scaffold AS qs, a.scaffold AS s, q.fold AS qf, a.fold AS f,
  CASE WHEN bit_count(q.w0 | a.w0) + bit_count(q.w1 | a.w1) = 0 THEN 0.0::DOUBLE ELSE (bit_count(q.w0 & a.w0) + bit_count(q.w1 & a.w1))::DOUBLE / (bit_count(q.w0 | a.w0) + bit_count(q.w1 | a.w1)) END AS raw_2d,
  1.0::DOUBLE / (1.0::DOUBLE + list_sum(list_transform(list_zip(q.e, a.e), lambda x: abs(x[1] - x[2]))) / 64.0::DOUBLE) AS raw_3d
  FROM vec q JOIN vec a ON q.id <> a.id),
sim AS (SELECT *, least(greatest((raw_2d - 0.30::DOUBLE) / 0.70::DOUBLE, 0.0), 1.0) AS n2, least(greatest((raw_3d - 0.85::DOUBLE) / 0.15::DOUBLE, 0.0), 1.0) AS n3 FROM raw)"""


@query(f"WITH {_SIM_SQL} SELECT query_id, target, round(max(raw_2d), 6) AS max_2d FROM sim GROUP BY 1, 2")
def tanimoto_max(spark, sf_dir):
    q, a = _sides(spark, sf_dir)
    return topk_features(similarity_candidates(q.drop("target"), a, _P, False), _P).select("query_id", "target", _r("max_2d"))


@query(f"WITH {_SIM_SQL} SELECT query_id, target, round(max(raw_3d), 6) AS max_3d FROM sim GROUP BY 1, 2")
def l1_sim_max(spark, sf_dir):
    q, a = _sides(spark, sf_dir)
    return topk_features(similarity_candidates(q.drop("target"), a, _P, False), _P).select("query_id", "target", _r("max_3d"))


def _features(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    q, a = _sides(spark, sf_dir)
    return topk_features(similarity_candidates(q, a, p, same_target=True), p)


_MASKED = Params(k=3, policy="paired_sum", mask_scaffold=True, mask_fold=True, dims=64)
_INDEPENDENT = Params(k=3, policy="independent", mask_scaffold=True, dims=64)


@query(f"""WITH {_SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_2d + raw_3d, 9) DESC, active_id) AS rn FROM raw WHERE own = target AND qs <> s AND qf <> f)
SELECT query_id, target, {', '.join(f'round(coalesce(max(raw_3d) FILTER (rn = {i}), 0), 6) AS s1_3d_{i}, round(coalesce(max(raw_2d) FILTER (rn = {i}), 0), 6) AS s2_2d_{i}' for i in (1, 2, 3))}
FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def masked_topk_paired(spark, sf_dir):
    f = _features(spark, sf_dir, _MASKED)
    return f.select("query_id", "target", *(F.round(F.col(f"sims_{m}")[i - 1], 6).alias(f"s{n}_{m}_{i}") for i in (1, 2, 3) for n, m in ((1, "3d"), (2, "2d"))))


_INDEP_SQL = f"""{_SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_2d, 9) DESC, active_id) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_3d, 9) DESC, active_id) AS r3
  FROM raw WHERE own = target AND qs <> s),
top AS (SELECT query_id, target, {', '.join(f'coalesce(max(raw_3d) FILTER (r3 = {i}), 0) AS a{i}, coalesce(max(raw_2d) FILTER (r2 = {i}), 0) AS b{i}' for i in (1, 2, 3))} FROM r GROUP BY 1, 2)"""


@query(f"WITH {_INDEP_SQL} SELECT query_id, target, {', '.join(f'round(a{i}, 6) AS s1_3d_{i}, round(b{i}, 6) AS s2_2d_{i}' for i in (1, 2, 3))} FROM top")
def masked_topk_independent(spark, sf_dir):
    f = _features(spark, sf_dir, _INDEPENDENT)
    return f.select("query_id", "target", *(F.round(F.col(f"sims_{m}")[i - 1], 6).alias(f"s{n}_{m}_{i}") for i in (1, 2, 3) for n, m in ((1, "3d"), (2, "2d"))))


@query(f"""WITH {_INDEP_SQL} SELECT query_id, target, round(list_max([a1, a2, a3]), 6) AS max_3d, round((a1 + a2 + a3) / 3, 6) AS mean_3d, round(list_stddev_pop([a1, a2, a3]), 6) AS std_3d,
round(list_max([b1, b2, b3]), 6) AS max_2d, round((b1 + b2 + b3) / 3, 6) AS mean_2d, round(list_stddev_pop([b1, b2, b3]), 6) AS std_2d FROM top""")
def summary_feature_table(spark, sf_dir):
    return summary_features(_features(spark, sf_dir, _INDEPENDENT)).select("query_id", "target", *(_r(f"{n}_{m}") for m in ("3d", "2d") for n in ("max", "mean", "std")))


def _coefficients(spark: SparkSession) -> DataFrame:
    return spark.range(10, 61).select(F.col("id").cast("int").alias("ha_bin"), (-4.0 + F.col("id") * 0.01).alias("intercept"), (2.0 + F.col("id") * 0.02).alias("w_3d"), F.lit(3.0).alias("w_2d"))


def _loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = _sides(spark, sf_dir)
    features = topk_features(similarity_candidates(q.drop("target"), a, _P, False), _P)
    targets = a.select("target").distinct().withColumn("target_index", F.col("target"))
    return loo_scores(features, q.select("query_id", "heavy_atoms"), targets, _coefficients(spark), q.select("query_id", "target"))


_LOO_SQL = f"""{_SIM_SQL}, best AS (SELECT query_id, target, max(raw_2d) AS max_2d, max(raw_3d) AS max_3d,
  arg_max(n2, (round(n2 + n3, 9), -active_id)) AS f2, arg_max(n3, (round(n2 + n3, 9), -active_id)) AS f3 FROM sim GROUP BY 1, 2),
sc AS (SELECT b.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((-4.0::DOUBLE + h * 0.01::DOUBLE) + (2.0::DOUBLE + h * 0.02::DOUBLE) * f3 + 3.0::DOUBLE * f2))) AS score, v.target AS own
  FROM best b JOIN (SELECT id, target, least(greatest(heavy_atoms, 10), 60) AS h FROM vec) v ON v.id = b.query_id),
loo AS (SELECT query_id, target, max_2d, max_3d, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, target)::INTEGER AS rank, target = own AS is_true_target FROM sc)"""


@query(f"WITH {_LOO_SQL} SELECT query_id, target, round(max_2d, 6) AS max_2d, round(max_3d, 6) AS max_3d, round(score, 6) AS score, rank, is_true_target FROM loo")
def loo_score_rank(spark, sf_dir):
    return _loo(spark, sf_dir).select("query_id", "target", _r("max_2d"), _r("max_3d"), _r("score"), "rank", "is_true_target")


@query(f"WITH {_LOO_SQL} SELECT query_id, target, rank, round(score, 6) AS score FROM loo WHERE rank <= 3 OR round(score, 6) >= 0.3")
def keep_rule_rows(spark, sf_dir):
    return keep_rule(_loo(spark, sf_dir).withColumn("score", F.round("score", 6)), 3, 0.3).select("query_id", "target", "rank", "score")


@query(f"""WITH {_SIM_SQL}, p AS (SELECT bit_count(w0) + bit_count(w1) AS n FROM vec) SELECT count(*) AS n_rows, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::INTEGER AS low, quantile_cont(n, 0.01)::DOUBLE AS q01,
quantile_cont(n, 0.5)::DOUBLE AS q50, quantile_cont(n, 0.99)::DOUBLE AS q99, max(n)::INTEGER AS high, count(*) FILTER (n = 0) AS n_zero FROM p""")
def popcount_stats(spark, sf_dir):
    n = F.col("n")
    d = _vectors(spark, sf_dir).select(popcount(F.col("bits")).alias("n"))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.min(n).alias("low"),
        *(F.percentile(n, F.lit(p)).alias(name) for p, name in ((0.01, "q01"), (0.5, "q50"), (0.99, "q99"))), F.max(n).alias("high"), F.count_if(n == 0).alias("n_zero"),
    )


@query()
def shape_descriptors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    atoms = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.transform(F.slice("embedding", i * 5 + 1, 5), lambda x: x.cast("double")))
    return e.select("vec_id", shape_descriptor(atoms).alias("moments"))


# ------------------------------------------------------------------------------------------------ evaluation


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "p4_0_generate_cv_predictions")


_SUMMARY_SQL = """summary AS (SELECT query_id, size_bin, count(*) AS rows_kept, count(*) FILTER (is_true_target) AS true_kept,
  """ + ", ".join(f"count(*) FILTER (is_true_target AND target_rank <= {k}) AS true_top{k}_count" for k in (1, 5, 10, 15, 100)) + """,
  min(target_rank) FILTER (is_true_target) AS best_true_rank FROM p4_0_generate_cv_predictions GROUP BY 1, 2)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.query_summary(_log(spark, sf_dir))


@query(f"WITH {_SUMMARY_SQL} SELECT *, {', '.join(f'coalesce(best_true_rank <= {k}, false) AS top{k}_hit' for k in (1, 5, 10, 15, 100))} FROM summary")
def query_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("SELECT size_bin, target_rank, count(*) AS n_predictions, count(*) FILTER (is_true_target) AS n_true, count(*) FILTER (is_true_target) / count(*) AS precision_at_rank FROM p4_0_generate_cv_predictions GROUP BY 1, 2")
def precision_at_rank(spark, sf_dir):
    return evaluate.precision_at_rank(_log(spark, sf_dir))


@query(f"""WITH {_SUMMARY_SQL} SELECT cutoff, CASE WHEN grouping(size_bin) = 1 THEN 'ALL' ELSE size_bin END AS size_bin, count(*) AS n_queries, round(avg(coalesce(best_true_rank <= cutoff, false)::INTEGER), 9) AS hit_rate
FROM summary, (SELECT unnest([1, 5, 10, 15, 50, 100, 250, 500]) AS cutoff) GROUP BY GROUPING SETS ((cutoff, size_bin), (cutoff))""")
def hit_rates(spark, sf_dir):
    return evaluate.hit_rates(_summary(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"WITH {_SUMMARY_SQL} SELECT k::BIGINT AS k, count(*) FILTER (best_true_rank <= k) AS hits, round(count(*) FILTER (best_true_rank <= k) / count(*), 9) AS hit_rate FROM summary, range(1, 301) t(k) GROUP BY 1")
def hit_curve(spark, sf_dir):
    return evaluate.hit_curve(_summary(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"""WITH {_SUMMARY_SQL}, one AS (SELECT query_id, min(best_true_rank) AS best_true_rank, sum(true_kept) AS n_true, {', '.join(f'sum(true_top{k}_count) AS c{k}' for k in (10, 15, 100))} FROM summary WHERE query_id IS NOT NULL GROUP BY 1 HAVING sum(true_kept) > 0)
SELECT count(*) AS n_queries, round(avg(coalesce(1.0::DOUBLE / best_true_rank, 0)), 9) AS mrr, median(best_true_rank) AS median_best_rank, {', '.join(f'round(avg(c{k}), 9) AS mean_count_{k}' for k in (10, 15, 100))},
{', '.join(f'round(avg(c{k} / n_true), 9) AS mean_recall_{k}' for k in (10, 15, 100))} FROM one""")
def multi_target_metrics(spark, sf_dir):
    s = _summary(spark, sf_dir).filter("query_id IS NOT NULL")
    one = s.groupBy("query_id").agg(F.min("best_true_rank").alias("best_true_rank"), *(F.sum(f"true_top{k}_count").alias(f"true_top{k}_count") for k in (10, 15, 100)))
    sizes = s.groupBy("query_id").agg(F.sum("true_kept").alias("n_true")).filter("n_true > 0")
    m = evaluate.multi_target_metrics(one, sizes, "query_id")
    return m.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


@query("""WITH g AS (SELECT query_id, count(*) AS n FROM p4_0_generate_cv_predictions GROUP BY 1)
SELECT count(*) AS n_queries, sum(n)::BIGINT AS n_rows, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows FROM g""")
def run_summary(spark, sf_dir):
    return evaluate.run_summary(_log(spark, sf_dir), "query_id")


@query("""WITH d AS (SELECT size_bin, CASE WHEN isnan(combined_score) THEN NULL ELSE combined_score::DOUBLE END AS v FROM p4_0_generate_cv_predictions)
SELECT size_bin, count(v) AS n, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.1), 9) AS p10, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.9), 9) AS p90, round(quantile_cont(v, 0.95), 9) AS p95,
round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM d GROUP BY 1""")
def score_quantiles(spark, sf_dir):
    q = evaluate.quantiles(_log(spark, sf_dir), "combined_score", ["size_bin"])
    return q.select("size_bin", "n", *(F.round(c, 9).alias(c) for c in ("p05", "p10", "p50", "p90", "p95")), _r("mean"), _r("std"))


_VALID = "combined_score IS NOT NULL AND NOT isnan(combined_score) AND combined_score BETWEEN 0 AND 1"


@query(f"""WITH d AS (SELECT size_bin, combined_score::DOUBLE AS v, is_true_target AS t FROM p4_0_generate_cv_predictions WHERE {_VALID} AND size_bin IS NOT NULL),
e AS (SELECT size_bin, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 20) for i in range(21))}]))) AS edges FROM d GROUP BY 1),
b AS (SELECT d.*, greatest(len(list_filter(edges, lambda x: x < v)), 1) - 1 AS bin FROM d JOIN e USING (size_bin))
SELECT size_bin, bin::INTEGER AS bin, min(v) AS score_min, max(v) AS score_max, round(avg(v), 6) AS score_mean, count(*) AS n_rows, count(*) FILTER (t) AS n_true, round(avg(coalesce(t, false)::INTEGER), 9) AS precision FROM b GROUP BY 1, 2""")
def score_bins_qcut(spark, sf_dir):
    return _score_bins(spark, sf_dir).withColumn("score_mean", F.round("score_mean", 6)).withColumn("precision", F.round("precision", 9))


def _score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.score_bins(_log(spark, sf_dir).filter(_VALID).filter("size_bin IS NOT NULL"), "size_bin", "combined_score", "is_true_target", 20)


def _parameters(spark: SparkSession) -> DataFrame:
    labels = [label for _, label in bins.SIZE_BINS]
    return spark.createDataFrame([(label, -3.0 + 0.25 * i, 4.0 + 0.5 * i) for i, label in enumerate(labels)], "size_bin string, intercept double, slope double")


_PARAM_SQL = "par AS (SELECT * FROM (VALUES " + ", ".join(f"('{label}', {-3.0 + 0.25 * i}::DOUBLE, {4.0 + 0.5 * i}::DOUBLE)" for i, (_, label) in enumerate(bins.SIZE_BINS)) + ") v(size_bin, a, b))"


@query(f"""WITH {_PARAM_SQL} SELECT prediction_id, round(coalesce(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * combined_score::DOUBLE))), 0.0)::FLOAT::DOUBLE, 5) AS calibrated
FROM p4_0_generate_cv_predictions LEFT JOIN par USING (size_bin) WHERE {_VALID}""")
def score_calibrate(spark, sf_dir):
    d = calibrate.apply_calibration(_log(spark, sf_dir).filter(_VALID), _parameters(spark), "size_bin", F.col("combined_score").cast("double"), "calibrated")
    return d.select("prediction_id", F.round(F.col("calibrated").cast("double"), 5).alias("calibrated"))


@query(f"""WITH {_PARAM_SQL} SELECT size_bin, target_rank, round(max(coalesce(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * ln(target_rank)))), 0.0)::FLOAT::DOUBLE), 5) AS calibrated
FROM p4_0_generate_cv_predictions LEFT JOIN par USING (size_bin) WHERE target_rank >= 1 GROUP BY 1, 2""")
def rank_calibrate(spark, sf_dir):
    d = calibrate.apply_calibration(_log(spark, sf_dir).filter("target_rank >= 1"), _parameters(spark), "size_bin", F.log(F.col("target_rank").cast("double")), "calibrated")
    return d.groupBy("size_bin", "target_rank").agg(F.round(F.max(F.col("calibrated").cast("double")), 5).alias("calibrated"))


@query()
def rank_curve_fit(spark, sf_dir):
    return calibrate.fit_rank_curves(_summary(spark, sf_dir).filter("size_bin IS NOT NULL"))


@query()
def score_curve_fit(spark, sf_dir):
    return calibrate.fit_score_curves(_score_bins(spark, sf_dir))


_SUBSET_SQL = "sub AS (SELECT * FROM final_training_meta WHERE batch_no >= 4)"


def _subset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    full = table(spark, sf_dir, "final_training_meta")
    return full, full.filter("batch_no >= 4")


_COMPARE_SQL = f"""{_SUBSET_SQL}, a AS (SELECT ha_bin::VARCHAR AS value, count(*) AS n FROM final_training_meta GROUP BY 1), b AS (SELECT ha_bin::VARCHAR AS value, count(*) AS n FROM sub GROUP BY 1),
cmp AS (SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS n_full, coalesce(b.n, 0) AS n_subset, coalesce(a.n, 0) / sum(a.n) OVER () AS p_full, coalesce(b.n, 0) / sum(b.n) OVER () AS p_subset
  FROM a FULL JOIN b ON a.value IS NOT DISTINCT FROM b.value)"""


@query(f"WITH {_COMPARE_SQL} SELECT value, n_full, n_subset, round(p_full, 9) AS p_full, round(p_subset, 9) AS p_subset FROM cmp")
def dist_compare(spark, sf_dir):
    return evaluate.distribution_compare(*_subset(spark, sf_dir), "ha_bin").select("value", "n_full", "n_subset", _r("p_full", 9), _r("p_subset", 9))


@query(f"""WITH {_COMPARE_SQL}, n AS (SELECT (p_full + 1e-12) / sum(p_full + 1e-12) OVER () AS p, (p_subset + 1e-12) / sum(p_subset + 1e-12) OVER () AS q FROM cmp)
SELECT round(sqrt(0.5::DOUBLE * sum(p * ln(2 * p / (p + q))) + 0.5::DOUBLE * sum(q * ln(2 * q / (p + q)))), 6) AS js_distance FROM n""")
def js_distance(spark, sf_dir):
    return evaluate.js_distance(evaluate.distribution_compare(*_subset(spark, sf_dir), "ha_bin")).select(_r("js_distance"))


@query(f"""WITH {_SUBSET_SQL}, v AS (SELECT activity_um AS v, 1 AS f, 0 AS s FROM final_training_meta WHERE NOT isnan(activity_um) UNION ALL SELECT activity_um, 0, 1 FROM sub WHERE NOT isnan(activity_um)),
c AS (SELECT v, sum(sum(f)) OVER (ORDER BY v) AS cf, sum(sum(s)) OVER (ORDER BY v) AS cs FROM v GROUP BY v)
SELECT round(max(abs(cf / (SELECT sum(f) FROM v) - cs / (SELECT sum(s) FROM v))), 9) AS ks FROM c""")
def ks_stat(spark, sf_dir):
    return evaluate.ks_statistic(*_subset(spark, sf_dir), "activity_um").select(_r("ks", 9))


@query(f"""WITH {_SUBSET_SQL} SELECT f.target_chembl_id, f.n AS n_full, coalesce(s.n, 0) AS n_subset, round(coalesce(s.n, 0) / f.n, 9) AS ratio FROM (SELECT target_chembl_id, count(*) AS n FROM final_training_meta WHERE target_chembl_id IS NOT NULL GROUP BY 1) f
LEFT JOIN (SELECT target_chembl_id, count(*) AS n FROM sub GROUP BY 1) s USING (target_chembl_id)""")
def coverage_left(spark, sf_dir):
    return evaluate.coverage(*_subset(spark, sf_dir), "target_chembl_id").withColumn("ratio", F.round("ratio", 9))


@query("""SELECT cv_fold, count(*) FILTER (set_type = 'Positive') AS n_pos, count(*) FILTER (set_type = 'Negative') AS n_neg, round(count(*) FILTER (set_type = 'Positive') / nullif(count(*) FILTER (set_type = 'Negative'), 0), 9) AS ratio
FROM final_training_meta WHERE set_type IS NOT NULL GROUP BY 1""")
def fold_stats(spark, sf_dir):
    d = evaluate.fold_stats(table(spark, sf_dir, "final_training_meta").filter("set_type IS NOT NULL"), "cv_fold", F.col("set_type") == "Positive")
    return d.withColumn("ratio", F.round("ratio", 9))


_SCORED_SQL = f"d AS (SELECT size_bin, combined_score::DOUBLE AS s, is_true_target::INTEGER AS y FROM p4_0_generate_cv_predictions WHERE {_VALID} AND is_true_target IS NOT NULL), g AS (SELECT size_bin, s, sum(y) AS p, count(*) - sum(y) AS n FROM d GROUP BY 1, 2)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).filter(_VALID)


@query(f"""WITH {_SCORED_SQL}, w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY size_bin ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * n) AS wins FROM g)
SELECT size_bin, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, round(sum(wins) / nullif(sum(p)::DOUBLE * sum(n), 0), 9) AS auc FROM w GROUP BY 1""")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_scored(spark, sf_dir), ["size_bin"], F.col("combined_score"), F.col("is_true_target")).withColumn("auc", F.round("auc", 9))


@query(f"""WITH {_SCORED_SQL}, w AS (SELECT *, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM g WINDOW o AS (PARTITION BY size_bin ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT size_bin, sum(p)::BIGINT AS n_pos, round(sum(p * cp / (cp + cn)) / nullif(sum(p)::DOUBLE, 0), 9) AS average_precision FROM w GROUP BY 1""")
def avg_precision(spark, sf_dir):
    a = evaluate.average_precision(_scored(spark, sf_dir), ["size_bin"], F.col("combined_score"), F.col("is_true_target"))
    return a.withColumn("average_precision", F.round("average_precision", 9))


@query(f"""WITH v AS (SELECT ha_bin AS b, avg(CASE WHEN isnan(activity_um) THEN NULL ELSE activity_um END) AS v FROM final_training_meta WHERE ha_bin IS NOT NULL GROUP BY 1 HAVING v IS NOT NULL),
w AS (SELECT k AS bin, b, v, abs(k - b) AS d, CASE WHEN abs(k - b) <= 6 THEN exp(-((k - b) * (k - b)) / 4.5::DOUBLE) END AS w FROM range(10, 61) t(k), v)
SELECT bin::INTEGER AS bin, round(coalesce(sum(w * v) / sum(w), arg_min(v, (d, b))), 6) AS smoothed FROM w GROUP BY 1""")
def coef_smooth(spark, sf_dir):
    m = table(spark, sf_dir, "final_training_meta").filter("ha_bin IS NOT NULL")
    v = m.groupBy("ha_bin").agg(F.avg(F.nanvl("activity_um", F.lit(None).cast("double"))).alias("v"))
    return models.smooth_coefficients(v, "ha_bin", "v").select("bin", _r("smoothed"))


@query()
def logistic_fit(spark, sf_dir):
    d = _scored(spark, sf_dir).filter("size_bin IS NOT NULL").withColumn("y", F.col("is_true_target").cast("int"))
    d = d.filter("NOT isnan(max_sim_3d) AND NOT isnan(max_sim_2d)")
    c = models.fit_logistic_by_group(d, "size_bin", ["max_sim_3d", "max_sim_2d"], "y")
    return c.select("size_bin", F.round("intercept", 4).alias("intercept"), F.round(F.col("weights")[0], 4).alias("w_3d"), F.round(F.col("weights")[1], 4).alias("w_2d"), "n_rows", "converged")
