"""Registered queries of longer workflows: validation, folds, training to test, evaluation on later data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import bins
from affinis.functions.similarity import popcount
from affinis.operators import calibrate, curate, evaluate, models, pairs
from affinis.operators.similarity import Params, similarity_candidates, topk_features
from affinis.plans import catalog as c
from affinis.plans.catalog import _r
from affinis.plans.problems import table
from affinis.schema import keep_present
from affinis.sources.readers import resolve_parquet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------------------------------------ curation


@query(f"""WITH {c._CURATED_SQL}, {c._EDGES_SQL}, blocked AS MATERIALIZED (SELECT mol, target_chembl_id FROM cur UNION SELECT mol, dst FROM cur JOIN edges ON src = target_chembl_id),
n AS (SELECT count(DISTINCT mol) AS n FROM cur), held AS (SELECT target_chembl_id, count(*) AS b FROM blocked GROUP BY 1),
pos AS (SELECT DISTINCT mol || '_' || target_chembl_id AS pair_id, target_chembl_id FROM cur WHERE label = 'Active')
SELECT pair_id, 10::BIGINT AS n_negatives, 10::BIGINT AS n_molecules, 0::BIGINT AS n_blocked FROM pos JOIN held USING (target_chembl_id), n WHERE n - b >= 10""")
def neg_sample_rule(spark, sf_dir):
    """Every positive that has ten allowed molecules gets ten different ones, none of them known or homologous."""
    cur, blocked, neg = c._negatives(spark, sf_dir)
    bad = blocked.select(F.col("mol"), F.col("target_chembl_id"), F.lit(1).alias("bad"))
    d = neg.join(bad, ["mol", "target_chembl_id"], "left").groupBy("pair_id")
    return d.agg(F.count(F.lit(1)).alias("n_negatives"), F.count_distinct("mol").alias("n_molecules"), F.count("bad").alias("n_blocked"))


@query(f"""WITH {c._NEG_SQL}, f AS (SELECT DISTINCT mol || '_' || target_chembl_id AS pair_id, publication_year, organism FROM cur WHERE label = 'Active'),
one AS (SELECT mol, arg_min(molregno, activity_id) AS molregno FROM cur GROUP BY 1)
SELECT pair_id, mol, target_chembl_id, molregno, publication_year, organism, NULL::DOUBLE AS activity_um, 'Assumed_Inactive' AS label, 'Negative' AS set_type FROM neg JOIN f USING (pair_id) JOIN one USING (mol)""")
def neg_rows(spark, sf_dir):
    cur, _, neg = c._negatives(spark, sf_dir)
    positive = cur.filter("label = 'Active'").withColumn("pair_id", F.concat_ws("_", "mol", "target_chembl_id")).select("pair_id", "mol", "target_chembl_id", "molregno", "publication_year", "organism", "activity_um")
    molecules = curate.first_values(cur, "mol", F.col("activity_id"), "molregno")
    rows = pairs.negative_rows(neg, positive, molecules, "mol", ["molregno"], ["activity_um"])
    return rows.select("pair_id", "mol", "target_chembl_id", "molregno", "publication_year", "organism", "activity_um", "label", "set_type")


@query(f"""WITH {c._META_SQL}, g AS (SELECT pair_id, count(*) AS n, count(DISTINCT target_chembl_id) AS t, count(DISTINCT cv_fold) AS f FROM meta WHERE pair_id IS NOT NULL GROUP BY 1),
o AS (SELECT mol, target_chembl_id FROM meta WHERE set_type = 'Positive' AND mol IS NOT NULL AND target_chembl_id IS NOT NULL INTERSECT SELECT mol, target_chembl_id FROM meta WHERE set_type = 'Negative')
SELECT m.*, p.*, (SELECT count(*) FROM o) AS pos_neg_overlap FROM
(SELECT count(*) AS n_rows, max(heavy_atoms) AS max_heavy_atoms, count(*) FILTER (heavy_atoms > 60) AS heavy_atoms_over, count(*) FILTER (set_type = 'Positive' AND activity_um >= 10) AS positives_weak,
  count(*) FILTER (set_type = 'Negative' AND activity_um < 500) AS negatives_strong, count(*) FILTER (set_type IS NULL OR set_type NOT IN ('Positive', 'Negative')) AS bad_set_type FROM meta) m,
(SELECT count(*) FILTER (n <> 11) AS pairs_not_full, count(*) FILTER (t <> 1) AS pairs_of_targets, count(*) FILTER (f <> 1) AS pairs_of_folds FROM g) p""")
def validation_report(spark, sf_dir):
    return pairs.validation_report(c._meta(spark, sf_dir), "pair_id", "target_chembl_id", "mol", "heavy_atoms", "activity_um", most_atoms=60)


@query(f"""WITH {c._ACT_SQL}, y AS (SELECT max(publication_year) AS y FROM act),
hit AS (SELECT DISTINCT mol, act.target_chembl_id FROM act JOIN activities USING (activity_id), y WHERE act.publication_year = y AND act.standard_type IN ('IC50', 'Ki', 'Kd', 'EC50') AND um < 0.1 AND confidence_score > 3
  AND full_mwt < 1000 AND act.organism = 'Homo sapiens' AND mol IS NOT NULL AND act.target_chembl_id IS NOT NULL)
SELECT mol, count(*) AS n_targets FROM hit GROUP BY 1 HAVING count(*) >= 2""")
def potency_benchmark(spark, sf_dir):
    a = c._activities(spark, sf_dir).join(table(spark, sf_dir, "activities").select("activity_id", "confidence_score", "full_mwt"), "activity_id")
    return curate.potency_benchmark(a, "mol", "target_chembl_id", ("IC50", "Ki", "Kd", "EC50"), below_um=0.1, organism="Homo sapiens", size=F.col("full_mwt") < 1000)


@query("""SELECT standard_type, count(*) AS n, count(v) AS n_known, round(min(v), 9) AS least FROM (SELECT standard_type, CASE lower(trim(standard_units, ' '))
 WHEN 'nm' THEN 1e-3 WHEN 'nanomolar' THEN 1e-3 WHEN 'um' THEN 1.0 WHEN 'µm' THEN 1.0 WHEN 'μm' THEN 1.0 WHEN 'micromolar' THEN 1.0 WHEN 'pm' THEN 1e-6 WHEN 'picomolar' THEN 1e-6 WHEN 'mm' THEN 1e3 WHEN 'millimolar' THEN 1e3
 WHEN 'm' THEN 1e6 WHEN 'molar' THEN 1e6 WHEN 'fm' THEN 1e-9 WHEN 'femtomolar' THEN 1e-9 END::DOUBLE * CASE WHEN isnan(standard_value) THEN NULL ELSE standard_value END AS v FROM activities) GROUP BY 1""")
def wide_units(spark, sf_dir):
    d = curate.with_activity(table(spark, sf_dir, "activities"), units=bins.TO_MICROMOLAR_WIDE)
    return d.groupBy("standard_type").agg(F.count(F.lit(1)).alias("n"), F.count("activity_um").alias("n_known"), F.round(F.min("activity_um"), 9).alias("least"))


@query("""SELECT compound_id, coalesce(heavy_atom_count, 9999)::INTEGER AS atoms FROM compound_table WHERE coalesce(heavy_atom_count, 9999) <= 40""")
def size_limit(spark, sf_dir):
    d = table(spark, sf_dir, "compound_table").withColumn("atoms", bins.or_sentinel(F.col("heavy_atom_count")))
    return d.filter("atoms <= 40").select("compound_id", "atoms")


# ------------------------------------------------------------------------------------------------ joins of features


@query(f"""WITH {c._META_SQL}, v AS (SELECT vec_id, {c._word_sql('embedding', 0)} AS w0, {c._word_sql('embedding', 1)} AS w1, label FROM embeddings)
SELECT m.row_id, m.target_chembl_id, v.label::BIGINT AS label, (bit_count(w0) + bit_count(w1))::INTEGER AS bits_set FROM final_training_meta m JOIN v ON v.vec_id = m.memmap_idx""")
def features_to_rows(spark, sf_dir):
    """Rows with the features of their molecule, by the index that both sides carry; several rows may share one."""
    v = c._vectors(spark, sf_dir).select(F.col("id").alias("memmap_idx"), F.col("target").alias("label"), popcount(F.col("bits")).cast("int").alias("bits_set"))
    m = keep_present(table(spark, sf_dir, "final_training_meta"), ["row_id", "memmap_idx", "target_chembl_id"])
    return m.join(v, "memmap_idx").select("row_id", "target_chembl_id", "label", "bits_set")


# ------------------------------------------------------------------------------------------------ folds


@query(f"WITH {c._GROUPS_SQL} SELECT pair_id, ntile(10) OVER (ORDER BY md5('42|' || pair_id), pair_id)::INTEGER AS fold FROM grp")
def plain_folds(spark, sf_dir):
    return pairs.plain_folds(c._groups(spark, sf_dir).select("pair_id"), "pair_id", 10)


@query("SELECT try_cast(source_version AS BIGINT) AS version_no, cv_fold::BIGINT AS fold, count(*) AS n FROM final_training_meta GROUP BY 1, 2")
def given_folds(spark, sf_dir):
    d = pairs.given_folds(table(spark, sf_dir, "final_training_meta"), "cv_fold")
    return d.groupBy(F.expr("try_cast(source_version AS BIGINT)").alias("version_no"), "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {c._META_SQL}, s AS (SELECT pair_id, CASE WHEN publication_year <= 2018 THEN 'past' WHEN publication_year > 2018 THEN 'later' ELSE 'unknown' END AS side, publication_year = 2020 AS exact FROM meta WHERE pair_id IS NOT NULL)
SELECT side, count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs, count(*) FILTER (exact) AS n_exact_year FROM s GROUP BY 1""")
def row_time_split(spark, sf_dir):
    d = pairs.row_time_split(c._paired(spark, sf_dir), "publication_year", 2018)
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pair_id").alias("n_pairs"), F.count_if(F.col("publication_year") == 2020).alias("n_exact_year"))


@query("SELECT round(coalesce(avg(r), 0), 9) AS mean_ratio FROM (SELECT count(*) FILTER (set_type = 'Positive') / nullif(count(*) FILTER (set_type = 'Negative'), 0) AS r FROM final_training_meta WHERE set_type IS NOT NULL GROUP BY cv_fold)")
def fold_mean(spark, sf_dir):
    d = evaluate.fold_stats(table(spark, sf_dir, "final_training_meta").filter("set_type IS NOT NULL"), "cv_fold", F.col("set_type") == "Positive")
    return models.mean_over_folds(d, [], "ratio").select(_r("mean_ratio", 9))


@query("SELECT count(*) AS n_rows, count(DISTINCT pair_id) AS n_written FROM final_training_meta")
def resolved_source(spark, sf_dir):
    path = resolve_parquet(spark, sf_dir, preferred="final_training_meta.parquet")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pair_id").alias("n_written"))


# ------------------------------------------------------------------------------------------------ similarity options

_TOP = (1, 2, 3)


def _slots_sql(r2: str, r3: str, s2: str, s3: str) -> str:
    return ", ".join(f"round(greatest(coalesce(max({s3}) FILTER ({r3} = {i}), 0), 0), 6) AS s1_3d_{i}, round(greatest(coalesce(max({s2}) FILTER ({r2} = {i}), 0), 0), 6) AS s2_2d_{i}" for i in _TOP)


def _slots(f: DataFrame) -> DataFrame:
    return f.select("query_id", "target", *(F.round(F.col(f"sims_{m}")[i - 1], 6).alias(f"s{n}_{m}_{i}") for i in _TOP for n, m in ((1, "3d"), (2, "2d"))))


def _one_order_sql(score: str) -> str:
    return f"""WITH {c._SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, active_id) AS rn FROM raw WHERE own = target AND qs <> s)
SELECT query_id, target, {_slots_sql('rn', 'rn', 'raw_2d', 'raw_3d')} FROM r WHERE rn <= 3 GROUP BY 1, 2"""


@query(_one_order_sql("raw_2d"))
def masked_topk_paired_2d(spark, sf_dir):
    return _slots(c._features(spark, sf_dir, Params(k=3, policy="paired_2d", mask_scaffold=True, dims=64)))


@query(_one_order_sql("raw_3d"))
def masked_topk_paired_3d(spark, sf_dir):
    return _slots(c._features(spark, sf_dir, Params(k=3, policy="paired_3d", mask_scaffold=True, dims=64)))


@query(f"""WITH {c._SIM_SQL}, x AS (SELECT *, CASE WHEN raw_2d < 0.30 THEN -1 ELSE raw_2d END AS e2, CASE WHEN raw_3d < 0.65 THEN -1 ELSE raw_3d END AS e3 FROM raw WHERE own = target AND qs <> s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(e2, 9) DESC, active_id) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY round(e3, 9) DESC, active_id) AS r3 FROM x)
SELECT query_id, target, {_slots_sql('r2', 'r3', 'e2', 'e3')} FROM r GROUP BY 1, 2""")
def masked_topk_excluded(spark, sf_dir):
    """Actives below the preset's thresholds are excluded, which ranks either modality for itself."""
    return _slots(c._features(spark, sf_dir, Params.preset("stp2014", k=3, exclude_below=True, mask_scaffold=True, dims=64)))


@query(f"""WITH {c._SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_2d + raw_3d, 9) DESC, active_id) AS rn FROM raw WHERE own = target AND q_assay <> a_assay)
SELECT query_id, target, {_slots_sql('rn', 'rn', 'raw_2d', 'raw_3d')} FROM r WHERE rn <= 3 GROUP BY 1, 2""".replace("FROM raw WHERE own", "FROM (SELECT *, query_id % 3 AS q_assay, active_id % 3 AS a_assay FROM raw) WHERE own"))
def masked_topk_assay(spark, sf_dir):
    q, a = c._sides(spark, sf_dir)
    q, a = q.withColumn("assay", (F.col("query_id") % 3).cast("int")), a.withColumn("assay", (F.col("active_id") % 3).cast("int"))
    p = Params(k=3, mask_assay=True, dims=64)
    return _slots(topk_features(similarity_candidates(q, a, p, same_target=True), p))


_L1 = "list_sum(list_transform(list_zip(q.e[{0}:{1}], a.e[{2}:{3}]), lambda x: abs(x[1] - x[2])))"
_FOUR = ", ".join(_L1.format(i, i + 31, j, j + 31) for i in (1, 33) for j in (1, 33))


@query(f"""WITH vec AS (SELECT vec_id AS id, label::BIGINT AS target, embedding::DOUBLE[] AS e FROM embeddings),
raw AS (SELECT q.id AS query_id, a.target, 1.0::DOUBLE / (1.0::DOUBLE + least({_FOUR}) / 32.0::DOUBLE) AS raw_3d FROM vec q JOIN vec a ON q.id <> a.id AND q.target = a.target)
SELECT query_id, target, round(max(raw_3d), 6) AS max_3d FROM raw GROUP BY 1, 2""")
def conformers_max(spark, sf_dir):
    """Two conformers a molecule: the nearest of the four pairs counts."""
    halves = F.array(*(F.transform(F.slice("embedding", i, 32), lambda x: x.cast("double")) for i in (1, 33)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), halves.alias("conformers"))
    q, a = c._sides(spark, sf_dir)
    q = q.drop("conformers").join(e.withColumnRenamed("id", "query_id"), "query_id")
    a = a.drop("conformers").join(e.withColumnRenamed("id", "active_id"), "active_id")
    p = Params(k=1, dims=32)
    return topk_features(similarity_candidates(q, a, p, same_target=True), p).select("query_id", "target", _r("max_3d"))


# ------------------------------------------------------------------------------------------------ training to test


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = c._scored(spark, sf_dir).filter("size_bin IS NOT NULL AND is_true_target IS NOT NULL AND NOT isnan(max_sim_3d) AND NOT isnan(max_sim_2d)").dropna(subset=["max_sim_3d", "max_sim_2d"])
    fold = (pairs.hash_bucket(F.coalesce("query_id", F.lit("")), 5, "42") + 1).alias("fold")
    return d.select("prediction_id", "size_bin", "batch_no", "max_sim_3d", "max_sim_2d", F.col("is_true_target").cast("int").alias("y"), fold)


_TRAINED_SQL = f"""t AS (SELECT prediction_id, size_bin, batch_no, max_sim_3d, max_sim_2d, is_true_target::INTEGER AS y, (('0x' || substr(md5('42|' || coalesce(query_id, '')), 1, 8))::BIGINT % 5)::INTEGER + 1 AS fold
  FROM p4_0_generate_cv_predictions WHERE {c._VALID} AND size_bin IS NOT NULL AND is_true_target IS NOT NULL AND NOT isnan(max_sim_3d) AND NOT isnan(max_sim_2d) AND max_sim_3d IS NOT NULL AND max_sim_2d IS NOT NULL)"""


@query(f"""WITH {_TRAINED_SQL}, g AS (SELECT size_bin, fold, greatest(max_sim_3d, max_sim_2d)::DOUBLE AS s, sum(y) AS p, count(*) - sum(y) AS n FROM t GROUP BY 1, 2, 3),
w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY size_bin, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * n) AS wins FROM g)
SELECT size_bin, fold, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, round(sum(wins) / nullif(sum(p)::DOUBLE * sum(n), 0), 9) AS auc FROM w GROUP BY 1, 2""")
def baseline_auc(spark, sf_dir):
    """The baseline without a fit: the larger of both similarities as the score, per bin and fold."""
    d = _trained(spark, sf_dir)
    return evaluate.roc_auc(d, ["size_bin", "fold"], F.greatest("max_sim_3d", "max_sim_2d"), F.col("y") == 1).withColumn("auc", F.round("auc", 9))


@query()
def cv_train_test(spark, sf_dir):
    """Per bin the mean over folds of the AUC and average precision of the model and of the models of one similarity."""
    sets = {"both": ["max_sim_3d", "max_sim_2d"], "only_3d": ["max_sim_3d"], "only_2d": ["max_sim_2d"]}
    scored = models.cross_validate_models(_trained(spark, sf_dir), "size_bin", "fold", sets, "y")
    m = models.fold_metrics(scored, ["size_bin", "model"], "fold", "score", "y")
    return m.select("size_bin", "model", "n_folds", _r("mean_auc"), _r("mean_ap"))


@query()
def later_metrics(spark, sf_dir):
    """Production models of the earlier deliveries, judged on the last one; bins without both classes are left out."""
    d = _trained(spark, sf_dir)
    fitted = models.fit_logistic_by_group(d.filter("batch_no < 5"), "size_bin", ["max_sim_3d", "max_sim_2d"], "y")
    scored = models.score_logistic(d.filter("batch_no >= 5"), fitted.filter("fitted"), "size_bin", ["max_sim_3d", "max_sim_2d"]).filter("score IS NOT NULL")
    return models.group_metrics(scored, ["size_bin"], "score", "y").filter("auc IS NOT NULL").select("size_bin", "n_pos", "n_neg", _r("auc"), _r("average_precision"))


@query()
def stacked_later(spark, sf_dir):
    """The stacked model of the earlier deliveries, judged on the last one; ten rounds of trees instead of the default 300."""
    d = _trained(spark, sf_dir)
    fitted = models.fit_stacked(d.filter("batch_no < 5"), "prediction_id", ["max_sim_3d"], ["max_sim_2d"], "y", iterations=10)
    scored = models.score_stacked(d.filter("batch_no >= 5").withColumn("model", F.lit("stacked")), fitted)
    return models.group_metrics(scored, ["model"], "score", "y").select("model", "n_pos", "n_neg", _r("auc"), _r("average_precision"))


@query("SELECT DISTINCT ha_bin::VARCHAR AS ha_bin, ha_bin / 10 AS intercept, 2 AS n_weights, ha_bin * 2 - 1 AS sum_weights FROM final_training_meta WHERE ha_bin IS NOT NULL")
def coefficients_read_back(spark, sf_dir):
    """A coefficient table through its JSON form and back."""
    b = table(spark, sf_dir, "final_training_meta").select("ha_bin").distinct()
    t = b.select("ha_bin", (F.col("ha_bin") / 10).alias("intercept"), F.array((F.col("ha_bin") * 2).cast("double"), F.lit(-1.0)).alias("weights"))
    back = models.coefficients_of_json(models.coefficients_json(t, "ha_bin"), "ha_bin")
    return back.select("ha_bin", "intercept", F.size("weights").alias("n_weights"), (F.col("weights")[0] + F.col("weights")[1]).alias("sum_weights"))


@query("""SELECT size_bin, coalesce(try_cast(replace(trim(size_bin), '_', '?') AS DOUBLE), -1) AS number, count(*) AS n FROM p4_0_generate_cv_predictions GROUP BY 1, 2
UNION ALL SELECT source_version, coalesce(try_cast(replace(trim(source_version), '_', '?') AS DOUBLE), -1), count(*) FROM final_training_meta GROUP BY 1, 2""")
def coerced_numbers(spark, sf_dir):
    """Texts as numbers where they are any, else -1."""
    parts = [table(spark, sf_dir, t).select(F.col(k).alias("size_bin")) for t, k in (("p4_0_generate_cv_predictions", "size_bin"), ("final_training_meta", "source_version"))]
    counted = [d.groupBy("size_bin", bins.number(F.col("size_bin"), -1.0).alias("number")).agg(F.count(F.lit(1)).alias("n")) for d in parts]
    return counted[0].unionByName(counted[1])


@query(f"""WITH {c._SIM_SQL}, best AS (SELECT query_id, own, target, max(raw_2d + raw_3d) AS score FROM raw WHERE query_id % 10 >= 8 AND active_id % 10 < 8 AND qs <> s GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, target) AS rank FROM best),
q AS (SELECT query_id, min(rank) FILTER (own = target AND rank <= 15) AS best FROM r GROUP BY 1)
SELECT count(*) AS n_queries, {', '.join(f'round(avg(coalesce(best <= {k}, false)::INTEGER), 4) AS hit_at_{k}' for k in (1, 5, 10, 15))} FROM q""")
def later_top15(spark, sf_dir):
    """Later queries against earlier actives only, without those of the query's scaffold; hit rates among the first 15."""
    q, a = c._sides(spark, sf_dir)
    q, a = q.filter("query_id % 10 >= 8"), a.filter("active_id % 10 < 8")
    p = Params(k=1, policy="paired_sum", mask_scaffold=True, dims=64)
    f = topk_features(similarity_candidates(q.drop("target"), a, p, False), p)
    ranked = evaluate.rank_targets(f.withColumn("score", F.col("sims_2d")[0] + F.col("sims_3d")[0]), "query_id", "target", "score", 15)
    return evaluate.hits_of_ranked(ranked, q.select("query_id", F.col("target").alias("own")), (1, 5, 10, 15))


@query()
def calibration_curve(spark, sf_dir):
    return calibrate.curve_points(calibrate.fit_score_curves(c._score_bins(spark, sf_dir)), "size_bin").select("size_bin", "i", _r("x", 9), _r("y"))
