"""Queries of the llm operators, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.ids import molecule_key, pair_key, target_of_pair
from affinis.llm import bpe, leaks, overlap, pii, splits, stable_sample, target_sample, topn
from affinis.plans.problems import PAIR_SQL, table


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    meta = table(spark, sf_dir, "final_training_meta")
    shares = splits.read_shares(table(spark, sf_dir, "split_targets"))
    parts = splits.components(meta, pair_key(F.col("pair_id")), F.col("row_id"), F.col("set_type") == "Positive", F.col("cv_fold"))
    return splits.assign_splits(parts, shares), shares


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with the split of their pair."""
    meta = table(spark, sf_dir, "final_training_meta").select("row_id", "pair_id", "cv_fold")
    return splits.split_rows(meta, pair_key(F.col("pair_id")), F.col("row_id"), _assigned(spark, sf_dir)[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stood in several folds and that the assignment brings into one split."""
    return splits.mixed_folds(_placed(spark, sf_dir), F.col("cv_fold")).select(F.col("key").alias("pair_id"))


def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its rows and the number of splits they stand in, which must be one."""
    g = _placed(spark, sf_dir).filter(F.col("component").startswith("k:")).groupBy(F.substring("component", 3, 1 << 30).alias("pair_id"))
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each split has its share of the rows and of the labelled rows to within the largest component."""
    assigned, shares = _assigned(spark, sf_dir)
    all_ = assigned.agg(F.sum("n_rows").alias("all_rows"), F.sum("n_label").alias("all_labels"), F.max("n_rows").alias("step_rows"), F.max("n_label").alias("step_labels"))
    d = splits.split_report(assigned, shares).crossJoin(F.broadcast(all_))  # one row
    near = lambda n, whole, step: F.abs(F.col(n) - F.col("target_share") * F.col(whole)) <= F.col(step)
    return d.select("split", "all_rows", "all_labels", near("n_rows", "all_rows", "step_rows").alias("rows_met"), near("n_label", "all_labels", "step_labels").alias("labels_met"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assigned(spark, sf_dir)[0]
    return a.select("component", "split", "n_rows", "n_label")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(*_assigned(spark, sf_dir))


def _sample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed rates of p2: 30 % of the pairs of targets with a stated minimum of 20 rows or more, beside 20 % of all others.

    A stated rate only raises the threshold, so a target that is listed later keeps its sample and adds to it.
    """
    t = table(spark, sf_dir, "sample_targets").filter("dimension = 'target_chembl_id' AND min_rows >= 20")
    return t.select(F.col("category").alias("stratum"), F.lit(0.3).alias("rate"))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "final_training_meta")
    s = stable_sample.stable_sample(meta, pair_key(F.col("pair_id")), target_of_pair, F.col("batch_no"), salt="p2", default_rate=0.2, rates=_sample_rates(spark, sf_dir))
    return s.select(F.col("key").alias("pair_id"), "stratum", "first_batch")


def _both_sides(spark: SparkSession, sf_dir: str) -> tuple:
    fold = F.col("cv_fold")
    return table(spark, sf_dir, "final_training_meta"), "row_id", molecule_key(F.col("mol_chembl_id")), F.col("scaffold_smiles"), fold.between(9, 10), fold.between(1, 8)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlap.cross_split_overlap(*_both_sides(spark, sf_dir))
    return o.select(F.least("eval_row", "train_row").alias("row_id_a"), F.greatest("eval_row", "train_row").alias("row_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation fold and source: pairs, evaluation rows that overlap, training rows they overlap with."""
    return overlap.overlap_counts(*_both_sides(spark, sf_dir), {"eval_fold": F.col("cv_fold"), "eval_source": F.col("source_version")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "p4_0_generate_cv_predictions")
    return topn.top_n(log, "compound_id", "target_id", "combined_score", 5, 0.0, 1.0).select("compound_id", "target_id")


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "p4_0_generate_cv_predictions")
    return topn.top_n(log, "compound_id", "target_id", "combined_score", 5, 0.0, 1.0)


def _quarter(spark: SparkSession, sf_dir: str) -> target_sample.TargetSample:
    columns = {"target_chembl_id": F.col("target_chembl_id"), "ha_bin": F.col("ha_bin"), "cv_fold": F.col("cv_fold"), "time_split": F.lower(F.trim("time_split"))}
    return target_sample.target_sample(table(spark, sf_dir, "final_training_meta"), "row_id", columns, table(spark, sf_dir, "sample_targets"), 0.25)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that the drawn sample misses and that the rows left over cannot fill either."""
    return _quarter(spark, sf_dir).report.filter("sampled < wanted AND sampled + undrawn < wanted AND category <> '*'").select("dimension", "category")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarter(spark, sf_dir).report


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarter(spark, sf_dir).rows


def p7_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's rows, whether they reach what is wanted, and whether the sample has the minimum or all there is."""
    return _quarter(spark, sf_dir).report.select("dimension", "category", "supply", "fillable", (F.col("sampled") >= F.least("min_rows", "supply")).alias("least_met"))


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn, different ones, and those of the table among them: three times the size of the sample."""
    drawn = _quarter(spark, sf_dir).rows.select("row_id")
    known = table(spark, sf_dir, "final_training_meta").select("row_id", F.lit(1).alias("known"))
    return drawn.join(known, "row_id", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_different"), F.count("known").alias("n_known"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter("NOT paraphrase").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of each suite, with the documents that hold them."""
    found = _leaks(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select("item_id", "suite"), "item_id")
    return found.groupBy("suite", "item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("words").alias("most_words"), F.count_if("paraphrase").alias("n_paraphrases"), F.max(F.col("answer").cast("int")).alias("answer_leaked"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.kind", "p.found").distinct()


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "masked")


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_whole": p1_whole,
    "p1_shares": p1_shares,
    "p1_report": p1_report,
    "p2_sample": p2_sample,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_ranked": p6_ranked,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_sample": p7_sample,
    "p7_supply": p7_supply,
    "p7_drawn": p7_drawn,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}

_BEST = """
WITH best AS (
  SELECT trim(compound_id, ' ' || chr(9) || chr(10) || chr(13)) AS compound_id, target_id, max(combined_score) AS combined_score
  FROM p4_0_generate_cv_predictions
  WHERE compound_id IS NOT NULL AND target_id IS NOT NULL AND NOT isnan(combined_score) AND combined_score BETWEEN 0 AND 1
  GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY combined_score DESC, target_id) AS position
  FROM best WHERE compound_id <> '')"""

ORACLE = {
    "p1_found": f"""
SELECT pair_id FROM (SELECT {PAIR_SQL} AS pair_id, cv_fold FROM final_training_meta WHERE cv_fold BETWEEN 1 AND 10)
WHERE pair_id IS NOT NULL GROUP BY pair_id HAVING count(DISTINCT cv_fold) > 1""",
    "p1_whole": f"""
SELECT pair_id, count(*) AS n_rows, 1::BIGINT AS n_splits FROM (SELECT {PAIR_SQL} AS pair_id FROM final_training_meta) WHERE pair_id IS NOT NULL GROUP BY 1""",
    "p1_shares": """
SELECT split_name AS split, count(m.row_id) AS all_rows, count(m.row_id) FILTER (m.set_type = 'Positive') AS all_labels, true AS rows_met, true AS labels_met
FROM split_targets CROSS JOIN final_training_meta m GROUP BY 1""",
    "p2_sample": f"""
WITH k AS (
  SELECT {PAIR_SQL} AS pair_id, min(coalesce(batch_no, 0)) AS first_batch FROM final_training_meta WHERE pair_id IS NOT NULL GROUP BY 1),
s AS (SELECT *, CASE WHEN contains(pair_id, '_') THEN split_part(pair_id, '_', -1) ELSE '' END AS stratum,
  ('0x' || substr(md5('p2|' || pair_id), 1, 15))::BIGINT AS h FROM k WHERE pair_id IS NOT NULL)
SELECT pair_id, stratum, first_batch FROM s
WHERE h < floor((CASE WHEN stratum IN (SELECT category FROM sample_targets WHERE dimension = 'target_chembl_id' AND min_rows >= 20) THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END)
  * 1152921504606846976::DOUBLE)""",
    "p6_found": _BEST + " SELECT compound_id, target_id FROM ranked WHERE position <= 5",
    "p6_ranked": _BEST + " SELECT compound_id, target_id, combined_score::DOUBLE AS combined_score, position::INTEGER AS position FROM ranked WHERE position <= 5",
    "p7_found": """
WITH n AS (SELECT floor(count(*) / 4) AS n FROM final_training_meta),
have AS (
  SELECT 'target_chembl_id' AS dimension, target_chembl_id AS category, count(*) AS c FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'ha_bin', ha_bin::VARCHAR, count(*) FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'cv_fold', cv_fold::VARCHAR, count(*) FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'time_split', lower(trim(time_split)), count(*) FROM final_training_meta GROUP BY 2)
SELECT t.dimension, t.category FROM sample_targets t CROSS JOIN n LEFT JOIN have h ON h.dimension = t.dimension AND h.category = t.category
WHERE t.category <> '*' AND coalesce(h.c, 0) < greatest(t.min_rows, t.target_share * n.n)""",
    "p7_supply": """
WITH n AS (SELECT floor(count(*) / 4) AS n FROM final_training_meta),
have AS (
  SELECT 'target_chembl_id' AS dimension, target_chembl_id AS category, count(*) AS c FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'ha_bin', ha_bin::VARCHAR, count(*) FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'cv_fold', cv_fold::VARCHAR, count(*) FROM final_training_meta GROUP BY 2
  UNION ALL SELECT 'time_split', lower(trim(time_split)), count(*) FROM final_training_meta GROUP BY 2),
placed AS (SELECT h.dimension, coalesce(t.category, '*') AS category, sum(c) AS c FROM have h LEFT JOIN sample_targets t ON t.dimension = h.dimension AND t.category = h.category
  WHERE h.category IS NOT NULL GROUP BY 1, 2)
SELECT t.dimension, t.category, coalesce(p.c, 0)::BIGINT AS supply, coalesce(p.c, 0) >= greatest(t.min_rows, t.target_share * n.n) AS fillable, true AS least_met
FROM sample_targets t CROSS JOIN n LEFT JOIN placed p ON p.dimension = t.dimension AND p.category = t.category""",
    "p7_drawn": "SELECT (count(*) // 4) AS n_rows, (count(*) // 4) AS n_different, (count(*) // 4) AS n_known FROM final_training_meta",
}
