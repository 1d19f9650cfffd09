"""Evaluation of ranked predictions and comparison of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.ranges import quantiles as exact_quantiles
from affinis.operators.ranges import sums_before

CUTOFFS = (1, 5, 10, 15, 100)
HIT_CUTOFFS = (1, 5, 10, 15, 50, 100, 250, 500)


def query_summary(log: DataFrame, query: str = "query_id", bin_: str = "size_bin", rank: str = "target_rank", truth: str = "is_true_target", cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query: rows kept, true targets kept and within each cutoff, best true rank (NULL if none), hits."""
    true = F.coalesce(F.col(truth), F.lit(False))
    counts = [F.count_if(true & (F.col(rank) <= k)).alias(f"true_top{k}_count") for k in cutoffs]
    g = log.groupBy(query, bin_).agg(F.count(F.lit(1)).alias("rows_kept"), F.count_if(true).alias("true_kept"), *counts, F.min(F.when(true, F.col(rank))).alias("best_true_rank"))
    return g.select("*", *(F.coalesce(F.col("best_true_rank") <= k, F.lit(False)).alias(f"top{k}_hit") for k in cutoffs))


def precision_at_rank(log: DataFrame, bin_: str = "size_bin", rank: str = "target_rank", truth: str = "is_true_target") -> DataFrame:
    g = log.groupBy(bin_, rank).agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(F.col(truth)).alias("n_true"))
    return g.withColumn("precision_at_rank", F.try_divide("n_true", "n_predictions"))


def hit_rates(summary: DataFrame, cutoffs: tuple[int, ...] = HIT_CUTOFFS, bin_: str = "size_bin") -> DataFrame:
    """Share of queries whose best true rank is within each cutoff, per bin and over ALL; no true target is a miss."""
    cut = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    rolled = summary.select(bin_, "best_true_rank", cut).rollup("cutoff", bin_).agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce(F.col("best_true_rank") <= F.col("cutoff"), F.lit(False)).cast("double")).alias("hit_rate"), F.grouping_id().alias("g")
    )
    return rolled.filter("g < 2").withColumn(bin_, F.when(F.col("g") == 1, "ALL").otherwise(F.col(bin_))).drop("g")


def hit_curve(summary: DataFrame, most: int = 300) -> DataFrame:
    """The hit rate at every cutoff up to ``most``: a histogram of best ranks, summed up; n rows and ``most`` cutoffs."""
    spark = summary.sparkSession
    hist = summary.groupBy(F.col("best_true_rank").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = hist.agg(F.sum("n").alias("all"))
    small = hist.filter(F.col("k").between(1, most))
    grid = spark.range(1, most + 1).select(F.col("id").alias("k")).join(small, "k", "left").na.fill(0, ["n"])
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # `most` rows
    return grid.withColumn("hits", F.sum("n").over(w)).crossJoin(F.broadcast(n)).select("k", "hits", (F.col("hits") / F.col("all")).alias("hit_rate"))


def multi_target_metrics(summary: DataFrame, truth_sizes: DataFrame, query: str, cutoffs: tuple[int, ...] = (10, 15, 100)) -> DataFrame:
    """MRR, median best rank, mean number and recall of true targets within each cutoff; one row."""
    d = summary.join(truth_sizes, query)
    return d.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.coalesce(1.0 / F.col("best_true_rank"), F.lit(0.0))).alias("mrr"),
        F.percentile("best_true_rank", F.lit(0.5)).alias("median_best_rank"),
        *(F.avg(f"true_top{k}_count").alias(f"mean_count_{k}") for k in cutoffs),
        *(F.avg(F.col(f"true_top{k}_count") / F.col("n_true")).alias(f"mean_recall_{k}") for k in cutoffs),
    )


def run_summary(log: DataFrame, query: str) -> DataFrame:
    g = log.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_rows"), F.min("n").alias("min_rows"), F.percentile("n", F.lit(0.5)).alias("median_rows"), F.max("n").alias("max_rows"))


def quantiles(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.05, 0.1, 0.5, 0.9, 0.95)) -> DataFrame:
    """Exact quantiles (linear interpolation), mean and population standard deviation; NaN counts as missing."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    whole = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    q = exact_quantiles(df, by, value, list(points)).select(*(F.col(g).alias(f"__{g}") for g in by), "q")
    on = F.lit(True)
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return whole.join(q, on, "left").select(*by, "n", *(F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(points)), "mean", "std")


def rank_targets(scored: DataFrame, query: str, target: str, score: str, top: int) -> DataFrame:
    """The ``top`` targets of each query, best first, ties to the smaller target; pruned by the group limit."""
    w = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), F.col(target))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def hits_of_ranked(ranked: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...], query: str = "query_id", target: str = "target", own: str = "own") -> DataFrame:
    """Share of ranked queries whose own target is within each cutoff, to four places; one row."""
    d = ranked.join(truth, query).groupBy(query).agg(F.min(F.when(F.col(target) == F.col(own), F.col("rank"))).alias("best"))
    return d.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")), 4).alias(f"hit_at_{k}") for k in cutoffs))


# ---------------------------------------------------------------------------------------- distributions


def distribution_compare(full: DataFrame, subset: DataFrame, column: str) -> DataFrame:
    """Counts and shares of every value in both frames; NULL is a value, absence is 0."""
    side = lambda d, n: d.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias(n))
    a, b = side(full, "n_full"), side(subset, "n_subset").withColumnRenamed("value", "__value")
    j = a.join(b, F.col("value").eqNullSafe(F.col("__value")), "full_outer").select(F.coalesce("value", "__value").alias("value"), F.coalesce("n_full", F.lit(0)).alias("n_full"), F.coalesce("n_subset", F.lit(0)).alias("n_subset"))
    total = j.agg(F.sum("n_full").alias("all_full"), F.sum("n_subset").alias("all_subset"))
    return j.crossJoin(F.broadcast(total)).select("value", "n_full", "n_subset", F.try_divide("n_full", "all_full").alias("p_full"), F.try_divide("n_subset", "all_subset").alias("p_subset"))  # one row


def js_distance(compared: DataFrame, eps: float = 1e-12) -> DataFrame:
    """The Jensen-Shannon distance (square root of the divergence, natural logarithm); one row."""
    p, q = F.col("p_full") + F.lit(eps), F.col("p_subset") + F.lit(eps)
    sums = compared.agg(F.sum(p).alias("sp"), F.sum(q).alias("sq"))
    d = compared.crossJoin(F.broadcast(sums)).select((p / F.col("sp")).alias("p"), (q / F.col("sq")).alias("q"))  # one row
    m = (F.col("p") + F.col("q")) / 2
    return d.agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(F.col("p") * F.log(F.col("p") / m)) + 0.5 * F.sum(F.col("q") * F.log(F.col("q") / m)))).alias("js_distance"))


def ks_statistic(full: DataFrame, subset: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic: the largest gap of the two distribution functions; one row.

    Values are counted per distinct value, spread over ranges of the value; each range sums up its own counts on top of
    the counts of the ranges before it, so no task sorts the whole column.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v")
    both = full.select(v, F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(subset.select(v, F.lit(0).alias("f"), F.lit(1).alias("s"))).filter("v IS NOT NULL")
    run = sums_before(both.groupBy("v").agg(F.sum("f").alias("f"), F.sum("s").alias("s")), [], ["v"], ["f", "s"], parts)
    run = run.select("f", "s", (F.col("before_f") + F.col("f")).alias("cf"), (F.col("before_s") + F.col("s")).alias("cs"))
    total = run.agg(F.sum("f").alias("nf"), F.sum("s").alias("ns"))
    return run.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("cf") / F.col("nf") - F.col("cs") / F.col("ns"))).alias("ks"))  # one row


def coverage(full: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of every key of the full frame and of the subset, 0 where it has none; NULL keys are left out."""
    f = full.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_full"))
    s = subset.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_subset"))
    return f.join(s, key, "left").na.fill(0, ["n_subset"]).withColumn("ratio", F.col("n_subset") / F.col("n_full"))


# ---------------------------------------------------------------------------------------- classifiers


def fold_stats(df: DataFrame, fold: str, positive: Column) -> DataFrame:
    g = df.groupBy(fold).agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    return g.withColumn("ratio", F.try_divide("n_pos", "n_neg"))


def _by_score(df: DataFrame, by: list[str], score: Column, positive: Column) -> DataFrame:
    s = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
    d = df.select(*by, s.alias("s"), positive.cast("long").alias("y")).filter("s IS NOT NULL AND y IS NOT NULL")
    return d.groupBy(*by, "s").agg(F.sum("y").alias("p"), (F.count(F.lit(1)) - F.sum("y")).alias("n"))


def roc_auc(df: DataFrame, by: list[str], score: Column, positive: Column) -> DataFrame:
    """Exact area under the ROC curve per group, ties counting half; NULL without both classes."""
    d = sums_before(_by_score(df, by, score, positive), by, ["s"], ["n"]).withColumn("wins", F.col("p") * (F.col("before_n") + 0.5 * F.col("n")))
    return d.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.try_divide(F.sum("wins"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, by: list[str], score: Column, positive: Column) -> DataFrame:
    """Sum over tie groups of the recall gained times the precision there; not the trapezoid under the curve."""
    g = _by_score(df, by, score, positive).withColumn("down", -F.col("s"))
    d = sums_before(g, by, ["down"], ["p", "n"]).withColumn("cp", F.col("before_p") + F.col("p")).withColumn("cn", F.col("before_n") + F.col("n"))
    return d.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.try_divide(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))), F.sum("p").cast("double")).alias("average_precision"))
