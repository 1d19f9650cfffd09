"""Calibration of ranks and scores to the probability of a true target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.ranges import equal_count_edges


def quantile_bins(df: DataFrame, by: str, value: str, n_bins: int = 20) -> DataFrame:
    """Adds ``bin``: equal-count bins per group, right-closed with the lowest value included, repeated edges dropped.

    At most as many bins as distinct values, and two at least; NULL and NaN values are left out.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    d = df.withColumn("__v", v).filter("__v IS NOT NULL")
    edges = equal_count_edges(d, by, "__v", n_bins)  # one row for each group
    below = F.size(F.filter("edges", lambda e: e < F.col("__v")))
    return d.join(edges, by).withColumn("bin", F.greatest(below, F.lit(1)) - 1).drop("edges", "__v")


def score_bins(df: DataFrame, by: str, score: str, truth: str, n_bins: int = 20) -> DataFrame:
    """Per group and bin: score range and mean, rows, true ones, precision."""
    s = F.col(score).cast("double")
    return quantile_bins(df, by, score, n_bins).groupBy(by, "bin").agg(
        F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.avg(s).alias("score_mean"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(truth)).alias("n_true"), F.avg(F.coalesce(F.col(truth), F.lit(False)).cast("double")).alias("precision"),
    )


def logistic(x: Column, intercept: Column, slope: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(intercept + slope * x)))


def apply_calibration(df: DataFrame, parameters: DataFrame, by: str, x: Column, out: str) -> DataFrame:
    """Adds the calibrated probability as a float; groups without parameters get 0.

    ``parameters``: by, intercept, slope; one row for each bin, left to the optimiser to broadcast.
    """
    d = df.join(parameters.select(by, F.col("intercept").alias("__a"), F.col("slope").alias("__b")), by, "left")
    return d.withColumn(out, F.coalesce(logistic(x, F.col("__a"), F.col("__b")), F.lit(0.0)).cast("float")).drop("__a", "__b")


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: tuple[float, float], bounds: tuple[tuple[float, float], tuple[float, float]]) -> tuple[float, float, float]:
    """Bounded weighted least squares of a two-parameter logistic curve, by damped Gauss-Newton; (a, b, rmse)."""
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    p = np.clip(np.array(start, float), low, high)

    def curve(p):
        return 1 / (1 + np.exp(-np.clip(p[0] + p[1] * x, -500, 500)))

    def cost(p):
        return float((weight * (y - curve(p)) ** 2).sum())

    damp, now = 1e-3, cost(p)
    for _ in range(200):
        f = curve(p)
        j = (f * (1 - f))[:, None] * np.stack([np.ones_like(x), x], axis=1)
        h, g = (j * weight[:, None]).T @ j, (j * weight[:, None]).T @ (y - f)
        step = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), g)
        new = np.clip(p + step, low, high)
        after = cost(new)
        if after < now:
            moved = np.abs(new - p).max()
            p, now, damp = new, after, max(damp / 3, 1e-12)
            if moved < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), float(np.sqrt(((y - curve(p)) ** 2).mean()))


def fit_curves(points: DataFrame, by: str, x: str, y: str, weight: str | None, start: tuple[float, float], bounds) -> DataFrame:
    """(by, intercept, slope, rmse) of a logistic curve through the points of each group.

    The points are an aggregate (bins or cutoffs), a few hundred for each group.
    """

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        w = d["w"].to_numpy(float)
        a, b, rmse = _fit_logistic(d["x"].to_numpy(float), d["y"].to_numpy(float), w, start, bounds)
        return pd.DataFrame({by: [d[by].iloc[0]], "intercept": [a], "slope": [b], "rmse": [rmse]})

    d = points.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    return d.groupBy(by).applyInPandas(fit, f"`{by}` {dict(points.dtypes)[by]}, intercept double, slope double, rmse double")


def fit_rank_curves(summary: DataFrame, bin_: str = "size_bin", most: int = 300) -> DataFrame:
    """Per size bin the curve of the hit rate over ln(cutoff), slope in 0..20 and intercept in -20..20."""
    n = summary.groupBy(bin_).agg(F.count(F.lit(1)).alias("all"))
    hist = summary.groupBy(bin_, "best_true_rank").agg(F.count(F.lit(1)).alias("n"))
    grid = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    hits = grid.join(hist.withColumnRenamed(bin_, "__b"), F.col(bin_).eqNullSafe(F.col("__b")) & (F.col("best_true_rank") <= F.col("k")), "left")
    points = hits.groupBy(bin_, "k", "all").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.col("all")).alias("y")).withColumn("x", F.log("k"))
    return fit_curves(points, bin_, "x", "y", None, (-2.0, 1.0), ((-20.0, 20.0), (0.0, 20.0)))


def fit_score_curves(bins: DataFrame, bin_: str = "size_bin") -> DataFrame:
    """Per size bin the curve of precision over mean score, weighted by the rows of each score bin."""
    return fit_curves(bins, bin_, "score_mean", "precision", "n_rows", (-5.0, 5.0), ((-30.0, 5.0), (0.0, 100.0)))


def curve_points(parameters: DataFrame, by: str, low: float = 0.0, high: float = 1.0, n: int = 200) -> DataFrame:
    """The fitted curve on an even grid."""
    step = (high - low) / (n - 1)
    g = parameters.select(by, "intercept", "slope", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("x", F.lit(low) + F.col("i") * F.lit(step))
    return g.select(by, "i", "x", logistic(F.col("x"), F.col("intercept"), F.col("slope")).alias("y"))
