"""Models per size bin: logistic regression by Newton steps over partial sums, boosted trees, coefficient smoothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators import evaluate
from affinis.operators.pairs import stratified_folds
from affinis.session import cut_lineage

#: Coefficients of a bin with one class only; fixed values.
DEFAULT_INTERCEPT, DEFAULT_3D, DEFAULT_2D = -5.0, 3.0, 7.0


def fit_logistic_by_group(df: DataFrame, by: str, features: list[str], label: str, c: float = 10.0, rounds: int = 25) -> DataFrame:
    """(by, intercept, weights array, n_rows, fitted, converged) of an L2-regularised logistic regression with balanced classes per group.

    Newton's method, one Spark pass a round: every group sends its gradient and Hessian as sums of built-in aggregates,
    which combine before the shuffle, so a group of any size costs a few numbers. ``by`` has few values (size bins);
    their coefficients are what the driver holds.  Rows with a NULL feature or label are left out; a group of one class
    gets the default coefficients.  ``converged`` is false where the last step was still 1e-8 or more after ``rounds``
    and where nothing was fitted.
    """
    spark = df.sparkSession
    d = df.select(by, *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("__y")).dropna()
    counts = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).collect()  # one row a group
    k = len(features) + 1
    theta = {r[by]: np.zeros(k) for r in counts if 0 < r["p"] < r["n"]}
    sizes = {r[by]: (int(r["n"]), float(r["p"])) for r in counts}
    x = [F.lit(1.0), *(F.col(f"__x{i}") for i in range(len(features)))]
    live = set(theta)
    for _ in range(rounds):
        if not live:
            break
        rows = [(g, *map(float, theta[g]), sizes[g][0] / (2 * sizes[g][1]), sizes[g][0] / (2 * (sizes[g][0] - sizes[g][1]))) for g in live]
        schema = f"`{by}` {dict(df.dtypes)[by]}, " + ", ".join(f"__t{i} double" for i in range(k)) + ", __wp double, __wn double"
        e = d.join(spark.createDataFrame(rows, schema), by)
        z = sum((x[i] * F.col(f"__t{i}") for i in range(1, k)), F.col("__t0"))
        e = e.withColumn("__p", 1.0 / (1.0 + F.exp(-z))).withColumn("__w", F.when(F.col("__y") > 0.5, F.col("__wp")).otherwise(F.col("__wn")))
        r, h = F.col("__w") * (F.col("__y") - F.col("__p")), F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        sums = [F.sum(r * x[i]).alias(f"g{i}") for i in range(k)] + [F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        for row in e.groupBy(by).agg(*sums).collect():  # one row a group
            g = row[by]
            ridge = np.diag([0.0] + [1.0 / c] * (k - 1))
            hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge + 1e-12 * np.eye(k)
            grad = np.array([row[f"g{i}"] for i in range(k)]) - ridge @ theta[g]
            step = np.linalg.solve(hess, grad)
            size = np.abs(step).max()
            theta[g] = theta[g] + step * min(1.0, 5.0 / max(size, 1e-12))
            if size < 1e-8:
                live.discard(g)
    default = [DEFAULT_INTERCEPT, *(DEFAULT_3D if i % 2 == 0 else DEFAULT_2D for i in range(k - 1))]
    out = [(g, *(lambda t: (float(t[0]), [float(v) for v in t[1:]]))(theta.get(g, np.array(default))), n, g in theta, g in theta and g not in live) for g, (n, _) in sizes.items()]
    return spark.createDataFrame(out, f"`{by}` {dict(df.dtypes)[by]}, intercept double, weights array<double>, n_rows long, fitted boolean, converged boolean")


def score_logistic(df: DataFrame, coefficients: DataFrame, by: str, features: list[str], out: str = "score") -> DataFrame:
    """Adds the probability of each row under its group's coefficients."""
    z = F.col("__b")
    d = df.join(coefficients.select(by, F.col("intercept").alias("__b"), F.col("weights").alias("__w")), by, "left")
    for i, f in enumerate(features):
        z = z + F.col("__w")[i] * F.col(f).cast("double")
    return d.withColumn(out, 1.0 / (1.0 + F.exp(-z))).drop("__b", "__w")


def cross_validate(df: DataFrame, by: str, fold: str, features: list[str], label: str, c: float = 10.0) -> DataFrame:
    """Out-of-fold scores: each fold is scored by coefficients fitted on the others.  Rows without a fold are left out."""
    return cross_validate_models(df, by, fold, {"": features}, label, c).drop("model")


def cross_validate_models(df: DataFrame, by: str, fold: str, sets: dict[str, list[str]], label: str, c: float = 10.0) -> DataFrame:
    """Out-of-fold scores of several models, one for each named set of features: every row once a ``model``.

    The models of all groups, folds and sets are fitted together: every row goes into the sums of the folds that are not
    its own, so a Newton step is one pass however many models there are.  A feature outside a set counts as 0 there, and
    its weight stays 0.  Rows without a fold are left out; a row without a value of a model's feature has no score there.
    """
    names = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)  # the folds
    if not names:
        return df.withColumn("model", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double")).limit(0)
    every = list(dict.fromkeys(f for s in sets.values() for f in s))
    masked = [f"__f{i}" for i in range(len(every))]

    def by_model(d: DataFrame) -> DataFrame:
        d = d.withColumn("model", F.explode(F.array(*map(F.lit, sets))))
        used = [F.col("model").isin(*(n for n, s in sets.items() if f in s)) for f in every]
        return d.select("*", *(F.when(u, F.col(f).cast("double")).otherwise(0.0).alias(m) for u, f, m in zip(used, every, masked)))

    fit_of = lambda held: F.to_json(F.struct(F.col(by).alias("group"), F.col("model").alias("model"), held.alias("held")))
    folded = df.filter(F.col(fold).isNotNull())
    slim = cut_lineage(folded.select(by, fold, *every, label))
    held = F.explode(F.filter(F.array(*map(F.lit, names)), lambda f: f != F.col(fold)))
    train = by_model(slim).withColumn("__held", held).withColumn("__fit", fit_of(F.col("__held")))
    fitted = fit_logistic_by_group(train, "__fit", masked, label, c)
    return score_logistic(by_model(folded).withColumn("__fit", fit_of(F.col(fold))), fitted, "__fit", masked).drop("__fit", *masked)


def group_metrics(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, n_pos, n_neg, auc, average_precision); NULL where a group lacks a class."""
    positive = F.col(label) > 0.5
    ap = evaluate.average_precision(scored, by, F.col(score), positive).drop("n_pos")
    return evaluate.roc_auc(scored, by, F.col(score), positive).join(ap, by)


def fold_metrics(scored: DataFrame, by: list[str], fold: str, score: str, label: str) -> DataFrame:
    """(by, n_folds, mean_auc, mean_ap) over the folds that have both classes, 0 where none has."""
    m = group_metrics(scored, [*by, fold], score, label)
    return m.groupBy(*by).agg(F.count("auc").alias("n_folds"), F.coalesce(F.avg("auc"), F.lit(0.0)).alias("mean_auc"), F.coalesce(F.avg(F.when(F.col("auc").isNotNull(), F.col("average_precision"))), F.lit(0.0)).alias("mean_ap"))


@dataclass(frozen=True)
class Stacked:
    """Trees of either modality and the logistic regression over their probabilities, or (without trees) over all features."""

    features_3d: list[str]
    features_2d: list[str]
    trees_3d: object | None
    trees_2d: object | None
    coefficients: DataFrame


def _probability(trees, df: DataFrame, features: list[str], out: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    return trees.transform(x).withColumn(out, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def fit_stacked(df: DataFrame, row: str, features_3d: list[str], features_2d: list[str], label: str, iterations: int = 300, least_rows: int = 40) -> Stacked:
    """Boosted trees per modality with three-fold out-of-fold probabilities, and a logistic regression over both.

    Classes are balanced by weights everywhere; the folds hold equal shares of either class, dealt in a fixed shuffle of
    ``row``, which tells the rows apart.  With fewer than ``least_rows`` rows or one class only there are no trees: the
    logistic regression takes the features themselves.  Rows with a NULL feature or label are left out.  Agreement with
    leaf-wise trees is at the level of metrics, as these grow level by level (depth 5, at least 20 rows a leaf).
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    both = [*features_3d, *features_2d]
    d = df.select(row, *both, F.col(label).cast("int").alias("__y")).dropna()
    n, positive = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("__y"), F.lit(0))).first()
    d = d.withColumn("__all", F.lit(1))
    if n < least_rows or not 0 < positive < n:
        return Stacked(features_3d, features_2d, None, None, fit_logistic_by_group(d, "__all", both, "__y"))
    folds = stratified_folds(d, row, "__y", 3).select(row, F.col("fold").alias("__fold"))
    weight = F.when(F.col("__y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    d = cut_lineage(d.join(folds, row).withColumn("__weight", weight))

    def fit(frame: DataFrame, features: list[str]):
        x = VectorAssembler(inputCols=features, outputCol="__x").transform(frame)
        return GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__weight", stepSize=0.05, maxIter=iterations, maxDepth=5, minInstancesPerNode=20, checkpointInterval=10, seed=42).fit(x)

    parts = None
    for f in (1, 2, 3):
        rest, held = d.filter(F.col("__fold") != f), d.filter(F.col("__fold") == f)
        p = _probability(fit(rest, features_2d), _probability(fit(rest, features_3d), held, features_3d, "p_3d"), features_2d, "p_2d")
        parts = p if parts is None else parts.unionByName(p)
    meta = fit_logistic_by_group(cut_lineage(parts.select("__all", "p_3d", "p_2d", "__y")), "__all", ["p_3d", "p_2d"], "__y")
    return Stacked(features_3d, features_2d, fit(d, features_3d), fit(d, features_2d), meta)


def score_stacked(df: DataFrame, model: Stacked, out: str = "score") -> DataFrame:
    """Adds the probability of each row under the stack; rows with a NULL feature are left out where it has trees."""
    both = [*model.features_3d, *model.features_2d]
    if model.trees_3d is None:
        return score_logistic(df.withColumn("__all", F.lit(1)), model.coefficients, "__all", both, out).drop("__all")
    d = _probability(model.trees_3d, df.dropna(subset=both).withColumn("__all", F.lit(1)), model.features_3d, "__p3")
    d = _probability(model.trees_2d, d, model.features_2d, "__p2")
    return score_logistic(d, model.coefficients, "__all", ["__p3", "__p2"], out).drop("__all", "__p3", "__p2")


def to_raw_space(coefficients: DataFrame, means: list[float], scales: list[float]) -> DataFrame:
    """Coefficients fitted on standardised features, for raw ones: w / scale, b - sum(w mean / scale)."""
    w = F.transform("weights", lambda v, i: v / F.element_at(F.array(*map(F.lit, scales)), i + 1))
    moved = F.aggregate(F.transform(w, lambda v, i: v * F.element_at(F.array(*map(F.lit, means)), i + 1)), F.lit(0.0), lambda s, v: s + v)
    return coefficients.withColumn("intercept", F.col("intercept") - moved).withColumn("weights", w)


def smooth_coefficients(coefficients: DataFrame, by: str, value: str, low: int = 10, high: int = 60, sigma: float = 1.5) -> DataFrame:
    """A Gaussian mean over neighbouring bins that have a value, at every bin; a bin far from all takes the nearest one.

    Weights reach four sigma and are normalised over the rows of the bins present; rows without a bin take no part.
    Sums per bin meet the grid: the bins within reach of it, and on either side the nearest of those beyond, as no
    other can count.
    """
    spark = coefficients.sparkSession
    reach = int(4 * sigma + 0.5)
    grid = spark.range(low, high + 1).select(F.col("id").cast("int").alias("bin"))
    c = coefficients.select(F.col(by).cast("int").alias("b"), F.col(value).cast("double").alias("v")).dropna(subset=["b"]).filter("v IS NOT NULL")
    c = c.groupBy("b").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    place = F.least(F.greatest(F.col("b"), F.lit(low - reach - 1)), F.lit(high + reach + 1))
    c = c.groupBy(place.alias("place")).agg(F.min_by(F.struct("b", "v", "n"), F.abs(F.col("b") - F.lit((low + high) / 2))).alias("c")).select("c.*")
    pairs = grid.crossJoin(F.broadcast(c)).withColumn("d", F.abs(F.col("bin") - F.col("b")))  # high - low + 2 reach + 3 rows at most
    w = F.when(F.col("d") <= reach, F.exp(-(F.col("d") * F.col("d")) / F.lit(2 * sigma * sigma)))
    near = F.min_by(F.col("v") / F.col("n"), F.struct("d", "b"))
    return pairs.groupBy("bin").agg(F.sum(w * F.col("v")).alias("s"), F.sum(w * F.col("n")).alias("w"), near.alias("nearest")).select("bin", F.coalesce(F.col("s") / F.col("w"), F.col("nearest")).alias("smoothed"))


def coefficients_json(coefficients: DataFrame, by: str) -> DataFrame:
    """One row ``value``: a JSON object of each bin's [intercept, weights...]; rows without a bin are left out."""
    entry = F.struct(F.col(by).cast("string").alias("key"), F.concat(F.array("intercept"), F.col("weights")).alias("value"))
    whole = coefficients.filter(F.col(by).isNotNull()).groupBy().agg(F.sort_array(F.collect_list(entry)).alias("e"))  # a row a bin
    return whole.select(F.to_json(F.map_from_entries("e")).alias("value"))


def coefficients_of_json(text: DataFrame, by: str, column: str = "value") -> DataFrame:
    """(by, intercept, weights) of such a JSON object; the bin comes out as text."""
    e = text.select(F.explode(F.from_json(column, "map<string, array<double>>")).alias(by, "__v"))
    return e.select(by, F.col("__v")[0].alias("intercept"), F.slice("__v", 2, F.greatest(F.size("__v") - 1, F.lit(0))).alias("weights"))


def mean_over_folds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{value}"))
