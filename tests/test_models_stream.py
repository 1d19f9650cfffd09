import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import evaluate, models
from affinis.operators.similarity import Params
from affinis.plans import catalog
from affinis.streaming.scoring import score_arrivals


def stack_rows(spark, n):
    rng = np.random.default_rng(3)
    x = rng.random((n, 2))
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 0.2, n) > 1).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int").coalesce(2)


def test_stacked_model_ranks(spark):
    df = stack_rows(spark, 600)
    m = models.fit_stacked(df, "id", ["a"], ["b"], "y", iterations=3)
    r = m.coefficients.first()
    assert m.trees_3d.numFeatures == m.trees_2d.numFeatures == 1 and r["fitted"] and min(r["weights"]) > 0
    scored = models.score_stacked(df.unionByName(spark.createDataFrame([(-1, None, 0.5, 1)], df.schema)), m)
    assert scored.count() == 600 and evaluate.roc_auc(scored, [], F.col("score"), F.col("y") == 1).first()["auc"] > 0.9


@pytest.mark.parametrize("case", ["few rows", "one class", "no rows"])
def test_stack_without_trees(spark, case):
    df = {"few rows": stack_rows(spark, 39), "one class": stack_rows(spark, 200).withColumn("y", F.lit(1)), "no rows": stack_rows(spark, 20).limit(0)}[case]
    m = models.fit_stacked(df, "id", ["a"], ["b"], "y", iterations=3)
    assert m.trees_3d is None and m.trees_2d is None
    scored = models.score_stacked(df, m).collect()
    if case == "few rows":
        assert m.coefficients.first()["fitted"] and len(scored) == 39 and all(0 < r["score"] < 1 for r in scored)
    if case == "one class":
        assert not m.coefficients.first()["fitted"]


def test_models_fitted_together_are_those_fitted_alone(spark):
    df = stack_rows(spark, 300).select("*", (F.col("id") % 3).cast("int").alias("fold"), F.lit("g").alias("g"))
    sets = {"both": ["a", "b"], "only a": ["a"], "only b": ["b"]}
    joint = {(r["model"], r["id"]): r["score"] for r in models.cross_validate_models(df, "g", "fold", sets, "y").collect()}
    assert len(joint) == 900
    for name, features in sets.items():
        for r in models.cross_validate(df, "g", "fold", features, "y").collect():
            assert abs(joint[name, r["id"]] - r["score"]) < 1e-7


def test_coefficients_as_json(spark):
    df = spark.createDataFrame([(10, -1.5, [2.0, 3.0]), (11, 0.0, [0.25, 1e-9]), (None, 1.0, [1.0])], "ha_bin int, intercept double, weights array<double>")
    back = models.coefficients_of_json(models.coefficients_json(df, "ha_bin"), "ha_bin").collect()
    assert sorted(tuple(r) for r in back) == [("10", -1.5, [2.0, 3.0]), ("11", 0.0, [0.25, 1e-9])]
    assert models.coefficients_of_json(models.coefficients_json(df.limit(0), "ha_bin"), "ha_bin").count() == 0


def test_out_of_fold_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = (x + rng.normal(0, 0.5, 400) > 0).astype(int)
    df = spark.createDataFrame([("g", i % 3, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, fold int, x double, y int")
    scored = models.cross_validate(df, "g", "fold", ["x"], "y")
    assert scored.count() == 400
    assert evaluate.roc_auc(scored, ["g"], F.col("score"), F.col("y") == 1).first()["auc"] > 0.85


def test_unfinished_fits_are_told(spark):
    rows = [("g", float(i % 10), int(i % 10 + i % 3 > 5)) for i in range(90)] + [("one class", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y int").coalesce(2)
    fits = {n: {r["g"]: r["converged"] for r in models.fit_logistic_by_group(df, "g", ["x"], "y", rounds=n).collect()} for n in (2, 25)}
    assert fits == {2: {"g": False, "one class": False}, 25: {"g": True, "one class": False}}


def smooth(rows, low=10, high=60, sigma=1.5):
    """{bin: Gaussian mean of the rows (bin, value) within four sigma, or the mean value of the nearest bin}."""
    out = {}
    for k in range(low, high + 1):
        near = [(np.exp(-((k - b) ** 2) / (2 * sigma**2)), v) for b, v in rows if abs(k - b) <= int(4 * sigma + 0.5)]
        closest = min((abs(k - b), b) for b, _ in rows)[1]
        out[k] = sum(w * v for w, v in near) / sum(w for w, _ in near) if near else np.mean([v for b, v in rows if b == closest])
    return out


def test_every_bin_is_smoothed(spark, tmp_path):
    """Bins that 3 does not divide count too; 13 and 40 lie so far apart that the bins between take the nearest."""
    rows = [(10, 2.0), (10, 4.0), (11, 50.0), (12, float("nan")), (13, 7.0), (40, 9.0), (41, None), (43, 1.0), (59, 30.0), (None, 1e6)]
    spark.createDataFrame(rows, "ha_bin int, activity_um double").write.parquet(f"{tmp_path}/final_training_meta.parquet")
    want = smooth([(10, 3.0), (11, 50.0), (13, 7.0), (40, 9.0), (43, 1.0), (59, 30.0)])
    got = {r["bin"]: r["smoothed"] for r in catalog.QUERIES["coef_smooth"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("chosen", [range(-200, 200), [-50, 100, 130], [-7, 9, 64, 66, 67], [61] * 3])
def test_smoothing_takes_all_rows(spark, chosen):
    rows = [(b, float(b % 7 + i)) for b in chosen for i in range(2)]
    df = spark.createDataFrame([*rows, (None, 1e6)], "b int, v double")
    got = {r["bin"]: r["smoothed"] for r in models.smooth_coefficients(df, "b", "v").collect()}
    want = smooth(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_arrivals_are_scored(spark, tmp_path):
    rows = [(i, i % 2, [i * 7 + 1, i], [[float(i), 1.0]], str(i), i, 0, 20) for i in range(12)]
    schema = "id long, target long, bits array<long>, conformers array<array<double>>, scaffold string, fold int, assay int, heavy_atoms int"
    df = spark.createDataFrame(rows, schema)
    df.filter("id < 4").drop("target").withColumnRenamed("id", "query_id").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    actives = df.withColumnRenamed("id", "active_id")
    targets = spark.createDataFrame([(0, 0), (1, 1)], "target long, target_index long")
    coefficients = spark.createDataFrame([(20, -1.0, 1.0, 1.0)], "ha_bin int, intercept double, w_3d double, w_2d double")
    out = str(tmp_path / "out")
    q = score_arrivals(spark, source, actives, targets, coefficients, Params(dims=2), lambda d, i: d.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "check"))
    q.awaitTermination(150)
    got = spark.read.parquet(out).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(i, r) for i in range(4) for r in (1, 2)]
