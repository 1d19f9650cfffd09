"""Hand-made cases of the reference's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import bins
from affinis.functions.descriptors import shape_moments
from affinis.functions.similarity import pack_bits, popcount, shape_similarity, tanimoto
from affinis.operators import calibrate, curate, evaluate, models, pairs
from affinis.operators.similarity import Params, keep_rule, loo_scores, similarity_candidates, topk_features
from affinis.schema import require_columns


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_units_and_labels(spark):
    df = spark.createDataFrame([(1000.0, "nM"), (5.0, " uM "), (2.0, "pM"), (3.0, "mM"), (1.0, "mg"), (None, "nM"), (float("nan"), "nM")], "v double, u string")
    assert [r[0] for r in df.select(bins.micromolar(F.col("v"), F.col("u"))).collect()] == [1.0, 5.0, 2e-6, 3000.0, None, None, None]
    lab = spark.createDataFrame([(9.99,), (10.0,), (499.9,), (500.0,), (None,)], "v double")
    assert [r[0] for r in lab.select(bins.activity_label(F.col("v"))).collect()] == ["Active", "Ambiguous", "Ambiguous", "Inactive", "Ambiguous"]


def test_size_bins(spark):
    df = spark.createDataFrame([(15,), (16,), (40,), (41,), (None,)], "h int")
    assert [r[0] for r in df.select(bins.size_bin(F.col("h"))).collect()] == ["01_15", "16_20", "36_40", "41_plus", "41_plus"]


def test_tanimoto_and_bits(spark):
    a, b = pack_bits(F.array(F.lit(1), F.lit(2), F.lit(3))), pack_bits(F.array(F.lit(2), F.lit(3), F.lit(4)))
    none = F.array(*(F.lit(0).cast("long") for _ in range(16)))
    assert one(spark, tanimoto(a, b)) == 0.5 and one(spark, tanimoto(none, none)) == 0.0
    assert one(spark, popcount(pack_bits(F.array(F.lit(64), F.lit(1024), F.lit(64))))) == 2


def test_shape_similarity(spark):
    x, y = F.array(F.array(*(F.lit(0.0) for _ in range(18)))), F.array(F.array(*(F.lit(1.0) for _ in range(18))))
    assert one(spark, shape_similarity(x, x)) == 1.0 and one(spark, shape_similarity(x, y)) == 0.5


def test_normalise(spark):
    assert math.isclose(one(spark, bins.threshold_normalised(F.lit(0.65), 0.30)), 0.5)
    assert one(spark, bins.threshold_normalised(F.lit(0.20), 0.30)) == 0.0


POLICY = {"paired_sum": (0.7, 0.4), "independent": (0.7, 0.9), "paired_2d": (0.1, 0.9)}


@pytest.mark.parametrize("policy", POLICY)
def test_policies(spark, policy):
    c = spark.createDataFrame([(1, 1, 10, 0.9, 0.1, 0.9, 0.1), (1, 1, 11, 0.4, 0.7, 0.4, 0.7)], "query_id long, target long, active_id long, raw_2d double, raw_3d double, sim_2d double, sim_3d double")
    r = topk_features(c, Params(k=1, policy=policy)).first()
    assert (r["sims_3d"][0], r["sims_2d"][0]) == POLICY[policy]
    r = topk_features(c.filter("active_id = 10"), Params(k=3, policy=policy)).first()
    assert r["sims_2d"] == [0.9, 0.0, 0.0]


def _molecules(spark, n=30):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [int(x) for x in rng.integers(0, 2**40, 2)], [[float(v) for v in rng.random(4)] for _ in range(i % 3)], str(i % 4) if i % 5 else None, i % 6, i % 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, target long, bits array<long>, conformers array<array<double>>, scaffold string, fold int, assay int")


@pytest.mark.parametrize("block", [4, 512])
@pytest.mark.parametrize("same", [True, False])
def test_similarity_join_against_loops(spark, block, same):
    rows, df = _molecules(spark)
    p = Params(k=2, policy="paired_sum", mask_scaffold=True, mask_fold=True, dims=4, block=block)
    q = df.withColumnRenamed("id", "query_id")
    a = df.select(*(F.col(c).alias("active_id" if c == "id" else c) for c in df.columns))
    got = {(r["query_id"], r["target"]): r for r in topk_features(similarity_candidates(q if same else q.drop("target"), a, p, same), p).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] or y[4] is None or x[4] == y[4] or x[5] == y[5] or (same and x[1] != y[1]):
                continue
            inter = sum((u & v).bit_count() for u, v in zip(x[2], y[2]))
            union = sum((u | v).bit_count() for u, v in zip(x[2], y[2]))
            d = min((sum(abs(s - t) for s, t in zip(u, v)) for u in x[3] for v in y[3]), default=None)
            want.setdefault((x[0], y[1]), []).append((inter / union if union else 0.0, 1 / (1 + d / 4) if d is not None else 0.0, y[0]))
    assert set(got) == set(want)
    for k, v in want.items():
        top = sorted(v, key=lambda s: (-round(s[0] + s[1], 9), s[2]))[:2] + [(0.0, 0.0, -1)] * 2
        assert np.allclose(got[k]["sims_2d"], [s[0] for s in top[:2]]) and np.allclose(got[k]["sims_3d"], [s[1] for s in top[:2]])
        assert math.isclose(got[k]["max_2d"], max(s[0] for s in v)) and math.isclose(got[k]["max_3d"], max(s[1] for s in v))


def test_rank_ties_and_keep(spark):
    f = spark.createDataFrame([(1, 0, [0.0], [0.0], 0.0, 0.0), (1, 1, [0.0], [0.0], 0.0, 0.0), (1, 2, [1.0], [1.0], 1.0, 1.0)], "query_id long, target long, sims_3d array<double>, sims_2d array<double>, max_2d double, max_3d double")
    q = spark.createDataFrame([(1, 99)], "query_id long, heavy_atoms int")
    t = spark.createDataFrame([(i, i) for i in range(4)], "target long, target_index long")
    c = spark.createDataFrame([(60, 0.0, 1.0, 1.0)], "ha_bin int, intercept double, w_3d double, w_2d double")
    ranked = loo_scores(f, q, t, c)
    assert {r["target"]: r["rank"] for r in ranked.collect()} == {2: 1, 0: 2, 1: 3, 3: 4}
    assert sorted(r["target"] for r in keep_rule(ranked, 1, 0.5).collect()) == [0, 1, 2]


def test_hit_rate(spark):
    s = spark.createDataFrame([("a", 1), ("a", 7), ("a", None)], "size_bin string, best_true_rank long")
    r = {(x["cutoff"], x["size_bin"]): x["hit_rate"] for x in evaluate.hit_rates(s, (5,)).collect()}
    assert math.isclose(r[(5, "ALL")], 1 / 3)


def test_half_even_quota(spark):
    g = spark.createDataFrame([(f"p{i}", "x") for i in range(5)] + [("q", None)], "g string, s string")
    assert pairs.stratified_subset(g, "g", ["s"], 0.5, 1).filter("s = 'x'").count() == 2
    assert pairs.stratified_subset(g, "g", ["s"], 0.2, 1).filter("s IS NULL").count() == 1


def test_weights(spark):
    df = spark.createDataFrame([(1,)] + [(0,)] * 10, "y int")
    assert {r["y"]: round(r["weight"], 9) for r in pairs.class_weights(df, "y").collect()} == {1: 5.5, 0: 0.55}


def test_pair_rule(spark):
    df = spark.createDataFrame([("p", "t", 1, "Positive")] + [("p", "t", 1, "Negative")] * 6, "pair_id string, target string, cv_fold int, set_type string")
    r = pairs.pair_metrics(df, "pair_id", "target", "cv_fold", 7, 10).first()
    assert (r["rows_below"], r["negatives_below"], r["positives_not_one"]) == (1, 1, 0)
    with pytest.raises(ValueError, match="negatives_below"):
        pairs.assert_pairs(df, "load", pair="pair_id", target="target", min_neg=7, max_neg=10)


def test_js_distance(spark):
    a, b = spark.createDataFrame([("x",)], "v string"), spark.createDataFrame([("y",)], "v string")
    assert evaluate.js_distance(evaluate.distribution_compare(a, a, "v")).first()[0] < 1e-6
    assert math.isclose(evaluate.js_distance(evaluate.distribution_compare(a, b, "v")).first()[0], math.sqrt(math.log(2)), rel_tol=1e-4)


def test_auc_against_definition(spark):
    rng = np.random.default_rng(4)
    rows = [("g", float(rng.integers(0, 8)), bool(rng.integers(0, 2))) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert math.isclose(evaluate.roc_auc(df, ["g"], F.col("s"), F.col("y")).first()["auc"], want)


def test_moments_do_not_move():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 5))
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    y = x.copy()
    y[:, :3] = x[:, :3] @ turn.T + 5
    assert np.abs(shape_moments(x) - shape_moments(y)).max() < 1e-9 and shape_moments(x).shape == (18,)


def test_logistic_recovers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - 2 * x[:, 1])))
    df = spark.createDataFrame([("a", float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [("b", 0.0, 0.0, 1)], "g string, x double, z double, y int")
    r = {v["g"]: v for v in models.fit_logistic_by_group(df, "g", ["x", "z"], "y", 1e6).collect()}
    assert abs(r["a"]["weights"][0] - 1.5) < 0.2 and abs(r["a"]["weights"][1] + 2) < 0.2
    assert (r["b"]["intercept"], r["b"]["weights"], r["b"]["fitted"]) == (-5.0, [3.0, 7.0], False)


def test_curve_fit_recovers(spark):
    pts = [("a", float(x), 1 / (1 + math.exp(-(-2 + 0.8 * x))), 1.0) for x in np.linspace(0, 6, 50)]
    df = spark.createDataFrame(pts, "b string, x double, y double, w double")
    r = calibrate.fit_curves(df, "b", "x", "y", "w", (0.0, 1.0), ((-20.0, 20.0), (0.0, 20.0))).first()
    assert abs(r["intercept"] + 2) < 1e-6 and abs(r["slope"] - 0.8) < 1e-6


def test_conflicts(spark):
    df = spark.createDataFrame([("m", "t", "Active"), ("m", "t", "Ambiguous"), ("n", "t", "Active"), ("n", "t", "Inactive")], "m string, t string, label string")
    assert curate.without_conflicts(df, ["m", "t"]).count() == 1
    assert curate.without_conflicts(df, ["m", "t"], strict=True).count() == 0


def test_group_folds_balance(spark):
    df = spark.createDataFrame([(f"g{i % 97}",) for i in range(5000)] + [("big",)] * 900, "g string")
    f = pairs.group_folds(df, ["g"], 5).groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()
    assert len(f) == 5 and max(r["n"] for r in f) < 1.3 * 5900 / 5


def test_require(spark):
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.range(1), ["id", "nope"], "here")


def test_short_pairs_draw_again(spark):
    """Targets that nearly all molecules are known for: whoever can have ten negatives gets them, whoever cannot gets none."""
    allowed = {"nine": 9, "ten": 10, "own": 11, "fifteen": 15, "half": 200, "free": 400}  # of 400 molecules
    positives = [(m, t) for t in allowed for m in range(0, 400, 20)]
    # the positive itself is blocked, as in the data, but for the target "own", whose positives are allowed ones
    positives = [(m, t) for m, t in positives if t != "own"] + [(m, "own") for m in (389, 399)] + [(3, "own"), (None, "ten"), (3, None)]
    blocked = [(m, t) for t, n in allowed.items() for m in range(400 - n)]
    p = spark.createDataFrame(positives, "m long, t string")
    mols, b = spark.range(400).select(F.col("id").alias("m")), spark.createDataFrame(blocked, "m long, t string")
    got = {}
    for r in pairs.sample_negatives(p, mols, b, "m", "t", 10, 400 // 12, 3).collect():
        got.setdefault((r["pair_id"], r["t"]), []).append((r["rank"], r["m"]))
    # "own": two positives leave ten others each, and positive 3 has eleven to choose from
    assert set(got) == {(f"{m}_{t}", t) for m, t in positives if m is not None and t not in (None, "nine")}
    for (pair_id, t), found in got.items():
        assert sorted(r for r, _ in found) == list(range(1, 11)) and len({m for _, m in found}) == 10
        assert all(m >= 400 - allowed[t] and f"{m}_{t}" != pair_id for _, m in found)
