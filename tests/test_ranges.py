"""Running sums over ranges, and the operators on them, against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions.unit_parse import parse_unit
from affinis.operators import evaluate, models, pairs, ranges
from affinis.session import checkpoint_dir
from affinis.sources.readers import resolve_parquet


def scored(spark, n=3000):
    """One group holds nine tenths of the rows; one has no value, one a single one; NULL is a group."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), rng.choice([None, float("nan"), *[round(rng.random(), 2)] * 8]), rng.random() < 0.3) for _ in range(n)]
    rows += [("none", None, True), ("one", 0.5, True)]
    return rows, spark.createDataFrame(rows, "g string, v double, y boolean")


def values(rows):
    out = {}
    for g, v, y in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append((v, y))
    return out


def test_quantiles_against_numpy(spark):
    rows, df = scored(spark)
    points = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], list(r["q"])) for r in ranges.quantiles(df, ["g"], "v", points).collect()}
    want = {g: (len(v), np.quantile([x for x, _ in v], points)) for g, v in values(rows).items()}
    assert set(got) == set(want)
    for g, (n, q) in want.items():
        assert got[g][0] == n and np.allclose(got[g][1], q)
    assert ranges.quantiles(df.limit(0), ["g"], "v", points).count() == 0


def test_auc_and_precision_against_loops(spark):
    rows, df = scored(spark)
    auc = {r["g"]: r["auc"] for r in evaluate.roc_auc(df, ["g"], F.col("v"), F.col("y")).collect()}
    ap = {r["g"]: r["average_precision"] for r in evaluate.average_precision(df, ["g"], F.col("v"), F.col("y")).collect()}
    for g, v in values(rows).items():
        p, n = [x for x, y in v if y], [x for x, y in v if not y]
        if p and n:
            want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
            assert abs(auc[g] - want) < 1e-9
            cut = [sum(x >= t for x in p) / (sum(x >= t for x in p) + sum(x >= t for x in n)) * p.count(t) / len(p) for t in set(p)]
            assert abs(ap[g] - sum(cut)) < 1e-9
        else:
            assert auc[g] is None


def test_hot_group_is_spread(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("o"), F.lit(1).alias("c"))
    d = ranges.sums_before(df, ["g"], ["o"], ["c"], parts=6)
    assert d.filter("before_c <> o").count() == 0 and d.count() == 5000


def test_quota_of_large_pairs(spark):
    """A pair of many repeated rows, and one that holds most candidates already, are filled like any other."""
    have = [("p1", "t", f"m{i}", "Positive") for i in range(40)] + [("p2", "t", "m0", "Negative")] * 2 + [("p2", "t", "m1", "Positive")] * 30 + [("p3", "t", None, "Positive")]
    candidates = [("t", f"m{i}", 1 + i % 2) for i in range(60)] + [(None, "m1", 1), ("u", "m2", 1)]
    h = spark.createDataFrame(have, "pair string, target string, mol string, set_type string")
    c = spark.createDataFrame(candidates, "target string, mol string, tier int")
    got = {}
    for r in pairs.quota_fill(h, c, "pair", "target", "mol", 10).collect():
        got.setdefault(r["pair"], set()).add(r["mol"])
    assert {p: len(m) for p, m in got.items()} == {"p1": 10, "p2": 8, "p3": 10}
    assert not got["p1"] & {f"m{i}" for i in range(40)} and not got["p2"] & {"m0", "m1"}


def test_folds_of_equal_size(spark):
    for n in (0, 1, 7, 10, 103):
        d = pairs.plain_folds(spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("p")), "p", 10)
        sizes = [0] * 10
        for r in d.groupBy("fold").count().collect():
            sizes[r["fold"] - 1] = r["count"]
        assert sizes == [n // 10 + (i < n % 10) for i in range(10)]


def test_cross_validation_fits_on_other_folds(spark):
    rng = random.Random(2)
    rows = [(i, "b", i % 3, rng.gauss(0, 1), 0) for i in range(240)]
    rows = [(i, b, f, x, int(rng.random() < 1 / (1 + np.exp(-2 * x)))) for i, b, f, x, _ in rows] + [(999, "b", None, 0.0, 1)]
    df = spark.createDataFrame(rows, "id long, b string, fold int, x double, y int")
    got = {r["id"]: r["score"] for r in models.cross_validate(df, "b", "fold", ["x"], "y").collect()}
    assert len(got) == 240
    for f in range(3):
        c = models.fit_logistic_by_group(df.filter(F.col("fold") != f), "b", ["x"], "y").first()
        for i, _, g, x, _ in rows:
            if g == f:
                assert abs(got[i] - 1 / (1 + np.exp(-(c["intercept"] + c["weights"][0] * x)))) < 1e-6


def test_long_readable_unit():
    assert parse_unit("nanomole per" + " " * 30 + "litre", "concentration").factor == parse_unit("nmol/L", "concentration").factor


def test_source_resolver(spark, tmp_path):
    one = spark.range(3)
    one.write.parquet(f"{tmp_path}/a.parquet")
    assert resolve_parquet(spark, str(tmp_path)).endswith("a.parquet")
    one.write.parquet(f"{tmp_path}/b.parquet")
    assert resolve_parquet(spark, str(tmp_path), "b.parquet").endswith("b.parquet")
    for path, preferred in ((tmp_path, "c.parquet"), (tmp_path / "none", None)):
        with pytest.raises(ValueError):
            resolve_parquet(spark, str(path), preferred)


def test_checkpoints_need_a_shared_folder():
    class Conf:
        get = staticmethod(lambda name, other: other)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)
