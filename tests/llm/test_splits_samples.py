import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions.ids import pair_key
from affinis.llm import splits, stable_sample, target_sample, topn

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
META = "row_id long, pair_id string, set_type string, cv_fold int, component string, split string"


def parts(spark, rows):
    df = spark.createDataFrame(rows, META)
    return splits.components(df, pair_key(F.col("pair_id")), F.col("row_id"), F.col("set_type") == "Positive", F.col("cv_fold"))


def test_pair_spellings(spark):
    forms = ["CHEMBL1_CHEMBL2", "chembl1_chembl2", " CHEMBL1|CHEMBL2", "CHEMBL1 _ CHEMBL2", "CHEMBL1\tCHEMBL2", "CHEMBL1__CHEMBL2  ", "CHEMBL1/chembl2", "CHEMBL1-CHEMBL2", "Chembl1:Chembl2"]
    df = spark.createDataFrame([(f,) for f in [*forms, None, "", "  "]], "p string")
    assert [r[0] for r in df.select(pair_key(F.col("p"))).collect()] == ["CHEMBL1_CHEMBL2"] * len(forms) + [None] * 3


def test_components_and_mixed_folds(spark):
    rows = [
        (1, "CHEMBL1_CHEMBL2", "Positive", 1, "x", "y"), (2, "chembl1|chembl2", "Negative", 2, "x", "y"), (3, "CHEMBL3_CHEMBL2", "Positive", 3, "x", "y"), (4, "CHEMBL3_CHEMBL2", "Negative", 99, "x", "y"),
        (5, None, "Positive", 1, "x", "y"), (6, None, None, None, "x", "y"), (6, None, None, None, "x", "y"), (7, "CHEMBL3_CHEMBL2", "Negative", None, None, None),
    ]
    p = parts(spark, rows)
    assert {r["component"]: r["n_rows"] for r in p.collect()} == {"k:CHEMBL1_CHEMBL2": 2, "k:CHEMBL3_CHEMBL2": 3, "r:5": 1, "r:6": 2}
    a = splits.assign_splits(p, SHARES, moves=50)
    assert a.count() == 4 and {r["split"] for r in a.collect()} <= set(SHARES)
    df = spark.createDataFrame(rows, META).drop("component", "split")
    placed = splits.split_rows(df, pair_key(F.col("pair_id")), F.col("row_id"), a)
    assert placed.count() == len(rows)
    assert [r["key"] for r in splits.mixed_folds(placed, F.col("cv_fold")).collect()] == ["CHEMBL1_CHEMBL2"]
    torn = placed.withColumn("split", F.when(F.col("row_id") == 1, "train").otherwise("test"))
    with pytest.raises(Exception, match="in two splits"):
        splits.mixed_folds(torn, F.col("cv_fold")).collect()


def test_shares_improve_and_repeat(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for c in range(600):
        for i in range(1500 if c == 0 else rng.randint(1, 12)):  # one component holds a fair part of all rows
            rows.append((n, f"CHEMBL{c}_CHEMBL1", "Positive" if i % 6 == 0 else "Negative", 1, None, None))
            n += 1
    p = parts(spark, rows)
    a = splits.assign_splits(p, SHARES, shard_components=150, moves=800)
    r = {x["split"]: x for x in splits.split_report(a, SHARES).collect()}
    assert all(abs(r[s]["share"] - w) < 0.005 for s, w in SHARES.items())
    labels = sum(x["n_label"] for x in r.values())
    assert all(abs(r[s]["n_label"] / labels - w) < 0.01 for s, w in SHARES.items())
    assert a.select("component").distinct().count() == 600 == a.count()
    again = splits.assign_splits(p.repartition(7), SHARES, shard_components=150, moves=800)
    assert {(x["component"], x["split"]) for x in a.collect()} == {(x["component"], x["split"]) for x in again.collect()}


def test_annealing_ends_within_a_component():
    rng = np.random.default_rng(2)
    size = np.c_[rng.integers(1, 15, 9000), rng.integers(0, 2, 9000)].astype(float)
    share = np.array([0.1, 0.8, 0.1])
    want = share[:, None] * size.sum(axis=0)[None, :]
    at, left = splits._anneal(size, rng.choice(3, 9000, p=share), want, 5, 10)
    have = np.zeros_like(want)
    np.add.at(have, at, size)
    assert (np.abs(have - want) <= size.max(axis=0)).all() and abs(splits._deviation(have, want) - left) < 1e-9


def test_splits_of_nothing(spark):
    a = splits.assign_splits(parts(spark, []), SHARES)
    assert a.count() == 0
    assert {r["split"]: r["n_rows"] for r in splits.split_report(a, SHARES).collect()} == dict.fromkeys(SHARES, 0)


def stratum(key):
    """hot for most keys, cold for some, none for those that end in 5."""
    last = F.substring(key, -1, 1)
    return F.when(last == "5", None).when(last.isin("0", "1", "2", "3", "4", "6"), "hot").otherwise("cold")


def draw(df, **kw):
    s = stable_sample.stable_sample(df, F.col("k"), stratum, F.col("b"), **kw)
    return {r["key"] for r in s.collect()}


def test_stable_sample(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.choice([1, 2, 3, None]), "clash") for i in range(800)]
    rows += rows[:100] + [(None, 1, "clash")]
    df = spark.createDataFrame(rows, "k string, b int, stratum string")
    full = draw(df, default_rate=0.2)
    assert full == draw(df.repartition(9).orderBy(F.rand(1)), default_rate=0.2) and 80 < len(full) < 240
    for some in (df.filter("b <= 2"), df.sample(0.5, seed=3), df.filter("b = 3")):
        assert draw(some, default_rate=0.2) <= full
    assert full <= draw(df, default_rate=0.3)
    # thresholds raised to keep five keys a stratum: whole deliveries may be added, earlier choices stay
    chosen = set()
    for upto in (0, 1, 2, 3):
        now = draw(df.filter(F.coalesce("b", F.lit(0)) <= upto), default_rate=0.001, least=5)
        assert chosen <= now
        chosen = now
    assert len(chosen) >= 5 * 3
    high = spark.createDataFrame([("hot", stable_sample.SPACE)], "stratum string, threshold long")
    assert {k for k, _, _ in rows if k and k[-1] in "012346"} <= draw(df, default_rate=0.0, previous=high)
    # a stratum that is listed later, at whatever rate, loses nothing
    for rate in (0.05, 0.4):
        assert full <= draw(df, default_rate=0.2, rates=spark.createDataFrame([("hot", rate)], "stratum string, rate double"))
    assert draw(df.limit(0)) == set()


def test_thresholds_are_remembered(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", 1) for i in range(500)], "k string, b int")
    run = lambda rate: {r["key"] for r in stable_sample.remembered(df, f"{tmp_path}/state", F.col("k"), stratum, F.col("b"), default_rate=rate).collect()}
    first, second, third = run(0.3), run(0.1), run(0.5)
    assert first == second < third


def test_raised_thresholds_against_loops(spark):
    rng = random.Random(8)
    keys = [(f"k{i}", rng.choice("ab"), rng.randrange(6), rng.randrange(1000)) for i in range(60)] + [("x", "c", 3, 7), ("y", "c", 1, 9)]
    got = {r["stratum"]: r["raised"] for r in stable_sample.raised_thresholds(spark.createDataFrame(keys, "key string, stratum string, first_batch long, key_hash long"), 8).collect()}
    for s in "abc":
        most = 0
        for d in sorted({b for _, t, b, _ in keys if t == s}):
            known = sorted(h for _, t, b, h in keys if t == s and b <= d)
            most = max(most, known[: 8][-1] + 1)
        assert got[s] == most


def test_top_n(spark):
    rng = random.Random(3)
    rows = [(rng.choice([" hot", "hot", "hot\t", "a", "b ", None, ""]), rng.choice([f"t{i:02d}" for i in range(30)] + [None]), rng.choice([0.5, 0.25, 0.9, None, float("nan"), 1.5, -0.1]), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows + rows[:99], "g string, i string, s float, position int")
    got = {}
    for r in topn.top_n(df, "g", "i", "s", 5, 0.0, 1.0).collect():
        got.setdefault(r["g"], []).append((r["position"], r["i"]))
    best = {}
    for g, i, s, _ in rows:
        if g and g.strip() and i and s is not None and 0 <= s <= 1:
            key = (g.strip(), i)
            best[key] = max(best.get(key, -1), s)
    for g in {k[0] for k in best}:
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)[:5]
        assert [i for _, i in sorted(got[g])] == [i for _, i in order]
    assert set(got) == {k[0] for k in best}
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0


TARGETS = [("c", "a", 0.5, 3), ("c", "*", 0.5, 1), ("d", "x", 0.9, 2), ("d", "y", 0.1, 40), ("d", "z", 0.0, 5)]
T_SCHEMA = "dimension string, category string, target_share double, min_rows int"


def test_target_sample(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "e", None]), rng.choice(["x"] * 9 + ["y", None, "w"]), "clash") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, c string, d string, n string")
    targets = spark.createDataFrame(TARGETS, T_SCHEMA)
    s = target_sample.target_sample(df, "id", {"c": F.col("c"), "d": F.col("d")}, targets, 0.25)
    drawn = s.rows.collect()
    assert s.size == 1000 == len(drawn) == len({r["id"] for r in drawn})
    share = sum(r["c"] == "a" for r in drawn) / 1000
    assert abs(share - 0.5) < 0.05
    report = {(r["dimension"], r["category"]): r for r in s.report.collect()}
    assert report["d", "y"]["sampled"] >= 40 and not report["d", "z"]["fillable"] and report["c", "a"]["fillable"]
    assert report["c", "*"]["supply"] == sum(r[1] in ("b", "e") for r in rows)
    again = target_sample.target_sample(df.repartition(5), "id", {"c": F.col("c"), "d": F.col("d")}, targets, 0.25)
    assert {r["id"] for r in again.rows.collect()} == {r["id"] for r in drawn}


def test_target_sample_repairs_minimums(spark):
    rows = [(i, "a", "x") for i in range(1000)] + [(1000 + i, None, "y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string, d string")
    s = target_sample.target_sample(df, "id", {"c": F.col("c"), "d": F.col("d")}, spark.createDataFrame(TARGETS, T_SCHEMA), 0.25)
    report = {(r["dimension"], r["category"]): r for r in s.report.collect()}
    assert report["d", "y"]["sampled"] == 40 and s.rows.count() == s.size


def test_raking_reaches_the_size():
    """Unfillable categories are wanted at their supply, the rest of their share goes to the others, and the factors draw the size."""
    want = target_sample.reachable(np.array([0.5, 0.3, 0.2]), np.array([0.0, 0.0, 30.0]), np.array([1000.0, 10.0, 500.0]), 100)
    assert want[1] == 10 and abs(want.sum() - 100) < 1e-6 and want[2] >= 30
    rng = np.random.default_rng(1)
    codes, n = [rng.integers(0, 3, 200), rng.integers(0, 4, 200)], rng.integers(1, 50, 200).astype(float)
    margin = target_sample.local_margins(codes, n, [4, 5])
    size = float(int(n.sum() / 4))
    wants = [np.r_[target_sample.reachable(np.array(s), np.zeros(len(s)), np.bincount(c, n, len(s)), size), 0.0] for s, c in (([0.6, 0.3, 0.1], codes[0]), ([0.1, 0.2, 0.3, 0.4], codes[1]))]
    factor, expected = target_sample.rake(margin, wants, size)
    assert abs(expected - size) < 0.01 * size
    for d in (0, 1):
        assert np.abs(margin(d, factor) - wants[d]).max() < 0.02 * size


def test_raking_by_spark_is_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "b", "e"]), rng.choice(["x"] * 5 + ["y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, d string")
    targets = spark.createDataFrame([t for t in TARGETS if t[1] != "z"], T_SCHEMA)
    columns = {"c": F.col("c"), "d": F.col("d")}
    here = {r["id"] for r in target_sample.target_sample(df, "id", columns, targets, 0.25).rows.collect()}
    monkeypatch.setattr(target_sample, "LOCAL_CELLS", 0)
    monkeypatch.setattr(target_sample, "IPF_ROUNDS", 30)
    there = {r["id"] for r in target_sample.target_sample(df, "id", columns, targets, 0.25).rows.collect()}
    assert len(here) == len(there) == 150 and len(here & there) >= 148


def test_scarce_weights_are_drawn_by_weight(spark):
    """Far beyond the first key, heavy rows still come before light ones more often than not: no key is cut off."""
    rows = [(i, "a" if i < 200 else "b") for i in range(4000)]
    targets = spark.createDataFrame([("c", "a", 0.5, 0), ("c", "b", 0.5, 0)], T_SCHEMA)
    s = target_sample.target_sample(spark.createDataFrame(rows, "id long, c string"), "id", {"c": F.col("c")}, targets, 0.9)
    got = [r["c"] for r in s.rows.collect()]
    assert len(got) == 3600 and got.count("a") == 200 and abs(s.expected - 3600) < 1


def test_target_sample_of_nothing(spark):
    df = spark.createDataFrame([], "id long, c string, d string")
    s = target_sample.target_sample(df, "id", {"c": F.col("c"), "d": F.col("d")}, spark.createDataFrame(TARGETS, T_SCHEMA))
    assert s.rows.count() == 0 and not any(r["fillable"] for r in s.report.collect() if r["min_rows"])
