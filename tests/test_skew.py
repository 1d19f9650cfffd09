import random

from affinis.operators.skew import key_statistics


def test_against_plain_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([f"p{i}" for i in range(40)] + [None]), rng.choice(["m1", "m2", "m3"]), rng.choice([1.5, 2.0, None, float("nan")]), "clash") for _ in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, p string, m string, v double, key string")
    got = {r["key"]: r for r in key_statistics(df, "k", {"n_p": "p", "n_m": "m"}, "v", 0.3, partitions=7).collect()}
    keys = {r[0] for r in rows} - {None}
    assert set(got) == keys
    total = sum(r[0] is not None for r in rows)
    for k in keys:
        own = [r for r in rows if r[0] == k]
        values = [r[3] for r in own if r[3] is not None and r[3] == r[3]]
        assert got[k]["n_rows"] == len(own)
        assert got[k]["n_p"] == len({r[1] for r in own} - {None})
        assert got[k]["n_m"] == len({r[2] for r in own})
        assert got[k]["n_measured"] == len(values) and abs(got[k]["sum_measured"] - sum(values)) < 1e-6
        assert (got[k]["min_measured"], got[k]["max_measured"]) == (min(values), max(values))
        assert got[k]["is_heavy"] == (len(own) >= 0.3 * total)


def test_empty_and_null(spark):
    schema = "k string, p string, v double"
    assert key_statistics(spark.createDataFrame([], schema), "k", {"n_p": "p"}, "v").count() == 0
    r = key_statistics(spark.createDataFrame([("a", None, None), (None, "p", 1.0)], schema), "k", {"n_p": "p"}, "v").collect()
    assert [(x["key"], x["n_rows"], x["n_p"], x["n_measured"], x["min_measured"]) for x in r] == [("a", 1, 0, 0, None)]
