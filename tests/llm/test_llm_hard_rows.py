"""Every llm operator on NULLs in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from affinis.functions.ids import molecule_key, pair_key, target_of_pair
from affinis.llm import bpe, leaks, overlap, pii, splits, stable_sample, target_sample, topn

CLASHES = (
    "component split n_rows n_label key stratum first_batch key_hash threshold rate b n w e g x class body code rings atoms in_eval eval_row train_row position "
    "masked pieces ids words answer cosine __row __mol __scaffold __eval __k __in __text __g __i __s __h __shard __split __left"
).split()
LONG = "C1CCCCC1" * 4000
META = "row_id bigint, pair_id string, target_chembl_id string, mol_chembl_id string, set_type string, cv_fold int, ha_bin int, time_split string, scaffold_smiles string, batch_no int"
BIG = 9_007_199_254_740_993  # no double holds it


def hard(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in df.columns))


def meta_rows():
    rows = [(i, f"CHEMBL{i // 4}_CHEMBL9{i % 3}", f"CHEMBL9{i % 3}", f"CHEMBL{i // 4}", "Positive" if i % 4 == 0 else "Negative", 1 + i % 10, 10 + i % 5, "Past", "c1ccccc1", 1) for i in range(80)]
    rows += [rows[3], rows[3], rows[7]]
    rows += [(1000 + i, *(None if j == i else v for j, v in enumerate(rows[5][1:]))) for i in range(9)]
    rows += [(BIG, "", "", "", "", 0, 0, "", "", 0), (2001, "x" * 40_000, "t" * 40_000, "m" * 40_000, "Positive", 9, 20, " PAST ", LONG, 2), (2002, None, None, "m" * 40_000, None, 1, None, None, LONG + "N", None)]
    return rows + [(None,) * 10]


@pytest.fixture(scope="module")
def meta(spark):
    return hard(spark, meta_rows(), META).cache()


@pytest.fixture(scope="module", params=["hard", "empty"])
def either(request, meta):
    return meta if request.param == "hard" else meta.limit(0)


def test_splits(spark, either):
    key = pair_key(F.col("pair_id"))
    parts = splits.components(either, key, F.col("row_id"), F.col("set_type") == "Positive", F.col("cv_fold"))
    placed = splits.split_rows(either, key, F.col("row_id"), splits.assign_splits(parts, {"train": 0.8, "test": 0.2}, moves=50, rounds=1)).cache()
    assert placed.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n <> 1").count() == 0
    assert placed.count() == either.count()
    n = either.filter(pair_key(F.col("pair_id")).isNotNull()).count()
    assert placed.filter(F.col("component").startswith("k:")).count() == n
    splits.mixed_folds(placed, F.col("cv_fold")).collect()


def test_stable_sample(either):
    key = pair_key(F.col("pair_id"))
    for options in ({}, {"least": 3}):
        all_ = stable_sample.stable_sample(either, key, target_of_pair, F.col("batch_no"), default_rate=1.0, **options)
        assert all_.count() == either.select(key.alias("k")).filter("k IS NOT NULL").distinct().count()


def test_overlap(spark, either):
    fold = F.col("cv_fold")
    sides = (either, "row_id", molecule_key(F.col("mol_chembl_id")), F.col("scaffold_smiles"), fold.between(9, 10), fold.between(1, 8))
    pairs = overlap.cross_split_overlap(*sides).cache()
    assert overlap.overlap_counts(*sides, {"fold": fold}).agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0] == pairs.count()
    rows = {r[0]: r for r in either.select("row_id", "mol_chembl_id", "scaffold_smiles").collect()}
    for a, b in pairs.collect():
        same = lambda c: rows[a][c] is not None and rows[a][c] == rows[b][c]
        assert same(1) or same(2) or {a, b} == {2001, 2002}
    assert either.count() == 0 or pairs.filter("eval_row = 2001 AND train_row = 2002").count() == 1


def test_target_sample(spark, either):
    columns = {"target_chembl_id": F.col("target_chembl_id"), "cv_fold": F.col("cv_fold")}
    targets = spark.createDataFrame([("target_chembl_id", "CHEMBL90", 0.6, 12), ("target_chembl_id", "*", 0.4, 1), ("cv_fold", "9", 0.9, 30), ("cv_fold", "*", 0.1, 0)], "dimension string, category string, target_share double, min_rows int")
    s = target_sample.target_sample(either, "row_id", columns, targets, 0.25)
    drawn = [r["row_id"] for r in s.rows.collect()]
    assert len(drawn) == int(either.count() * 0.25)
    have = [r[0] for r in either.select("row_id").collect()]
    assert all(drawn.count(i) <= have.count(i) for i in set(drawn))
    assert s.report.count() == 4 and s.report.filter("category = '9' AND fillable").count() == 0


def test_top_n(spark):
    rows = [("a", f"t{i}", 0.5) for i in range(30)] + [("a", "t1", 0.5)] * 3 + [(" a\t", "t9", 0.6), ("", "t1", 1.0), (None, "t1", 1.0), ("b", None, 1.0), ("b", "t", None), ("b", "t", float("nan")), ("b" * 50_000, "t" * 50_000, 0.1), ("c", "t", 7.0)]
    df = hard(spark, rows, "compound string, target string, score double")
    got = topn.top_n(df, "compound", "target", "score", 3, 0.0, 1.0)
    assert sorted((r[0][:1], r[1][:3], r[3]) for r in got.collect()) == [("a", "t0", 2), ("a", "t1", 3), ("a", "t9", 1), ("b", "ttt", 1)]
    assert topn.top_n(df.limit(0), "compound", "target", "score", 3).count() == 0


TEXT = "the seven quiet harbours of the northern coast were closed by thick winter ice for nearly forty long days"


def texts(spark):
    return hard(spark, [(1, None), (2, ""), (3, " \t\n"), (4, TEXT), (4, TEXT), (BIG, TEXT.upper()), (None, TEXT), (5, "word " * 60_000), (6, "퟿́ \U0001f600 <b>")], "doc_id bigint, text string")


def test_large_keys_beside_null(spark, monkeypatch):
    """One batch with a NULL and a key that no double holds: numbers come back as they were."""
    for module in (pii, leaks):
        monkeypatch.setattr(module, "spread", lambda d, *key: d.coalesce(1))
    df = spark.createDataFrame([(BIG, TEXT), (None, TEXT), (1, TEXT)], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(BIG, TEXT), (None, TEXT)], "item_id bigint, text string").coalesce(1)
    assert {r[0] for r in pii.find_pii(df, "doc_id", "text").collect()} == {BIG, None, 1}
    got = leaks.find_leaks(df, "doc_id", "text", items, "item_id", "text").filter("NOT paraphrase").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (BIG, None, 1) for i in (BIG, None)}


def test_tokens(spark):
    got = bpe.encode(texts(spark), "doc_id", "text").collect()
    ids = {r["doc_id"]: r["ids"] for r in got}
    assert len(got) == 9 and ids[1] == ids[2] == [] and ids[4] == ids[None] and len(ids[5]) >= 60_000 and BIG in ids
    assert bpe.encode(texts(spark).limit(0), "doc_id", "text").count() == 0


def test_leaks(spark):
    items = hard(spark, [(7, TEXT), (7, TEXT), (8, TEXT), (9, None), (10, ""), (None, "no words of this item stand in any of the texts that are searched here at all")], "item_id bigint, text string")
    got = leaks.find_leaks(texts(spark), "doc_id", "text", items, "item_id", "text").filter("NOT paraphrase").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (4, BIG, None) for i in (7, 8)}
    assert leaks.find_leaks(texts(spark).limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.find_leaks(texts(spark), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_personal_information(spark):
    got = pii.find_pii(texts(spark), "doc_id", "text").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[1]["masked"] is None and by[1]["pieces"] == [] and by[2]["masked"] == "" and BIG in by and None in by
    assert all(not r["pieces"] for r in got) and len(by[5]["masked"]) == 300_000
    assert pii.find_pii(texts(spark).limit(0), "doc_id", "text").count() == 0
