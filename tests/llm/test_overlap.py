import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinis.functions.ids import molecule_key
from affinis.llm import overlap
from affinis.llm.scaffold_text import atoms, canonical_tokens, elements


def tokens(s):
    return "".join(canonical_tokens(s))


def test_one_writing():
    base = tokens("c1ccccc1CC1CC1")
    for other in (" c1ccccc1CC1CC1\t", "c8ccccc8CC7CC7", "c1ccccc1C[C@H]1CC1", "c1ccccc1CC1CC1.[Na+]", "Cl.c1ccccc1CC1CC1", "C1=CC=CC=C1CC1CC1", "c1ccccc1C[C@@H]1CC1.O"):
        assert tokens(other) == base
    assert tokens("c1cc[nH]c1") != tokens("c1ccnc1")
    assert canonical_tokens(None) == canonical_tokens("") == canonical_tokens(" . ") == []
    assert atoms(canonical_tokens("C(=O)Cl[nH]Br")) == ["C", "O", "Cl", "[nH]", "Br"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(chain, n, rng):
    chain = list(chain)
    for _ in range(n):
        at = rng.randrange(len(chain) + 1)
        what = rng.random()
        if what < 0.4 and chain:
            chain[at % len(chain)] = rng.choice("CNOS")
        elif what < 0.7:
            chain.insert(at, rng.choice("CNO"))
        elif len(chain) > 1:
            del chain[at % len(chain)]
    return chain


@pytest.mark.parametrize("lengths", [(1, 12), (6, 30), (19, 26), (25, 45)])
def test_prefix_join_is_exact(spark, lengths):
    rng = random.Random(lengths[0])
    chains = set()
    for _ in range(60):
        base = [rng.choice("CCCNOcn") for _ in range(rng.randint(*lengths))]
        chains.add("".join(base))
        for n in (1, 2, 3):
            chains.add("".join(changed(base, n, rng)))
    chains = sorted(c for c in chains if c)
    rows = [(" ".join(c), c, i % 3 == 0, i % 3 != 0 or i % 5 == 0) for i, c in enumerate(chains)]
    df = spark.createDataFrame(rows, "atoms string, code string, in_eval boolean, in_train boolean")
    got = {(r[0], r[1]) for r in overlap.near_pairs(df).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] and b[3] and a[0] != b[0] and edits(a[1], b[1]) <= 2}
    assert got == want


def test_places_in_very_long_chains(spark):
    """What tells a chain from others stands beyond the 32,767th atom."""
    tail = "N O S P F I B".split() * 2
    a, b = ["C"] * 32_760 + tail, ["C"] * 32_762 + tail
    rows = [(" ".join(x), "".join(x), e, not e) for x, e in ((a, True), (b, False))]
    df = spark.createDataFrame(rows, "atoms string, code string, in_eval boolean, in_train boolean")
    assert [(len(r[0]), len(r[1])) for r in overlap.near_pairs(df).collect()] == [(len(rows[0][0]), len(rows[1][0]))]


def test_distance_bound():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("AB") for _ in range(rng.randint(1, 9))]
        b = changed(a, rng.randint(0, 4), rng)
        assert overlap._edit_distance(a, b, 2) == min(edits(a, b), 3)


SCHEMA = "row_id long, mol string, scaffold string, fold int, eval_row string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fold = F.col("fold")
    return overlap.cross_split_overlap(df, "row_id", molecule_key(F.col("mol")), F.col("scaffold"), fold.between(9, 10), fold.between(1, 8), {"fold": fold})


def test_rows(spark):
    rows = [
        (1, "CHEMBL1", "c1ccccc1CCCCCCCCCC", 9, "x"), (2, "chembl-1", None, 1, "x"), (3, "ChEMBL 1\n", "", 10, "x"), (4, None, "C2=CC=CC=C2CCCCCCCCCCC.Cl", 2, "x"), (5, None, "c1ccccc1CCCCCCCCCCCCCCCCC", 2, "x"),
        (6, "CHEMBL9", "c1ccccc1CCCCCCCCCC", 11, "x"), (7, "CHEMBL9", "c1ccccc1CCCCCCCCCC", None, "x"), (8, None, "C" * 5000, 9, "x"), (9, None, "C" * 4998 + "N", 1, "x"), (10, None, "  ", 9, "x"), (11, None, "", 1, "x"),
    ]
    got = {(r["eval_row"], r["train_row"]) for r in run(spark, rows).collect()}
    assert got == {(1, 2), (3, 2), (1, 4), (8, 9)}


def test_ring_numbers_stay():
    body = lambda s: elements(canonical_tokens(s))[0]
    far = lambda a, b: overlap._edit_distance(body(a), body(b), 2)
    assert far("C1CCCCC1N", "C1CCCCC1O") == 1 and far("C1CCCCC1N", "C1CCCCCC1N") == 1 and far("C1CCCCC1", "C1CCCCC1=O") == 1
    assert far("C1CCCC1CC", "C1CCCCC1C") == 2  # one atom out of the ring, one into it
    assert far("C1CCCCC1", "CCCCCC") == 3 and far("C1CC1C1CC1", "C1CCC1CC") == 3
    assert far("C1=CCCCC1", "C1CCCCC1") == 1


def counts(spark, rows, split=10):
    df = spark.createDataFrame(rows, SCHEMA)
    fold = F.col("fold")
    return df, (df, "row_id", molecule_key(F.col("mol")), F.col("scaffold"), fold.between(9, 10), fold.between(1, 8))


def test_counts_are_those_of_the_pairs(spark):
    rng = random.Random(4)
    base = ["c1ccccc1CCCCCCCCCC", "C1CCNCC1CC", "C1CC1", "c1ccsc1CCO"]
    rows = []
    for i in range(300):
        s = rng.choice([*base, None, ""])
        if s and rng.random() < 0.5:
            s = s.replace("CC", "CN", 1) if rng.random() < 0.5 else s + "O"
        rows.append((i, rng.choice([f"CHEMBL{rng.randrange(40)}", None]), s, rng.choice([1, 2, 9, 10, 10, None]), rng.choice("xy")))
    df, args = counts(spark, rows)
    groups = {"fold": F.col("fold"), "eval_row": F.col("eval_row")}
    got = {(r["fold"], r["eval_row"]): (r["n_pairs"], r["n_eval_rows"], r["n_train_rows"]) for r in overlap.overlap_counts(*args, groups).collect()}
    pairs = overlap.cross_split_overlap(*args, {"fold": F.col("fold"), "g": F.col("eval_row")}).select("eval_fold", "eval_g", "eval_row", "train_row")
    rows_ = [tuple(r) for r in pairs.collect()]
    assert len(rows_) == len(set(rows_))
    want = {}
    for f, g, e, t in rows_:
        want.setdefault((f, g), []).append((e, t))
    assert got == {k: (len(v), len({e for e, _ in v}), len({t for _, t in v})) for k, v in want.items()}


def test_large_classes(spark):
    """One scaffold in 100,000 rows on either side is counted without its pairs; in blocks every pair comes out once."""
    n = 100_000
    one = lambda k: spark.range(2 * k).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("mol"), F.lit("c1ccccc1CC").alias("scaffold"), F.when(F.col("id") < k, 9).otherwise(1).alias("fold"), F.lit("x").alias("eval_row"))
    fold = F.col("fold")
    args = lambda k: (one(k), "row_id", F.col("mol"), F.col("scaffold"), fold == 9, fold == 1)
    r = overlap.overlap_counts(*args(n), {"fold": fold}).collect()
    assert [(x["n_pairs"], x["n_eval_rows"], x["n_train_rows"]) for x in r] == [(n * n, n, n)]
    pairs = overlap.cross_split_overlap(*args(1500)).agg(F.count(F.lit(1)), F.count_distinct("eval_row", "train_row")).first()
    assert tuple(pairs) == (1500 * 1500, 1500 * 1500)


def test_nothing(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, "CHEMBL1", "CC", 9, None)]).count() == 0


def test_against_all_pairs(spark, data):
    from affinis.llm.queries import p5_found

    m = pd.read_parquet(f"{data}/final_training_meta.parquet")
    m = m[m.cv_fold.between(1, 10)]
    m["mol"] = m.mol_chembl_id.str.upper().str.replace(r"[\s:_\-]+", "", regex=True).str.replace(r"^CHEMBL0+", "CHEMBL", regex=True)
    m["chain"] = [tuple(elements(canonical_tokens(s))[0]) if isinstance(s, str) else () for s in m.scaffold_smiles]
    want = set()
    train = m[m.cv_fold < 9]
    near: dict = {}
    for e in m[m.cv_fold >= 9].itertuples():
        for t in train.itertuples():
            same = isinstance(e.mol, str) and e.mol == t.mol
            if not same and e.chain and t.chain and abs(len(e.chain) - len(t.chain)) <= 2:
                key = (e.chain, t.chain)
                if key not in near:
                    near[key] = overlap._edit_distance(list(e.chain), list(t.chain), 2) <= 2
                same = near[key]
            if same:
                want.add((min(e.row_id, t.row_id), max(e.row_id, t.row_id)))
    assert {tuple(r) for r in p5_found(spark, data).collect()} == want
