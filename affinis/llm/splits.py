"""Splits that keep related records together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.session import cut_lineage

#: Components that one annealing task holds at most, about: the number of shards follows from it.
SHARD_COMPONENTS = 20_000
#: Parallel runs of each shard from differently salted starts, of which the best is kept.
REPLICAS = 3
#: Moves tried while cooling for each run and round: so many at least, and so many for each component of the shard.  Then
#: passes over all components go on, cold, until one gains nothing; a run ends earlier where it is nearer to the target
#: than its smallest component.
MOVES, PASSES = 3_000, 6
ROUNDS = 2


def components(df: DataFrame, key: Column, row: Column, label: Column, fold: Column, folds: tuple[int, int] = (1, 10)) -> DataFrame:
    """One row per component: ``component``, ``n_rows``, ``n_label`` (rows with the label), ``fold_low``, ``fold_high``.

    A component is all rows of one key; a row with a NULL key is a component of its own, named by ``row``, and rows with
    neither are one component.  Folds outside ``folds`` do not count.
    """
    valid = F.when(fold.between(*folds), fold)
    return (
        df.select(component_name(key, row).alias("component"), label.cast("long").alias("y"), valid.alias("f"))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_label"), F.min("f").alias("fold_low"), F.max("f").alias("fold_high"))
    )


def _deviation(have: np.ndarray, want: np.ndarray) -> float:
    """Sum over splits and measures (rows, labelled rows) of the deviation relative to the whole."""
    return float((np.abs(have - want) / np.maximum(want.sum(axis=0), 1.0)).sum())


def _anneal(size: np.ndarray, start: np.ndarray, want: np.ndarray, seed: int, moves: int) -> tuple[np.ndarray, float]:
    """Moves or exchanges whole components between splits; returns the best assignment seen and its deviation.

    size: components x (rows, labelled rows); want: splits x the same measures.
    """
    rng = np.random.default_rng(seed)
    n, k = len(size), len(want)
    at = start.copy()
    have = np.zeros_like(want)
    np.add.at(have, at, size)
    scale = 1.0 / np.maximum(want.sum(axis=0), 1.0)
    now = best = _deviation(have, want)
    kept = at.copy()
    if n < 2 or k < 2:
        return kept, best
    rows, labels = size[:, 0].tolist(), size[:, 1].tolist()
    off = (have - want).tolist()  # plain numbers: the steps are small
    place = at.tolist()
    by_rows, by_labels = scale.tolist()
    heat = 2 * float((size * scale).sum(axis=1).mean())  # what moving a usual component changes
    moves = max(moves, PASSES * n)
    enough = float((size * scale).sum(axis=1).min())  # nothing smaller than a component can be moved
    trail: list[tuple[int, int]] = []  # changes since the best
    first, gained = 0, True
    while best >= enough and (first < moves or gained):
        if first >= moves and trail:  # cold from here on, from the best seen
            place, trail = kept.tolist(), []
            have = np.zeros_like(want)
            np.add.at(have, kept, size)
            off, now = (have - want).tolist(), best
        m = min(n, moves - first) if first < moves else n
        one, two, to = rng.permutation(n)[:m].tolist(), rng.integers(0, n, m).tolist(), rng.integers(0, k, m).tolist()
        swap, luck = (rng.random(m) < 0.5).tolist(), rng.random(m).tolist()
        before = best
        for step in range(m):
            i = one[step]
            a = place[i]
            j = two[step] if swap[step] else -1
            b = place[j] if j >= 0 else to[step]
            if a == b:
                continue
            dr, dl = (rows[j] - rows[i], labels[j] - labels[i]) if j >= 0 else (-rows[i], -labels[i])
            p, q = off[a], off[b]
            change = (abs(p[0] + dr) - abs(p[0]) + abs(q[0] - dr) - abs(q[0])) * by_rows + (abs(p[1] + dl) - abs(p[1]) + abs(q[1] - dl) - abs(q[1])) * by_labels
            warm = heat * max(0.0, 1 - (first + step) / moves) ** 3
            if change <= 0 or luck[step] < math.exp(-change / (warm + 1e-12)):
                off[a], off[b] = [p[0] + dr, p[1] + dl], [q[0] - dr, q[1] - dl]
                place[i] = b
                trail.append((i, b))
                if j >= 0:
                    place[j] = a
                    trail.append((j, a))
                now += change
                if now < best - 1e-12:
                    best = now
                    for c, s in trail:
                        kept[c] = s
                    trail.clear()
        first, gained = first + m, best < before
    return kept, best


def assign_splits(parts: DataFrame, shares: dict[str, float], salt: str = "affinis-split-1", shard_components: int = SHARD_COMPONENTS, replicas: int = REPLICAS, moves: int = MOVES, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``split`` to a component table so that rows and labelled rows follow ``shares``.

    Component swap search: components start in the split of their hash, in shards of bounded size; every shard is
    annealed in parallel from several salted starts by moving and exchanging whole components, and its best run is
    kept.  After a round the deviation left over all shards (a few numbers) is spread over the shards' targets of the
    next round, so that shards make up for one another, and for a component too large for any other split.

    Components stay whole by construction.  No components give no rows.  The result depends on component names, sizes
    and the salt only.
    """
    names = sorted(shares)
    share = np.array([shares[s] for s in names], float)
    share /= share.sum()
    base = parts.select(*parts.columns, F.xxhash64(F.lit(salt), "component").alias("__h"))
    base = cut_lineage(base)
    n = base.count()
    shards = max(1, -(-n // shard_components))
    base = base.withColumn("__shard", F.pmod("__h", F.lit(shards)).cast("int"))
    totals = np.array(base.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("n_label"), F.lit(0))).first(), float)
    goal = share[:, None] * totals[None, :]
    edges = np.cumsum(share)[:-1]

    def run(correction: np.ndarray, round_no: int):
        def anneal(keys: tuple, d: pd.DataFrame) -> pd.DataFrame:
            shard, replica = keys
            d = d.sort_values("component", kind="stable").reset_index(drop=True)
            size = d[["n_rows", "n_label"]].to_numpy(float)
            # the salted start: the hash, turned by the replica, cut at the cumulated shares
            turned = (d["__h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
            start = np.searchsorted(edges, (turned + replica * 0.61803398875) % 1.0, side="right")
            mine = size.sum(axis=0)
            want = share[:, None] * mine[None, :] - correction * (mine / np.maximum(totals, 1.0))[None, :]
            at, left = _anneal(size, start, want, seed=(round_no * 1_000_003 + int(shard)) * 101 + int(replica), moves=moves)
            return pd.DataFrame({"component": d["component"], "__split": at.astype("int32"), "__left": left, "__shard": shard, "__replica": replica})

        schema = T.StructType(
            [T.StructField("component", T.StringType()), T.StructField("__split", T.IntegerType()), T.StructField("__left", T.DoubleType()), T.StructField("__shard", T.IntegerType()), T.StructField("__replica", T.IntegerType())]
        )
        many = base.select("component", "n_rows", "n_label", "__h", "__shard", F.explode(F.array(*(F.lit(i) for i in range(replicas)))).alias("__replica"))
        tried = cut_lineage(many.groupBy("__shard", "__replica").applyInPandas(anneal, schema))
        best = tried.groupBy("__shard").agg(F.min_by("__replica", F.struct("__left", "__replica")).alias("__replica"))
        return tried.join(best, ["__shard", "__replica"], "left_semi").select("component", F.col("__split"))

    correction = np.zeros_like(goal)
    found, found_left = None, np.inf
    for round_no in range(rounds):
        chosen = base.join(run(correction, round_no), "component")
        have = np.zeros_like(goal)
        for r in chosen.groupBy("__split").agg(F.sum("n_rows").alias("a"), F.sum("n_label").alias("b")).collect():  # one row a split
            have[r["__split"]] = r["a"], r["b"]
        left = _deviation(have, goal)
        if left < found_left:
            found, found_left = chosen, left
        if left < 1e-6:
            break
        correction = correction + (have - goal)
    label = F.lit(None).cast("string")
    for i, s in enumerate(names):
        label = F.when(F.col("__split") == i, F.lit(s)).otherwise(label)
    return found.withColumn("split", label).drop("__split", "__h", "__shard")


def split_report(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Rows, labelled rows and components of each split against its share; splits without rows are listed too."""
    spark = assigned.sparkSession
    want = spark.createDataFrame(sorted(shares.items()), "split string, target_share double")
    have = assigned.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_label").alias("n_label"), F.count(F.lit(1)).alias("n_components"))
    every = have.agg(F.sum("n_rows").alias("all_rows"))
    out = want.join(have, "split", "left").crossJoin(F.broadcast(every)).na.fill(0, ["n_rows", "n_label", "n_components"])
    return out.select("split", "target_share", "n_rows", "n_label", "n_components", (F.col("n_rows") / F.col("all_rows")).alias("share"))


def component_name(key: Column, row: Column) -> Column:
    """The component of a row: its key, or the row itself where the key is NULL; never NULL."""
    return F.coalesce(F.concat(F.lit("k:"), key), F.concat(F.lit("r:"), F.coalesce(row.cast("string"), F.lit(""))))


def split_rows(df: DataFrame, key: Column, row: Column, assigned: DataFrame) -> DataFrame:
    """The rows with ``component`` and ``split``, as the assignment of their component says; columns of these names are replaced."""
    named = df.withColumn("component", component_name(key, row)).drop("split")
    return named.join(assigned.select("component", "split"), "component")


def mixed_folds(rows: DataFrame, fold: Column, folds: tuple[int, int] = (1, 10)) -> DataFrame:
    """(key, split, fold_low, fold_high, n_rows) of keys whose rows stood in more than one valid fold and now stand in one split.

    ``rows`` come from ``split_rows``; a key that the assignment left in two splits is an error and raises.
    """
    valid = F.when(fold.between(*folds), fold)
    g = rows.filter(F.col("component").startswith("k:")).groupBy("component").agg(
        F.min("split").alias("split"), F.max("split").alias("__other"), F.min(valid).alias("fold_low"), F.max(valid).alias("fold_high"), F.count(F.lit(1)).alias("n_rows")
    )
    whole = F.when(F.col("split") == F.col("__other"), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("in two splits: "), F.col("component"))))
    return g.withColumn("split", whole).filter("split IS NOT NULL AND fold_low < fold_high").select(F.substring("component", 3, 1 << 30).alias("key"), "split", "fold_low", "fold_high", "n_rows")


def read_shares(targets: DataFrame) -> dict[str, float]:
    """``split_targets`` as a dict: one row for each split."""
    return {r["split_name"]: float(r["target_share"]) for r in targets.select("split_name", "target_share").collect()}

