"""The masked similarity join with per-group top-K, scoring and ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.bins import THRESHOLDS, clamp

POLICIES = ("paired_sum", "paired_2d", "paired_3d", "independent")


@dataclass(frozen=True)
class Params:
    """Options of the similarity features; the defaults are those of the current trainer."""

    k: int = 1
    policy: str = "paired_sum"
    threshold_2d: float = 0.0
    threshold_3d: float = 0.0
    normalise: bool = False
    exclude_below: bool = False
    mask_scaffold: bool = False
    mask_fold: bool = False
    mask_assay: bool = False
    keep_negative: bool = False
    dims: int = 18
    block: int = 512

    @classmethod
    def preset(cls, name: str, **kwargs) -> Params:
        t2, t3 = THRESHOLDS[name]
        return cls(threshold_2d=t2, threshold_3d=t3, **kwargs)

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"policy {self.policy!r} is none of {POLICIES}")
        if self.exclude_below and self.policy != "independent":
            object.__setattr__(self, "policy", "independent")


def _matrix(column: pd.Series, dtype) -> np.ndarray:
    return np.array(column.tolist(), dtype) if len(column) else np.zeros((0, 0), dtype)


def _tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inter = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        inter += np.bitwise_count(a[:, None, w] & b[None, :, w]).astype(np.int32)
    union = np.bitwise_count(a).sum(axis=1, dtype=np.int32)[:, None] + np.bitwise_count(b).sum(axis=1, dtype=np.int32)[None, :] - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 0.0)


def _shape(a: pd.Series, b: pd.Series, dims: int) -> np.ndarray:
    """1 / (1 + least L1 / dims) over all pairs of conformers; 0 where either has none.

    The distance of all first conformers is a block, then of the second ones, and so on: one running minimum.
    """
    least = np.full((len(a), len(b)), np.inf)
    deep_a, deep_b = max((len(x) for x in a if x is not None), default=0), max((len(x) for x in b if x is not None), default=0)
    for i in range(deep_a):
        rows = [r for r, x in enumerate(a) if x is not None and len(x) > i]
        left = np.array([a.iloc[r][i] for r in rows], float)
        for j in range(deep_b):
            cols = [c for c, x in enumerate(b) if x is not None and len(x) > j]
            right = np.array([b.iloc[c][j] for c in cols], float)
            d = np.zeros((len(rows), len(cols)))
            for k in range(left.shape[1]):
                d += np.abs(left[:, None, k] - right[None, :, k])
            at = np.ix_(rows, cols)
            least[at] = np.fmin(least[at], d)
    return np.where(np.isfinite(least), 1.0 / (1.0 + least / dims), 0.0)


def _ranking_scores(raw2: np.ndarray, raw3: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Similarities as they enter the ranking: excluded below the threshold (-1), then normalised."""
    s2, s3 = raw2, raw3
    if p.exclude_below:
        s2, s3 = np.where(raw2 < p.threshold_2d, -1.0, s2), np.where(raw3 < p.threshold_3d, -1.0, s3)
    if p.normalise:
        s2 = np.clip((s2 - p.threshold_2d) / (1 - p.threshold_2d), 0, 1)
        s3 = np.clip((s3 - p.threshold_3d) / (1 - p.threshold_3d), 0, 1)
    return s2, s3


_CANDIDATES = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("target", T.LongType()), T.StructField("active_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("raw_2d", "raw_3d", "sim_2d", "sim_3d")]
)


def similarity_candidates(queries: DataFrame, actives: DataFrame, p: Params, same_target: bool) -> DataFrame:
    """For each (query, target) the actives that can be among its top K, with their similarities.

    queries: query_id, bits, conformers, scaffold, fold, assay (and target if ``same_target``); actives: active_id and the
    same, with target.  With ``same_target`` a query meets the actives of its own target, else those of every target.

    Both sides are cut into blocks of at most about ``p.block`` rows by hash, and every pair of blocks of a target is one
    group: a popular target spreads over many tasks, and no task holds more than two blocks.  A group gives back only K
    rows per query, target and ranking, plus those of the raw maxima; the query itself and masked actives never count.
    """
    spread = ["target"] if same_target else []
    columns = ["bits", "conformers", "scaffold", "fold", "assay"]

    def blocked(df: DataFrame, id_column: str, name: str) -> DataFrame:
        sizes = df.groupBy(*spread).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / p.block)).cast("int").alias(f"{name}_blocks"))
        joined = df.join(sizes, spread) if spread else df.crossJoin(F.broadcast(sizes))  # one row without a target
        return joined.withColumn(f"{name}_block", F.pmod(F.xxhash64(id_column), F.col(f"{name}_blocks")).cast("int"))

    q = blocked(queries, "query_id", "q")
    a = blocked(actives, "active_id", "a")
    counts_q = q.select(*spread, "q_blocks").distinct()
    counts_a = a.select(*spread, "a_blocks").distinct()
    meet_q = q.join(counts_a, spread) if spread else q.crossJoin(F.broadcast(counts_a))  # one row
    meet_a = a.join(counts_q, spread) if spread else a.crossJoin(F.broadcast(counts_q))  # one row
    keys = [*spread, "q_block", "a_block"]
    left = meet_q.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).select(*keys, "query_id", *columns)
    right = meet_a.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select(*dict.fromkeys([*keys, "target"]), "active_id", *columns)

    def block(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l) or not len(r):
            return pd.DataFrame(columns=[f.name for f in _CANDIDATES.fields])
        raw2 = _tanimoto(_matrix(l["bits"], np.int64).view(np.uint64), _matrix(r["bits"], np.int64).view(np.uint64))
        raw3 = _shape(l["conformers"], r["conformers"], p.dims)
        ok = l["query_id"].to_numpy()[:, None] != r["active_id"].to_numpy()[None, :]
        known = r["scaffold"].notna().to_numpy()
        if p.mask_scaffold:
            ok &= (l["scaffold"].fillna("\0").to_numpy()[:, None] != r["scaffold"].fillna("\1").to_numpy()[None, :]) & known[None, :]
        if p.mask_fold:
            ok &= l["fold"].to_numpy()[:, None] != r["fold"].to_numpy()[None, :]
        if p.mask_assay:
            ok &= l["assay"].to_numpy()[:, None] != r["assay"].to_numpy()[None, :]
        s2, s3 = _ranking_scores(raw2, raw3, p)
        orders = {"paired_sum": [s2 + s3], "paired_2d": [s2], "paired_3d": [s3], "independent": [s2, s3]}[p.policy]
        take = np.zeros(ok.shape, bool)
        target = r["target"].to_numpy()
        ids = r["active_id"].to_numpy()
        for t in np.unique(target):
            cols = np.flatnonzero(target == t)
            cols = cols[np.argsort(ids[cols], kind="stable")]
            for score, k in [*((o, p.k) for o in orders), (raw2, 1), (raw3, 1)]:
                s = np.where(ok[:, cols], np.round(score[:, cols], 9), -np.inf)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                take[np.arange(len(l))[:, None], cols[top]] = True
        i, j = np.nonzero(take & ok)
        return pd.DataFrame({"query_id": l["query_id"].to_numpy()[i], "target": target[j], "active_id": ids[j], "raw_2d": raw2[i, j], "raw_3d": raw3[i, j], "sim_2d": s2[i, j], "sim_3d": s3[i, j]})

    # both sides may stem from one table: fresh columns keep them apart
    fresh = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    named = lambda l, r: block(l, r.rename(columns=lambda c: c.removeprefix("r_")))  # noqa: E731, E741
    return left.groupBy(*keys).cogroup(fresh.groupBy(*(f"r_{k}" for k in keys))).applyInPandas(named, _CANDIDATES)


def _order(p: Params, modality: str | None = None) -> list[Column]:
    score = {"paired_sum": F.col("sim_2d") + F.col("sim_3d"), "paired_2d": F.col("sim_2d"), "paired_3d": F.col("sim_3d"), "2d": F.col("sim_2d"), "3d": F.col("sim_3d")}[modality or p.policy]
    return [F.round(score, 9).desc(), F.col("active_id").asc()]


def topk_features(candidates: DataFrame, p: Params) -> DataFrame:
    """(query_id, target, sims_3d, sims_2d, max_2d, max_3d): arrays of K similarities, best first, zeros beyond.

    Paired policies rank the actives once and take both similarities of the same ones; ``independent`` ranks each
    modality for itself.  Ties go to the smaller active.  Raw maxima do not know thresholds.
    """
    w = Window.partitionBy("query_id", "target")
    if p.policy == "independent":
        ranked = candidates.withColumn("r2", F.row_number().over(w.orderBy(*_order(p, "2d")))).withColumn("r3", F.row_number().over(w.orderBy(*_order(p, "3d"))))
    else:
        one = F.row_number().over(w.orderBy(*_order(p)))
        ranked = candidates.withColumn("r2", one).withColumn("r3", F.col("r2"))
    held = (lambda c: c) if p.keep_negative else (lambda c: F.greatest(c, F.lit(0.0)))
    slot = lambda r, s, i: F.coalesce(held(F.max(F.when(F.col(r) == i, F.col(s)))), F.lit(0.0))
    return ranked.groupBy("query_id", "target").agg(
        F.array(*(slot("r3", "sim_3d", i + 1) for i in range(p.k))).alias("sims_3d"),
        F.array(*(slot("r2", "sim_2d", i + 1) for i in range(p.k))).alias("sims_2d"),
        F.greatest(F.max("raw_2d"), F.lit(0.0)).alias("max_2d"),
        F.greatest(F.max("raw_3d"), F.lit(0.0)).alias("max_3d"),
    )


def interleaved(p: Params) -> list[Column]:
    """The columns s1_3d_i, s2_2d_i of a feature frame."""
    return [c for i in range(p.k) for c in (F.col("sims_3d")[i].alias(f"s1_3d_{i + 1}"), F.col("sims_2d")[i].alias(f"s2_2d_{i + 1}"))]


def summary_features(features: DataFrame) -> DataFrame:
    """Six columns: maximum, mean and population standard deviation of the K similarities of either modality."""

    def std(c: str) -> Column:
        n = F.size(c)
        mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
        return F.sqrt(F.aggregate(F.transform(c, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n)

    def mean(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)

    return features.select(
        "query_id", "target", *(f(c).alias(f"{name}_{c[-2:]}") for c in ("sims_3d", "sims_2d") for name, f in (("max", F.array_max), ("mean", mean), ("std", std)))
    )


def loo_scores(features: DataFrame, queries: DataFrame, targets: DataFrame, coefficients: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Scores and ranks of every query against every target.

    queries: query_id, heavy_atoms; targets: target, target_index (the order that breaks ties); coefficients: ha_bin,
    intercept, w_3d, w_2d; known: query_id, target pairs that are true.  Targets without a usable active score 0.
    """
    q = queries.select("query_id", clamp(F.col("heavy_atoms"), 10, 60).cast("int").alias("ha_bin"))
    scored = (
        features.join(q, "query_id").join(coefficients, "ha_bin")
        .withColumn("z", F.col("intercept") + F.col("w_3d") * F.array_max("sims_3d") + F.col("w_2d") * F.array_max("sims_2d"))
        .select("query_id", "target", "max_2d", "max_3d", (1.0 / (1.0 + F.exp(-F.col("z")))).alias("score"))
    )
    grid = q.select("query_id").crossJoin(targets)  # the result itself: every query against every target
    full = grid.join(scored, ["query_id", "target"], "left").na.fill(0.0, ["max_2d", "max_3d", "score"])
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "target_index")
    out = full.withColumn("rank", F.row_number().over(w)).drop("target_index")
    if known is None:
        return out
    truth = known.select("query_id", "target").distinct().withColumn("is_true", F.lit(True))
    return out.join(truth, ["query_id", "target"], "left").withColumn("is_true_target", F.coalesce("is_true", F.lit(False))).drop("is_true")


def keep_rule(ranked: DataFrame, top: int, least: float, rank: str = "rank", score: str = "score") -> DataFrame:
    """Rows among the first ``top`` of their query or of at least the score."""
    return ranked.filter((F.col(rank) <= top) | (F.col(score) >= least))
