"""A sample whose shares of several categories follow given targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.session import cut_lineage

#: Up to so many occupied category combinations are raked on the driver (a few megabytes); more are raked by Spark, with
#: the same result.  Their number is bounded by the stated categories, not by the rows.
LOCAL_CELLS = 100_000
IPF_ROUNDS = 200
BUCKETS = 4096
#: Rows that the last search interval may hold; they are ordered in one task.
LAST_ROWS = 10_000
OTHERS = "*"


@dataclass
class TargetSample:
    """rows: the drawn rows (row key and categories); report: one row for each stated category; size: rows wanted;
    expected: rows that the raked weights draw on average."""

    rows: DataFrame
    report: DataFrame
    size: int
    expected: float


def _read_targets(targets: DataFrame) -> pd.DataFrame:
    """The stated categories: a small table by its nature, one row for each category."""
    d = targets.select("dimension", F.col("category").cast("string").alias("category"), F.col("target_share").cast("double").alias("target_share"), F.col("min_rows").cast("long").alias("min_rows")).toPandas()
    return d.sort_values(["dimension", "category"]).reset_index(drop=True)


def reachable(share: np.ndarray, least: np.ndarray, supply: np.ndarray, size: float) -> np.ndarray:
    """Rows wanted of each category of a dimension: its share of ``size`` and its minimum at least, its supply at most.

    What a category cannot give is shared out among the others in proportion to their shares.
    """
    low = np.minimum(least, supply)
    size = min(size, supply.sum())
    if size <= low.sum():
        return low * (size / max(low.sum(), 1e-300))
    a, b = 0.0, 1.0
    while np.clip(share * b, low, supply).sum() < size and b < 1e18:
        b *= 2
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(share * m, low, supply).sum() < size else (a, m)
    want = np.clip(share * b, low, supply)
    return want


Margin = Callable[[int, list[np.ndarray]], np.ndarray]


def local_margins(codes: list[np.ndarray], n: np.ndarray, sizes: list[int]) -> Margin:
    """Expected rows of each category of a dimension under the factors, from cells held here."""

    def margin(d: int, factor: list[np.ndarray]) -> np.ndarray:
        p = np.ones(len(n))
        for e, f in enumerate(factor):
            p *= f[codes[e]]
        return np.bincount(codes[d], np.minimum(p, 1.0) * n, minlength=sizes[d])

    return margin


def spark_margins(cells: DataFrame, dims: list[str], sizes: list[int]) -> Margin:
    """The same by a Spark aggregate over the cells (``code_<dimension>``, n)."""

    def margin(d: int, factor: list[np.ndarray]) -> np.ndarray:
        p = F.lit(1.0)
        for name, f in zip(dims, factor):
            p = p * F.array(*map(F.lit, map(float, f)))[F.col(f"code_{name}")]
        out = np.zeros(sizes[d])
        for r in cells.groupBy(F.col(f"code_{dims[d]}").alias("c")).agg(F.sum(F.least(p, F.lit(1.0)) * F.col("n")).alias("n")).collect():  # a row a category
            out[r["c"]] = r["n"]
        return out

    return margin


def rake(margin: Margin, want: list[np.ndarray], size: float, rounds: int = IPF_ROUNDS) -> tuple[list[np.ndarray], float]:
    """(factors of each dimension, expected rows), by iterative proportional fitting over the margins.

    The draw probability of a row is the product of its factors, at most 1.  A wanted number of 0 gives the factor 0.
    Where margins contradict one another the fit stops short; the first dimension is then scaled until the factors draw
    the size, or all that can be drawn.
    """
    factor = [np.where(w > 0, 1.0 if d else 0.5, 0.0) for d, w in enumerate(want)]
    for _ in range(rounds):
        worst = 0.0
        for d, w in enumerate(want):
            have = margin(d, factor)
            ratio = np.clip(np.where(have > 0, w / np.maximum(have, 1e-300), 1.0), 0.25, 4.0)
            factor[d] = np.minimum(factor[d] * ratio, 1e9)
            worst = max(worst, float(np.abs(have - w).max(initial=0.0)) / max(size, 1.0))
        if worst < 1e-7:
            break
    drawn = float(margin(0, factor).sum())
    low, high = 0.0, 1.0
    while drawn < size * (1 - 1e-9) and high < 1e12:
        high *= 2
        drawn = float(margin(0, [factor[0] * high, *factor[1:]]).sum())
    for _ in range(60 if high > 1 else 0):
        middle = (low + high) / 2
        drawn = float(margin(0, [factor[0] * middle, *factor[1:]]).sum())
        low, high = (middle, high) if drawn < size else (low, middle)
    factor[0] = factor[0] * high
    return factor, float(margin(0, factor).sum())


def target_sample(df: DataFrame, row: str, columns: dict[str, Column], targets: DataFrame, fraction: float = 0.25, salt: str = "affinis-7") -> TargetSample:
    """Draws ``floor(fraction * rows)`` rows so that the shares of each dimension follow ``targets``.

    ``columns`` gives each dimension's category as text; ``targets`` has dimension, category (``*`` stands for every
    category not listed), target_share (1 in sum within a dimension) and min_rows.  Categories that cannot be filled are
    wanted at their supply and the rest of their share goes to the others; weights are then raked over all margins until
    they draw the size; rows are drawn by weighted exponential keys (the hash of the row key makes them reproducible);
    categories below min_rows are filled up from the best keys not drawn, in exchange for the worst drawn rows of
    categories with more than their minimum.

    A NULL category, or one neither listed nor covered by ``*``, has no share: such rows are drawn for a minimum only.
    Repeated rows are rows; an empty table gives an empty sample, and every category with a positive need is reported as
    not fillable.  The report has dimension, category, target_share, min_rows, wanted (the larger of min_rows and
    target_share x size), supply, sampled, undrawn, gap (sampled - target_share x size) and fillable (sampled + undrawn
    reach wanted).  The table is read twice: for the combinations, and for the keys, which are kept in one checkpoint.
    """
    spark = df.sparkSession
    stated = _read_targets(targets)
    dims = [d for d in columns if (stated.dimension == d).any()]
    lists = {d: stated[stated.dimension == d].reset_index(drop=True) for d in dims}
    slim = df.select(F.col(row).alias("__row"), *(columns[d].cast("string").alias(d) for d in dims))
    for d in dims:
        listed = lists[d].category
        rest = F.when(F.col(d).isNotNull(), OTHERS) if OTHERS in set(listed) else F.lit(None).cast("string")
        slim = slim.withColumn(d, F.when(F.col(d).isin(*[c for c in listed if c != OTHERS]), F.col(d)).otherwise(rest))

    cells_df = cut_lineage(slim.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")))
    for d in dims:
        code = F.array_position(F.array(*map(F.lit, lists[d].category)), F.col(d)).cast("int") - 1
        cells_df = cells_df.withColumn(f"code_{d}", F.coalesce(code, F.lit(len(lists[d]))))
    n_cells, total = cells_df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = int(total * fraction)
    drawable = cells_df.filter(" AND ".join(f"code_{d} < {len(lists[d])}" for d in dims))
    sizes = [len(lists[d]) + 1 for d in dims]
    if n_cells <= LOCAL_CELLS:
        held = cells_df.toPandas()  # LOCAL_CELLS rows at most
        margin = local_margins([held[f"code_{d}"].to_numpy(np.int64) for d in dims], held["n"].to_numpy(float), sizes)
    else:
        margin = spark_margins(cells_df, dims, sizes)
    want = []
    for d in dims:
        supply = np.zeros(len(lists[d]))
        for r in drawable.groupBy(f"code_{d}").agg(F.sum("n").alias("n")).collect():  # a row a category
            supply[r[0]] = r["n"]
        want.append(np.r_[reachable(lists[d].target_share.to_numpy(float), lists[d].min_rows.to_numpy(float), supply, size), 0.0])
    factors, expected = rake(margin, want, size)

    weighted = slim
    for d, f in zip(dims, factors):
        table = spark.createDataFrame([(c, float(v)) for c, v in zip(lists[d].category, f)], f"`{d}` string, `__f_{d}` double")
        weighted = weighted.join(table, d, "left")  # a row a category; the optimiser broadcasts by size
    p = F.lit(1.0)
    for d in dims:
        p = p * F.coalesce(F.col(f"__f_{d}"), F.lit(0.0))
    u = (F.pmod(F.xxhash64(F.lit(salt), F.col("__row")), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    # Exponential key over its rate: it is below 1 with probability p.  x / (1 + x) keeps its order within 0..1.
    key = -F.log(u) / -F.log1p(-F.least(p, F.lit(1.0 - 1e-12)))
    keyed = cut_lineage(weighted.select("__row", *dims, F.when(p > 0, key / (key + 1.0)).alias("__k")))

    border = _border(keyed, size)
    flagged = keyed.withColumn("__in", F.coalesce(F.col("__k").isNotNull() & (F.struct("__k", "__row") <= F.struct(F.lit(border[0]), F.lit(border[1]).cast(df.schema[row].dataType))), F.lit(False)) if border else F.lit(False))
    sampled = _margins(flagged, dims)
    short = {}
    for t in stated.itertuples():
        got, left = sampled.get((t.dimension, t.category), (0, 0))
        lack = min(t.min_rows, got + left) - got
        if t.dimension in dims and lack > 0:
            short[(t.dimension, t.category)] = int(lack)
    if short:
        flagged = cut_lineage(_repair(flagged, dims, stated, short, sampled))
        sampled = _margins(flagged, dims)
    lines = []
    for t in stated.itertuples():
        wanted = max(float(t.min_rows), t.target_share * size)
        got, left = sampled.get((t.dimension, t.category), (0, 0))
        lines.append((t.dimension, t.category, float(t.target_share), int(t.min_rows), wanted, got + left, got, left, got - t.target_share * size, bool(got + left >= wanted)))
    report = spark.createDataFrame(lines, "dimension string, category string, target_share double, min_rows long, wanted double, supply long, sampled long, undrawn long, gap double, fillable boolean")
    return TargetSample(flagged.filter("__in").select(F.col("__row").alias(row), *dims), report, size, expected)


def _margins(flagged: DataFrame, dims: list[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """(rows drawn, rows not drawn) of each category of each dimension."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("c")) for d in dims))).alias("x")
    cells = flagged.groupBy(*dims, "__in").agg(F.count(F.lit(1)).alias("n"))
    g = cells.select(each, "__in", "n").groupBy("x.d", "x.c").agg(F.sum(F.when(F.col("__in"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("__in"), 0).otherwise(F.col("n"))).alias("b"))
    return {(r["d"], r["c"]): (int(r["a"]), int(r["b"])) for r in g.collect()}  # a row a category


def _border(keyed: DataFrame, size: int) -> tuple | None:
    """The ``size``-th (key, row), or the last one if fewer have a key: histograms of fixed size narrow the interval."""
    low, width, taken = 0.0, 1.0 / BUCKETS, 0
    if size <= 0:
        return None
    while True:
        inside = keyed.filter((F.col("__k") >= low) & (F.col("__k") < low + width * BUCKETS))
        bucket = F.least(F.floor((F.col("__k") - low) / width), F.lit(BUCKETS - 1)).cast("int")
        counts = {r["b"]: r["n"] for r in inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS rows
        last = None
        for b in sorted(counts):
            last = b
            if taken + counts[b] >= size:
                break
            taken += counts[b]
        else:
            break  # fewer keys than wanted: all of them
        low, width = low + last * width, width / BUCKETS
        if counts[last] <= LAST_ROWS or width < 1e-15:
            break
    if last is None:
        return None
    rest = keyed.filter((F.col("__k") >= low) & (F.col("__k") < low + width * BUCKETS)) if taken < size else keyed.filter(F.col("__k").isNotNull())
    found = rest.orderBy("__k", "__row").limit(size - taken).agg(F.max(F.struct("__k", "__row")).alias("b")).first()["b"] if taken < size else None
    if found is None:
        found = keyed.filter(F.col("__k").isNotNull()).agg(F.max(F.struct("__k", "__row")).alias("b")).first()["b"]
    return None if found is None else (found["__k"], found["__row"])


def _repair(flagged: DataFrame, dims: list[str], stated: pd.DataFrame, short: dict, sampled: dict) -> DataFrame:
    """Fills categories below their minimum from rows not drawn, and gives back as many rows of richer categories."""
    lack = F.array(*(F.when(F.col(d) == c, F.struct(F.lit(d).alias("__d"), F.lit(c).alias("__c"), F.lit(n).alias("__lack"))) for (d, c), n in short.items()))
    offers = flagged.filter(~F.col("__in")).withColumn("o", F.explode(F.filter(lack, lambda x: x.isNotNull()))).select("__row", "__k", "o.*")
    # rows without a share in another dimension have no key: they come last
    best = Window.partitionBy("__d", "__c").orderBy(F.col("__k").asc_nulls_last(), "__row")
    most = max(short.values())
    added = offers.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= most).filter("rn <= __lack").select("__row").distinct()
    added = cut_lineage(added)
    count = added.count()  # at most the sum of the minimums
    spare = F.lit(True)
    for t in stated.itertuples():
        if t.dimension in dims and sampled.get((t.dimension, t.category), (0, 0))[0] <= t.min_rows + count:
            spare = spare & ~F.col(t.dimension).eqNullSafe(F.lit(t.category))
    out = flagged.filter("__in").filter(spare).orderBy(F.col("__k").desc_nulls_first(), F.col("__row").desc()).limit(count).select("__row")
    changed = added.withColumn("__new", F.lit(True)).unionByName(out.withColumn("__new", F.lit(False)))
    return flagged.join(changed, "__row", "left").withColumn("__in", F.coalesce("__new", "__in")).drop("__new")
