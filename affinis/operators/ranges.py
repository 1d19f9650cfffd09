"""Running sums and exact quantiles over groups of any size: ordered ranges with the sums before each as its offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.session import cut_lineage


def sums_before(rows: DataFrame, by: list[str], order: list[str], sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``before_c`` for every column c of ``sums``: its sum over the rows of the same group that come earlier.

    Rows are spread over ranges of (group, order), so a group of any size is shared out among many tasks; each range sums
    up its own rows on top of the sums of the ranges before it.  The placed rows are checkpointed, as ranges sampled a
    second time would have other borders.  NULL is a group of its own; ``order`` must tell the rows of a group apart; an
    empty frame stays empty.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    whole = placed.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__s_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    offsets = whole.select(
        F.col("__part").alias("__p"), *(F.col(g).alias(f"__g_{g}") for g in by), *(F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums)
    )
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__b_{c}") for c in sums))
    on = F.col("__part") == F.col("__p")
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return own.join(offsets, on).select(*rows.columns, *((F.col(f"__b_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums))


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every group's distinct values with their rows (``c``), the rows before them and the group's total (``n``, ``k``)."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = df.select(*by, v.alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    run = sums_before(counts, by, ["v"], ["c"])
    total = run.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    total = total.select(*(F.col(g).alias(f"__t_{g}") for g in by), "n", "k")
    on = F.lit(True)
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col(f"__t_{g}"))
    return run.join(total, on).drop(*(f"__t_{g}" for g in by))  # one row for each group


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """(by, n, q array): exact quantiles with linear interpolation at the points; NULL and NaN are missing.

    Groups without values give no row.
    """
    d = _counted(df, by, value)
    ends = []
    for i, p in enumerate(points):
        place = F.lit(float(p)) * (F.col("n") - 1)
        holds = lambda at: (at >= F.col("before_c")) & (at < F.col("before_c") + F.col("c"))
        ends += [F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"__l{i}"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"__h{i}")]
    g = d.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    part = lambda p: F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1))
    return g.select(*by, "n", F.array(*(F.col(f"__l{i}") + part(p) * (F.col(f"__h{i}") - F.col(f"__l{i}")) for i, p in enumerate(points))).alias("q"))


def equal_count_edges(df: DataFrame, by: str, value: str, n_bins: int) -> DataFrame:
    """(by, edges): the distinct borders of ``n_bins`` bins of equal count, fewer where a group has fewer values (two at least)."""
    d = _counted(df, [by], value).withColumn("bins", F.least(F.lit(n_bins), F.greatest(F.lit(2), F.col("k"))))
    place = lambda i: i / F.col("bins") * (F.col("n") - 1)
    holds = lambda at: (at >= F.col("before_c")) & (at < F.col("before_c") + F.col("c"))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("bins").cast("long")), lambda i: holds(F.floor(place(i))) | holds(F.ceil(place(i))))
    e = d.select(by, "n", "bins", "v", "before_c", "c", F.explode(met).alias("i"))
    e = e.groupBy(by, "i").agg(
        F.max(place(F.col("i"))).alias("place"), F.max(F.when(holds(F.floor(place(F.col("i")))), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil(place(F.col("i")))), F.col("v"))).alias("high")
    )
    edge = F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low"))
    return e.groupBy(by).agg(F.sort_array(F.collect_set(edge)).alias("edges"))  # n_bins + 1 numbers at most
