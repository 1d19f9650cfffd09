"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, low: float | None = None, high: float | None = None) -> DataFrame:
    """The ``n`` items of highest score in each group; an item's score is its best one, ties go to the smaller item.

    Groups are trimmed of white space.  Rows without group, item or score do not count; NaN and scores outside
    ``low``..``high`` are no scores.  Repeated rows change nothing.  A group with fewer items keeps them all; an empty
    table gives an empty table.  Result: group, item, score and ``position`` from 1.

    Best scores are taken by a map-side combined aggregate, so a group of any size arrives as at most its distinct
    items; the rank filter over ``row_number`` lets the optimiser place its group limit before and after the shuffle
    by group, so a task sees at most ``n`` rows of a group from each task before it.
    """
    s = F.nanvl(F.col(score), F.lit(None).cast("double")) if dict(df.dtypes)[score] in ("float", "double") else F.col(score)
    key = F.nullif(F.regexp_replace(F.col(group).cast("string"), r"^\s+|\s+$", ""), F.lit(""))
    slim = df.select(key.alias("__g"), F.col(item).alias("__i"), s.alias("__s")).filter("__g IS NOT NULL AND __i IS NOT NULL AND __s IS NOT NULL")
    if low is not None:
        slim = slim.filter(F.col("__s") >= low)
    if high is not None:
        slim = slim.filter(F.col("__s") <= high)
    best = slim.groupBy("__g", "__i").agg(F.max("__s").alias("__s"))
    order = Window.partitionBy("__g").orderBy(F.col("__s").desc(), F.col("__i").asc())
    ranked = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    return ranked.select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), "position")
