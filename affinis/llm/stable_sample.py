"""A reproducible sample that only grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.session import cut_lineage

#: Hash values are integers below this bound (15 hexadecimal digits of the md5), so every engine computes them alike.
SPACE = 1 << 60


def key_hash(key: Column, salt: str) -> Column:
    """A number in 0..2^60-1 that depends on the key and the salt only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), key)), 1, 15), 16, 10).cast("long")


def raised_thresholds(keys: DataFrame, least: int) -> DataFrame:
    """(stratum, raised): the largest threshold that ``least`` keys needed at the end of any delivery.

    While a stratum has fewer keys than that, the threshold admits them all and rises with the largest hash; from the
    delivery on that fills it, the least-th smallest hash can only fall.  So two numbers decide: the largest hash before
    that delivery, and the least-th smallest at its end, for which the group limit keeps ``least`` rows a stratum.
    """
    per = keys.groupBy("stratum", "first_batch").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("stratum").orderBy("first_batch").rowsBetween(Window.unboundedPreceding, 0)  # a row a delivery
    filled = per.withColumn("sum", F.sum("n").over(so_far)).groupBy("stratum").agg(F.coalesce(F.min(F.when(F.col("sum") >= least, F.col("first_batch"))), F.max("first_batch")).alias("filled"))
    known = keys.join(filled, "stratum").filter(F.col("first_batch") <= F.col("filled"))
    before = known.filter(F.col("first_batch") < F.col("filled")).groupBy("stratum").agg(F.max("key_hash").alias("h"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("key_hash"))
    at = known.select("stratum", "key_hash").withColumn("rn", rank).filter(F.col("rn") <= least).groupBy("stratum").agg(F.max("key_hash").alias("h"))
    return before.unionByName(at).groupBy("stratum").agg((F.max("h") + 1).alias("raised"))


def stable_sample(
    df: DataFrame,
    key: Column,
    stratum: Callable[[Column], Column],
    batch: Column,
    salt: str = "affinis-1",
    default_rate: float = 0.1,
    rates: DataFrame | None = None,
    least: int = 0,
    previous: DataFrame | None = None,
) -> DataFrame:
    """The chosen keys: ``key``, ``stratum``, ``first_batch``, ``key_hash``, ``threshold``.

    ``key`` names what is drawn as a whole (all its rows are in or out); ``stratum`` is a function of the key, so that it
    cannot change when rows are added.  A key is chosen if its salted hash is below the threshold of its stratum: the
    fixed rate of the stratum (``rates``: stratum, rate), and never less than ``default_rate``, so that a stratum listed
    later loses nothing.  The choice depends on nothing else: it is the same on every run, order and partitioning, and a
    key chosen among some rows is chosen among any more.

    Thresholds may be raised, never lowered: by ``previous`` (stratum, threshold of an earlier run, as ``remembered``
    keeps them) and, with ``least`` > 0, to keep that many keys per stratum at the end of every delivery (``batch``; rows
    without one count as the first).  The latter keeps earlier choices while whole deliveries are added; pass the earlier
    thresholds as ``previous`` where a delivery was still incomplete.

    NULL keys belong to nothing and are left out; a NULL stratum is the stratum ``''``; repeated rows change nothing;
    an empty table gives an empty sample.
    """
    keys = df.select(key.alias("key"), F.coalesce(batch.cast("long"), F.lit(0)).alias("b")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("b").alias("first_batch"))
    keys = keys.withColumn("stratum", F.coalesce(stratum(F.col("key")), F.lit(""))).withColumn("key_hash", key_hash(F.col("key"), salt))
    limit = F.lit(default_rate)
    if rates is not None:
        keys = keys.join(rates.select("stratum", F.col("rate").alias("__rate")), "stratum", "left")
        limit = F.greatest(F.col("__rate"), limit)
    keys = keys.withColumn("threshold", (limit * F.lit(float(SPACE))).cast("long"))
    raises = [] if previous is None else [previous.groupBy("stratum").agg(F.max("threshold").alias("raised"))]
    if least > 0:
        raises.append(raised_thresholds(keys, least))
    for r in raises:
        keys = keys.join(r, "stratum", "left").withColumn("threshold", F.greatest("threshold", "raised")).drop("raised")
    return keys.filter(F.col("key_hash") < F.col("threshold")).select("key", "stratum", "first_batch", "key_hash", "threshold")


def remembered(df: DataFrame, state: str, key: Column, stratum: Callable[[Column], Column], batch: Column, **options) -> DataFrame:
    """``stable_sample`` that keeps its thresholds in the folder ``state`` (shared storage) and always starts from them.

    Each run appends the thresholds of its strata; a stratum's largest counts, so whatever the rates of a later run are,
    nothing chosen before is lost.  The first run finds no folder and starts from the rates.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    chosen = cut_lineage(stable_sample(df, key, stratum, batch, previous=spark.read.parquet(state) if known else None, **options))
    chosen.groupBy("stratum").agg(F.max("threshold").alias("threshold")).write.mode("append").parquet(state)
    return chosen
