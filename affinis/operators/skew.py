"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.ids import molecule_key, pair_key

_PARTIAL = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("tag", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_values", T.LongType()),
        T.StructField("first_value", T.StringType()),
        T.StructField("last_value", T.StringType()),
        T.StructField("n_measured", T.LongType()),
        T.StructField("sum_measured", T.DoubleType()),
        T.StructField("min_measured", T.DoubleType()),
        T.StructField("max_measured", T.DoubleType()),
    ]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial state for each run of (key, tag) in a sorted partition; state is carried over batch borders."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    open_run: list | None = None
    done: list[list] = []
    for batch in batches:
        d = batch.to_pandas()
        if not len(d):
            continue
        key = d["key"].to_numpy(object)
        tag = d["tag"].to_numpy(np.int64)
        value = d["value"].to_numpy(object)
        rows = d["n"].to_numpy(np.int64)
        new = np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]
        fresh = np.r_[True, value[1:] != value[:-1]] | new
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(d)] - 1
        measured = d[["m_n", "m_sum", "m_min", "m_max"]].to_numpy(float)
        n_rows, n_values = np.add.reduceat(rows, starts), np.add.reduceat(fresh.astype(np.int64), starts)
        m_n, m_sum = np.add.reduceat(np.nan_to_num(measured[:, 0]), starts), np.add.reduceat(np.nan_to_num(measured[:, 1]), starts)
        m_min, m_max = np.fmin.reduceat(measured[:, 2], starts), np.fmax.reduceat(measured[:, 3], starts)
        for i, (a, b) in enumerate(zip(starts, ends)):
            run = [key[a], int(tag[a]), part, int(n_rows[i]), int(n_values[i]), value[a], value[b], int(m_n[i]), float(m_sum[i]), float(m_min[i]), float(m_max[i])]
            if open_run and open_run[0] == run[0] and open_run[1] == run[1]:
                open_run[4] += run[4] - (open_run[6] == run[5])
                open_run[3] += run[3]
                open_run[6] = run[6]
                open_run[7] += run[7]
                open_run[8] += run[8]
                open_run[9], open_run[10] = float(np.fmin(open_run[9], run[9])), float(np.fmax(open_run[10], run[10]))
            else:
                if open_run:
                    done.append(open_run)
                open_run = run
    if open_run:
        done.append(open_run)
    if done:
        names = [f.name for f in _PARTIAL.fields]
        out = pd.DataFrame(done, columns=names)
        for c in ("min_measured", "max_measured"):
            out[c] = out[c].astype(float)
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema(list(zip(names, types))), preserve_index=False)


def key_statistics(
    df: DataFrame,
    key: str,
    distinct: dict[str, str],
    measure: str | None = None,
    heavy_share: float = 0.02,
    partitions: int | None = None,
) -> DataFrame:
    """Rows, exact distinct counts and sum/min/max of a measure for every key, with no task bound to one key.

    ``distinct`` maps an output column to the column whose distinct values are counted.  Rows are first counted per
    (key, value) where they lie, then range-partitioned on (key, column, value) by sampled quantiles, so that a heavy
    key spreads over as many partitions as its share asks for.  Each partition emits one partial state per key; states
    of a key that meet at a partition border are stitched there: a value on both sides counts once.

    Rows with a NULL key are left out; NULL values are rows but no distinct value; NULL and NaN measures do not count.
    Repeated rows count as rows.  An empty table gives an empty table.  Result: ``key``, ``n_rows``, a column per
    distinct count, ``n_measured``, ``sum_measured``, ``min_measured``, ``max_measured``, ``share``, ``is_heavy``.
    """
    names = list(distinct)
    m = F.nanvl(F.col(measure).cast("double"), F.lit(None).cast("double")) if measure else F.lit(None).cast("double")
    # tag 0 carries the rows and the measure; every column gets one tag, so that one shuffle serves all of them
    entries = F.array(*(F.struct(F.lit(i).alias("tag"), F.col(distinct[name]).cast("string").alias("value"), F.lit(i == 0).alias("lead")) for i, name in enumerate(names)))
    slim = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), m.alias("m"), F.explode(entries).alias("e"))
    slim = slim.select("key", F.when(F.col("e.lead"), F.col("m")).alias("m"), "e.tag", "e.value")
    counted = slim.groupBy("key", "tag", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count("m").alias("m_n"), F.sum("m").alias("m_sum"), F.min("m").alias("m_min"), F.max("m").alias("m_max")
    )
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, "key", "tag", "value").sortWithinPartitions("key", "tag", "value")
    states = ranged.mapInArrow(_runs, _PARTIAL)
    # Few rows from here on: at most one per key and column, and one more for each partition border.
    border = Window.partitionBy("key", "tag").orderBy("part")
    again = F.coalesce(F.lag("last_value").over(border) == F.col("first_value"), F.lit(False)).cast("long")
    blank = F.col("first_value").isNull().cast("long")
    stitched = states.withColumn("values_here", F.col("n_values") - again - blank)
    total = lambda c, i: F.sum(F.when(F.col("tag") == i, F.col(c)))
    out = stitched.groupBy("key").agg(
        total("n_rows", 0).alias("n_rows"),
        *(total("values_here", i).alias(name) for i, name in enumerate(names)),
        F.sum("n_measured").alias("n_measured"),
        F.sum(F.when(F.col("n_measured") > 0, F.col("sum_measured"))).alias("sum_measured"),
        F.min(F.nanvl("min_measured", F.lit(None).cast("double"))).alias("min_measured"),
        F.max(F.nanvl("max_measured", F.lit(None).cast("double"))).alias("max_measured"),
    )
    everything = out.agg(F.sum("n_rows").alias("all_rows"))
    return (
        out.crossJoin(F.broadcast(everything))  # one row
        .withColumn("share", F.col("n_rows") / F.col("all_rows"))
        .withColumn("is_heavy", F.col("n_rows") >= F.lit(heavy_share) * F.col("all_rows"))
        .drop("all_rows")
    )


def target_statistics(meta: DataFrame, heavy_share: float = 0.02) -> DataFrame:
    """:func:`key_statistics` of ``final_training_meta``: rows, pairs, molecules and ``activity_um`` per target."""
    slim = meta.select(
        "target_chembl_id", pair_key(F.col("pair_id")).alias("__pair"), molecule_key(F.col("mol_chembl_id")).alias("__mol"), F.col("activity_um").alias("__um")
    )
    return key_statistics(slim, "target_chembl_id", {"n_pairs": "__pair", "n_molecules": "__mol"}, "__um", heavy_share).withColumnRenamed("key", "target_chembl_id")
