"""Readers with declared schemas and writers with a stated outcome."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.bins import md5_order
from affinis.schema import BLAST_HITS, require_columns


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """A parquet file or folder; only the named columns are read."""
    df = spark.read.parquet(path)
    if required:
        require_columns(df, required, path)
    return df.select(*columns) if columns else df


def resolve_parquet(spark: SparkSession, path: str, preferred: str | None = None) -> str:
    """The parquet source meant by a path: itself, or in a folder the preferred entry or the only one; else ValueError."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise ValueError(f"{path}: no such file or folder")
    if not fs.getFileStatus(root).isDirectory():
        return path
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))
    if preferred in names:
        return f"{path.rstrip('/')}/{preferred}"
    if len(names) == 1:
        return f"{path.rstrip('/')}/{names[0]}"
    raise ValueError(f"{path}: {len(names)} parquet sources and no preferred one among them: {names[:5]}")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column; credentials come as options, never from code."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=sep)


def read_blast_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, BLAST_HITS, header=False, sep="\t")


def read_memmap(spark: SparkSession, path: str, width: int, dtype: str = "int64") -> DataFrame:
    """(memmap_idx, values) of a raw binary matrix; the file is cut into row ranges that tasks read by themselves.

    The size must be a whole number of rows.  ``path`` must be readable by every worker.
    """
    import os

    size, row = os.path.getsize(path), np.dtype(dtype).itemsize * width
    if size % row:
        raise ValueError(f"{path}: {size} bytes are not a whole number of rows of {row} bytes")
    n = size // row
    item = T.LongType() if np.dtype(dtype).kind in "iu" else T.FloatType()
    schema = T.StructType([T.StructField("memmap_idx", T.LongType()), T.StructField("values", T.ArrayType(item))])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            ids = d["id"].to_numpy()
            if not len(ids):
                continue
            with open(path, "rb") as f:
                f.seek(int(ids[0]) * row)
                block = np.fromfile(f, dtype, count=int(ids[-1] - ids[0] + 1) * width).reshape(-1, width)
            values = block[ids - ids[0]]
            if values.dtype.kind == "u":
                values = values.view(np.int64) if values.itemsize == 8 else values.astype(np.int64)
            yield pd.DataFrame({"memmap_idx": ids, "values": list(values)})

    return spark.range(0, n).mapInPandas(rows, schema)


def write_memmap(df: DataFrame, index: str, values: str, path: str, width: int, dtype: str = "int64") -> int:
    """Writes rows as a raw binary matrix, each at the place of its index; returns the number of rows.

    Indices must be 0..n-1, each once, and every row ``width`` numbers long, or ValueError is raised.  The file is made
    beside ``path``, which all workers must share, and renamed when it is whole; tasks write their own rows, so one that
    runs again writes the same bytes.
    """
    import os

    d = df.select(F.col(index).cast("long").alias("i"), F.col(values).alias("v"))
    short = F.count_if(F.col("v").isNull() | (F.size("v") != width) | F.exists("v", lambda x: x.isNull()))
    n, different, low, high, bad = d.agg(F.count(F.lit(1)), F.count_distinct("i"), F.min("i"), F.max("i"), short).first()
    if bad or different != n or n and (low, high) != (0, n - 1):
        raise ValueError(f"{path}: indices must be 0..{n - 1}, each once, with {width} numbers a row")
    row, unfinished = np.dtype(dtype).itemsize * width, f"{path}.{uuid.uuid4().hex}"
    with open(unfinished, "wb") as f:
        f.truncate(n * row)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(unfinished, "r+b") as f:
            for part in frames:
                for i, v in zip(part["i"], part["v"]):
                    f.seek(int(i) * row)
                    f.write(np.asarray(v).astype(dtype).tobytes())
                yield pd.DataFrame({"n": [len(part)]})

    placed = d.repartitionByRange(F.col("i")).sortWithinPartitions("i")
    placed.mapInPandas(rows, "n long").agg(F.sum("n")).collect()
    os.replace(unfinished, path)
    return n


def unpadded(values: Column, width: int) -> Column:
    """The rows of a flattened, NaN-padded matrix, without the padding."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(values) / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, width))
    return F.filter(rows, lambda r: ~F.exists(r, lambda v: F.isnan(v)))


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish_parquet(df: DataFrame, root: str, codec: str = "zstd") -> str:
    """Writes a new version beside the old ones and then names it in a pointer table; readers never see half a table."""
    spark = df.sparkSession
    version = f"{root}/version={uuid.uuid4().hex}"
    write_parquet(df, version, codec)
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{root}/current").first()["path"])


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, key: str, sequence: str, path: str) -> None:
    """One record for each distinct key and sequence, in FASTA."""
    d = df.select(key, sequence).na.drop().distinct()
    d.select(F.format_string(">%s\n%s", F.col(key).cast("string"), F.col(sequence))).write.mode("overwrite").text(path)


def sample_rows(df: DataFrame, key: str, n: int = 1000, seed: str = "42") -> DataFrame:
    """``n`` rows in a fixed shuffle of the key, for people to look at."""
    return df.orderBy(md5_order(F.col(key), seed=seed), key).limit(n)


def unique_molecules(df: DataFrame, key: str = "molregno", structure: str = "canonical_smiles", order: str | None = None) -> DataFrame:
    """One structure for each molecule, the first in order; rows without id or structure are skipped."""
    return df.filter(F.col(key).isNotNull() & F.col(structure).isNotNull()).groupBy(key).agg(F.min_by(structure, F.col(order or structure)).alias(structure))
