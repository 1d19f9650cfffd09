"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_affinis_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(suffix="-affinis.zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)  # code only; executors have fetched it
    sc._affinis_shipped = True
    return spark


def local_session(cores: int | str = 8, app: str = "affinis", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is the caller's."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in a local session, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="affinis-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: written to the shared folder, so it outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *key, per_core: int = 3) -> DataFrame:
    """The same rows in at least ``per_core`` partitions for each core, for work that costs far more than a shuffle.

    Small files of long texts come as few partitions; hashing on columns keeps the placing the same when a task is run
    again after a loss.  Frames with enough partitions stay as they are.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *key)
