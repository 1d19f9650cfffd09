import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.sources import readers as R
from affinis.streaming.scoring import latest_measurements


def test_memmap(spark, tmp_path):
    m = np.arange(48, dtype=np.uint64).reshape(3, 16)
    m.tofile(tmp_path / "x.bin")
    rows = R.read_memmap(spark, str(tmp_path / "x.bin"), 16, "uint64").orderBy("memmap_idx").collect()
    assert [list(r["values"]) for r in rows] == m.tolist()
    with pytest.raises(ValueError, match="whole number"):
        R.read_memmap(spark, str(tmp_path / "x.bin"), 7, "uint64")


def test_memmap_written_and_read(spark, tmp_path):
    m = np.random.default_rng(1).integers(-9, 9, (57, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i long, v array<long>").orderBy(F.rand(2)).repartition(5)
    path = str(tmp_path / "m.bin")
    assert R.write_memmap(df, "i", "v", path, 4) == 57
    assert (np.fromfile(path, np.int64).reshape(-1, 4) == m).all()
    assert {r["memmap_idx"]: list(r["values"]) for r in R.read_memmap(spark, path, 4).collect()} == dict(enumerate(m.tolist()))
    assert R.write_memmap(df.limit(0), "i", "v", str(tmp_path / "none.bin"), 4) == 0
    for bad in (df.filter("i <> 3"), df.unionByName(df.limit(1)), df.withColumn("v", F.slice("v", 1, 3)), df.withColumn("v", F.lit(None).cast("array<long>"))):
        with pytest.raises(ValueError, match="each once"):
            R.write_memmap(bad, "i", "v", path, 4)
    assert [p.name for p in sorted(tmp_path.iterdir())] == ["m.bin", "none.bin"]


def test_publish(spark, tmp_path):
    root = str(tmp_path / "t")
    R.publish_parquet(spark.range(3), root)
    R.publish_parquet(spark.range(5), root)
    assert R.read_published(spark, root).count() == 5


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([("t1", "MKV"), ("t1", "MKV"), ("t2", None)], "t string, s string")
    R.write_fasta(df, "t", "s", str(tmp_path / "f"))
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "f")).collect()) == ">t1\nMKV"
    (tmp_path / "hits.tsv").write_text("a\tb\t99.0\t1\t2\t3\t4\t5\t6\t7\t1e-9\t50\n")
    assert R.read_blast_hits(spark, str(tmp_path / "hits.tsv")).first()["evalue"] == 1e-9
    R.write_report(df, str(tmp_path / "r"))
    R.write_manifest(spark, str(tmp_path / "m"), {"n": 1})
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"n": 1}'


def test_unpadded(spark):
    d = spark.createDataFrame([([1.0, 2.0, float("nan"), float("nan")],)], "v array<double>")
    assert d.select(R.unpadded(F.col("v"), 2).alias("r")).first()["r"] == [[1.0, 2.0]]


def test_unique_molecules(spark):
    d = spark.createDataFrame([(1, "B"), (1, "A"), (None, "C"), (2, None)], "molregno long, canonical_smiles string")
    assert [tuple(r) for r in R.unique_molecules(d).collect()] == [(1, "A")]


def test_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/final_training_meta.parquet").schema
    # the file is read as a stream of one batch
    src = spark.readStream.schema(schema).option("pathGlobFilter", "final_training_meta.parquet").parquet(data)
    q = latest_measurements(src.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) from latest").first()[0] > 0
