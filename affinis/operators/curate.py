"""Curation of raw measurements: units, labels, conflicts, repeats, exclusion of homologous targets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.bins import TO_MICROMOLAR, activity_label, micromolar


def with_activity(df: DataFrame, value: str = "standard_value", unit: str = "standard_units", units=TO_MICROMOLAR) -> DataFrame:
    """Adds ``activity_um`` and ``label``."""
    return df.withColumn("activity_um", micromolar(F.col(value), F.col(unit), units)).withColumn("label", activity_label(F.col("activity_um")))


def without_conflicts(df: DataFrame, keys: list[str], label: str = "label", strict: bool = False) -> DataFrame:
    """Rows of unambiguous label whose key carries one label only.

    By default ambiguous rows are dropped before conflicts are looked for; with ``strict`` they make a conflict too.
    """
    clear = df if strict else df.filter(F.col(label) != "Ambiguous")
    w = Window.partitionBy(*keys)
    out = clear.withColumn("__low", F.min(label).over(w)).withColumn("__high", F.max(label).over(w)).filter("__low = __high").drop("__low", "__high")
    return out.filter(F.col(label) != "Ambiguous")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in a total order; the group limit keeps a heavy key from one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_values(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Like :func:`keep_first` for few columns, by a combinable aggregate instead of a sort."""
    picked = F.min_by(F.struct(*columns), order)
    return df.groupBy(key).agg(picked.alias("__first")).select(key, *(F.col(f"__first.{c}").alias(c) for c in columns))


def paralog_edges(targets: DataFrame, target: str, family: Column) -> DataFrame:
    """(src, dst): targets of one family, without self-edges."""
    t = targets.select(F.col(target).alias("t"), family.alias("f")).filter("f IS NOT NULL").distinct()
    return t.alias("a").join(t.alias("b"), "f").filter("a.t <> b.t").select(F.col("a.t").alias("src"), F.col("b.t").alias("dst"))


def blocked_pairs(known: DataFrame, edges: DataFrame, molecule: str, target: str) -> DataFrame:
    """(molecule, target) that must not become negatives: known ones, and homologues of known ones."""
    own = known.select(molecule, target)
    homologous = own.join(edges, own[target] == edges["src"]).select(F.col(molecule), F.col("dst").alias(target))
    return own.unionByName(homologous).distinct()


def homology_map(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target the list of its homologues {id, name, organism, evalue, pident}, ordered by e-value, then id.

    ``hits``: qseqid, sseqid, evalue, pident; ``targets``: target_id, target_name, species.  Self-hits and hits of
    unknown targets are left out.
    """
    t = targets.select("target_id", "target_name", "species")
    h = hits.filter("qseqid <> sseqid").join(t.select(F.col("target_id").alias("qseqid")), "qseqid", "left_semi")
    rich = h.join(t, h["sseqid"] == t["target_id"]).select("qseqid", "evalue", F.col("target_id").alias("id"), F.col("target_name").alias("name"), F.col("species").alias("organism"), "pident")
    packed = F.sort_array(F.collect_list(F.struct("evalue", "id", "name", "organism", "pident")))
    return rich.groupBy(F.col("qseqid").alias("target_id")).agg(packed.alias("homologues"))


def potency_benchmark(
    df: DataFrame, molecule: str, target: str, kinds: tuple[str, ...], year: int | None = None, below_um: float = 1e-3, confidence: float = 3, organism: str = "Homo sapiens", size: Column | None = None, least: int = 2
) -> DataFrame:
    """(molecule, n_targets): potent molecules of one year (the latest where none is named) with ``least`` different targets or more."""
    last = df.agg(F.max("publication_year").alias("__year"))
    d = df.filter(F.col("publication_year") == year) if year else df.join(F.broadcast(last), F.col("publication_year") == F.col("__year"))  # one row
    d = d.filter(F.col("standard_type").isin(*kinds) & (F.col("activity_um") < below_um) & (F.col("confidence_score") > confidence) & (F.col("organism") == organism))
    d = d if size is None else d.filter(size)
    g = d.dropna(subset=[molecule, target]).groupBy(molecule).agg(F.count_distinct(target).alias("n_targets"))
    return g.filter(F.col("n_targets") >= least)


def species_summary(df: DataFrame, organism: str, target: str, molecule: str, organisms: list[str]) -> DataFrame:
    """Distinct targets and molecules and rows per organism in the given list, and over all rows; absent ones give 0."""
    spark = df.sparkSession
    rolled = df.rollup(organism).agg(
        F.count_distinct(target).alias("n_targets"), F.count_distinct(molecule).alias("n_molecules"), F.count(F.lit(1)).alias("n_rows"), F.grouping(organism).alias("is_total")
    )
    named = rolled.withColumn("organism", F.when(F.col("is_total") == 1, "All (Total)").otherwise(F.col(organism)))
    listed = spark.createDataFrame([(o,) for o in [*organisms, "All (Total)"]], "organism string")
    return listed.join(named.select("organism", "n_targets", "n_molecules", "n_rows"), "organism", "left").na.fill(0)


def threshold_counts(df: DataFrame, kind: str, um: str, bounds: tuple[float, ...] = (1.0, 10.0, 100.0)) -> DataFrame:
    """Rows below each bound and from the last one, per kind and over ALL."""
    aggs = [F.count_if(F.col(um) < b).alias(f"below_{b:g}") for b in bounds]
    rolled = df.rollup(kind).agg(F.count(um).alias("n_measured"), *aggs, F.count_if(F.col(um) >= bounds[-1]).alias(f"from_{bounds[-1]:g}"), F.grouping(kind).alias("g"))
    return rolled.withColumn(kind, F.when(F.col("g") == 1, "ALL").otherwise(F.col(kind))).drop("g")


def fixed_histogram(df: DataFrame, value: str, low: float, high: float, width: float) -> DataFrame:
    """Counts per bin of fixed width; the last bin is closed, values outside are left out."""
    last = int(round((high - low) / width)) - 1
    inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
    b = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(last)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("bin_low", F.col("bin") * F.lit(width) + F.lit(low))


def error_split(df: DataFrame, result: Column) -> tuple[DataFrame, DataFrame]:
    """Splits rows by a result struct (ok, value, err): the good rows with their value, and a histogram of reasons."""
    d = df.withColumn("__r", result)
    good = d.filter("__r.ok").withColumn("value", F.col("__r.value")).drop("__r")
    bad = d.filter("NOT __r.ok").groupBy(F.col("__r.err").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return good, bad


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts and shares of the values, NULL included, most frequent first (then by value) when only the top is wanted."""
    c = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    out = c.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")  # one row
    return out if top is None else out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(top)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def common_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def missing_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def index_check(df: DataFrame, index: str) -> DataFrame:
    """Whether an index column runs from 0 to n-1 without gaps or repeats."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("n_distinct")).withColumn(
        "dense", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n"))
    )
