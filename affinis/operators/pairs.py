"""Positive/negative pairs: sampling, folds, trimming, filling, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.bins import md5_order
from affinis.operators.ranges import sums_before
from affinis.session import cut_lineage


def hash_bucket(key: Column, buckets: int, seed: str) -> Column:
    """A bucket that any engine computes alike: the first 8 hexadecimal digits of the md5, modulo."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def sample_negatives(
    positives: DataFrame,
    molecules: DataFrame,
    blocked: DataFrame,
    molecule: str,
    target: str,
    per_positive: int = 10,
    buckets: int = 64,
    draws: int = 3,
    seed: str = "42",
) -> DataFrame:
    """(pair_id, molecule, target, rank): ``per_positive`` negatives for every positive (molecule, target).

    Instead of drawing and rejecting, each positive meets a bounded candidate set: the molecules of ``draws`` hash
    buckets chosen by the hash of its pair; the positive's own molecule and blocked (molecule, target) are taken out
    bucket by bucket, and a fixed shuffle decides.  ``buckets`` sets the candidates per positive: molecules / buckets x
    draws.  Pairs that this leaves short draw again from all molecules that their target allows; a pair is dropped only
    if fewer than ``per_positive`` of them exist.  A NULL molecule or target makes no pair.
    """
    pair = F.concat_ws("_", F.col(molecule).cast("string"), F.col(target).cast("string"))
    p = positives.dropna(subset=[molecule, target]).select(F.col(molecule).alias("__pos"), F.col(target), pair.alias("pair_id")).distinct()
    blocked = blocked.select(molecule, target).dropna()
    mols = molecules.select(F.col(molecule)).dropna().distinct()
    # A draw may name a bucket twice; distinct keeps its molecules from counting twice.
    asked = p.withColumn("__b", F.explode(F.array_distinct(F.array(*(hash_bucket(F.concat_ws("|", F.col("pair_id"), F.lit(i)), buckets, seed) for i in range(draws))))))
    bucket = hash_bucket(F.col(molecule).cast("string"), buckets, seed)
    pool = mols.groupBy(bucket.alias("__b")).agg(F.collect_list(molecule).alias("__pool"))  # a bucket's molecules
    out = blocked.groupBy(target, bucket.alias("__b")).agg(F.collect_set(molecule).alias("__out"))  # no more than a bucket
    met = asked.join(out, [target, "__b"], "left").join(pool, "__b", "left")
    free = F.when(F.col("__out").isNull(), F.col("__pool")).otherwise(F.array_except("__pool", "__out"))
    met = met.select("pair_id", "__pos", target, F.filter(free, lambda m: m != F.col("__pos")).alias("__free"))
    order = lambda m: F.struct(md5_order(F.col("pair_id"), m, seed=seed).alias("k"), m.alias("m"))
    drawn = met.groupBy("pair_id", "__pos", target).agg(F.flatten(F.collect_list("__free")).alias("__free"))  # at most ``draws`` buckets
    drawn = drawn.select("pair_id", "__pos", target, F.transform(F.slice(F.sort_array(F.transform("__free", order)), 1, per_positive), lambda x: x["m"]).alias("__mols"))
    drawn = cut_lineage(drawn)
    full = drawn.filter(F.size("__mols") == per_positive).select("pair_id", target, F.posexplode("__mols").alias("rank", molecule)).select("pair_id", molecule, target, (F.col("rank") + 1).alias("rank"))
    short = drawn.filter(F.size("__mols") < per_positive).select("pair_id", "__pos", target)
    return full if short.isEmpty() else full.unionByName(_draw_again(short, mols, blocked, molecule, target, per_positive, seed))


def _draw_again(short: DataFrame, molecules: DataFrame, blocked: DataFrame, molecule: str, target: str, per_positive: int, seed: str) -> DataFrame:
    """Negatives of the pairs that the buckets left short, out of every molecule that their target allows.

    The allowed molecules of a target are numbered in a fixed shuffle (per hash range, as in ``stratified_folds``) and
    cut into ``per_positive`` + 1 equal stretches, one more than needed as the positive itself may stand among them; the
    pair takes one of each stretch by its hash.  So a pair costs that many rows however many molecules are allowed.
    """
    targets = short.select(target).distinct()
    allowed = molecules.crossJoin(targets).join(blocked, [molecule, target], "left_anti")
    allowed = allowed.withColumn("__k", md5_order(F.col(target), F.col(molecule), seed=seed)).withColumn("__r", F.substring("__k", 1, 2))
    sizes = allowed.groupBy(target, "__r").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(target)
    before = F.sum("__n").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(target, "__r", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(target, "__r").orderBy("__k", molecule)) - 1
    numbered = allowed.withColumn("__place", place).join(offsets, [target, "__r"]).select(target, molecule, (F.col("__place") + F.col("__before")).alias("__i"))
    totals = sizes.groupBy(target).agg(F.sum("__n").alias("__e")).filter(F.col("__e") >= per_positive)
    asked = short.join(totals, target).withColumn("__s", F.least(F.col("__e"), F.lit(per_positive + 1)))
    asked = asked.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__s") - 1)))
    asked = asked.withColumn("__low", F.expr("__j * __e div __s")).withColumn("__width", F.expr("(__j + 1) * __e div __s") - F.col("__low"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("again"), F.col("pair_id"), F.col("__j"))), 1, 8), 16, 10).cast("long")
    asked = asked.select("pair_id", "__pos", target, (F.col("__low") + F.pmod(number, F.col("__width"))).alias("__i"))
    met = asked.join(numbered, [target, "__i"]).filter(F.col(molecule) != F.col("__pos"))
    whole = Window.partitionBy("pair_id")
    rank = F.row_number().over(whole.orderBy(md5_order(F.col("pair_id"), F.col(molecule), seed=seed), F.col(molecule)))
    picked = met.withColumn("rank", rank).filter(F.col("rank") <= per_positive).withColumn("__n", F.count(F.lit(1)).over(whole))
    return picked.filter(F.col("__n") == per_positive).select("pair_id", molecule, target, "rank")


def negative_rows(negatives: DataFrame, positives: DataFrame, molecules: DataFrame, molecule: str, molecule_fields: list[str], nulled: list[str]) -> DataFrame:
    """Full rows of sampled negatives: the positive's row with the molecule's fields replaced and measured ones nulled.

    Year, organism and target stay the positive's, so that a pair stays on one side of a split in time.
    """
    kept = [c for c in positives.columns if c not in (molecule, *molecule_fields)]
    blank = {c: F.lit(None).cast(dict(positives.dtypes)[c]).alias(c) for c in nulled}
    base = positives.select(*(blank.get(c, F.col(c)) for c in kept))
    out = negatives.select("pair_id", molecule).join(base, "pair_id").join(molecules.select(molecule, *molecule_fields), molecule)
    return out.withColumn("set_type", F.lit("Negative")).withColumn("label", F.lit("Assumed_Inactive"))


def pair_metrics(df: DataFrame, pair: str, target: str, fold: str | None = "cv_fold", min_neg: int = 10, max_neg: int = 10) -> DataFrame:
    """One row of seven counters of pairs that break a rule, and the number of pairs."""
    g = df.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("set_type") == "Positive").alias("pos"),
        F.count_if(F.col("set_type") == "Negative").alias("neg"),
        F.count_distinct(target).alias("targets"),
        (F.count_distinct(fold) if fold else F.lit(1)).alias("folds"),
    )
    count = lambda c, name: F.count_if(c).alias(name)
    return g.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        count(F.col("n") < 1 + min_neg, "rows_below"),
        count(F.col("n") > 1 + max_neg, "rows_above"),
        count(F.col("pos") != 1, "positives_not_one"),
        count(F.col("neg") < min_neg, "negatives_below"),
        count(F.col("neg") > max_neg, "negatives_above"),
        count(F.col("targets") != 1, "targets_not_one"),
        count(F.col("folds") != 1, "folds_not_one"),
    )


def assert_pairs(df: DataFrame, context: str, **kwargs) -> DataFrame:
    """The same frame, or ValueError with the counters that are not zero."""
    row = pair_metrics(df, **kwargs).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_pairs" and v}
    if broken:
        raise ValueError(f"{context}: {broken}")
    return df


def validation_report(df: DataFrame, pair: str, target: str, molecule: str, atoms: str, um: str, most_atoms: int = 80, full: int = 11) -> DataFrame:
    """One row of counts of what a training set must not hold, with its rows and its largest molecule.

    Rows without a pair belong to none; (molecule, target) on both sides needs both known.
    """
    kind, v = F.col("set_type"), F.nanvl(F.col(um), F.lit(None).cast("double"))
    whole = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(atoms).alias("max_heavy_atoms"), F.count_if(F.col(atoms) > most_atoms).alias("heavy_atoms_over"), F.count_if((kind == "Positive") & (v >= 10)).alias("positives_weak"),
        F.count_if((kind == "Negative") & (v < 500)).alias("negatives_strong"), F.count_if(~F.coalesce(kind.isin("Positive", "Negative"), F.lit(False))).alias("bad_set_type"),
    )
    g = df.filter(F.col(pair).isNotNull()).groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("t"), F.count_distinct("cv_fold").alias("f"))
    by_pair = g.agg(F.count_if(F.col("n") != full).alias("pairs_not_full"), F.count_if(F.col("t") != 1).alias("pairs_of_targets"), F.count_if(F.col("f") != 1).alias("pairs_of_folds"))
    known = df.dropna(subset=[molecule, target]).groupBy(molecule, target).agg(F.max((kind == "Positive").cast("int")).alias("a"), F.max((kind == "Negative").cast("int")).alias("b"))
    both = known.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("pos_neg_overlap"))
    return whole.crossJoin(by_pair).crossJoin(both)  # one row each


def plain_folds(pairs: DataFrame, pair: str, folds: int = 10, seed: str = "42") -> DataFrame:
    """(pair, fold 1..folds): all pairs in a fixed shuffle, cut into folds of equal size, the first ones larger by one.

    Places are counted in ranges of the shuffle, so no task orders all pairs.
    """
    d = sums_before(pairs.select(pair).distinct().withColumn("__k", md5_order(F.col(pair), seed=seed)).withColumn("__1", F.lit(1)), [], ["__k", pair], ["__1"])
    n = d.agg(F.count(F.lit(1)).alias("__n"))
    place, size, rest = F.col("before___1"), F.expr(f"__n div {folds}"), F.col("__n") % folds
    fold = F.when(place < rest * (size + 1), F.floor(place / (size + 1))).otherwise(rest + F.floor((place - rest * (size + 1)) / F.greatest(size, F.lit(1))))
    return d.crossJoin(F.broadcast(n)).select(pair, (fold + 1).cast("int").alias("fold"))  # one row


def given_folds(df: DataFrame, fold: str) -> DataFrame:
    """Adds ``fold`` as the table gives it, as a whole number; what is none becomes NULL."""
    return df.withColumn("fold", F.col(fold).try_cast("long"))


def row_time_split(df: DataFrame, year: str, cutoff: int) -> DataFrame:
    """Adds ``side`` (past, later, unknown) row by row; unlike ``temporal_split`` it may part the rows of a pair."""
    return df.withColumn("side", F.when(F.col(year) <= cutoff, "past").when(F.col(year) > cutoff, "later").otherwise("unknown"))


def stratified_folds(pairs: DataFrame, pair: str, stratum: str, folds: int = 10, seed: str = "42") -> DataFrame:
    """(pair, stratum, fold 1..folds): pairs of a stratum are dealt in a fixed shuffle, each stratum from its own start.

    The place of a pair in its stratum is counted per hash range, so that a stratum of any size is dealt by many tasks:
    ranges of the shuffle key are ordered, each counts its own pairs, and the counts before a range are its offset.
    """
    d = pairs.select(pair, stratum).distinct().withColumn("__k", md5_order(F.col(pair), seed=seed)).withColumn("__r", F.substring("__k", 1, 2))
    sizes = d.groupBy(stratum, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(stratum).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(stratum, "__r").orderBy("__k", pair)) - 1
    start = hash_bucket(F.coalesce(F.col(stratum).cast("string"), F.lit("")), folds, seed)
    joined = d.withColumn("__place", place).join(offsets.withColumnRenamed(stratum, "__s"), F.col(stratum).eqNullSafe(F.col("__s")) & (d["__r"] == offsets["__r"]))
    return joined.select(pair, stratum, (F.pmod(F.col("__place") + F.col("__before") + start, F.lit(folds)) + 1).cast("int").alias("fold"))


def group_folds(df: DataFrame, groups: list[str], folds: int = 10, seed: str = "42") -> DataFrame:
    """(groups, n_rows, fold 0..folds-1) for all rows of a group, with folds about equally full.

    The largest groups (more than a thousandth of the rows, hence fewer than a thousand) are packed largest first into
    the emptiest fold on the driver; all others are hashed, which evens out as they are many and small.
    """
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.count()
    large = sizes.filter(F.col("n_rows") > total / 1000).orderBy(F.col("n_rows").desc(), *groups).collect()
    load = [0] * folds
    placed = []
    for r in large:
        f = min(range(folds), key=lambda i: (load[i], i))
        load[f] += r["n_rows"]
        placed.append((*(r[g] for g in groups), f))
    name = F.concat_ws("|", *(F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups))
    hashed = hash_bucket(name, folds, seed)
    if not placed:
        return sizes.withColumn("fold", hashed)
    schema = ", ".join(f"`__{g}` {dict(df.dtypes)[g]}" for g in groups) + ", __fold int"
    fixed = df.sparkSession.createDataFrame(placed, schema)
    on = [sizes[g].eqNullSafe(fixed[f"__{g}"]) for g in groups]
    return sizes.join(F.broadcast(fixed), on, "left").select(*groups, "n_rows", F.coalesce("__fold", hashed).alias("fold"))  # fewer than a thousand rows


def temporal_split(df: DataFrame, pair: str, year: str, cutoff: int) -> DataFrame:
    """Adds ``pair_year`` and ``is_future``: pairs go to the future as a whole, by the year of their one positive.

    A pair without exactly one positive takes its latest year; an unknown year counts as past.
    """
    g = df.groupBy(pair).agg(
        F.count_if(F.col("set_type") == "Positive").alias("__pos"), F.max(F.when(F.col("set_type") == "Positive", F.col(year))).alias("__year"), F.max(year).alias("__any")
    )
    by_pair = g.select(F.col(pair), F.when(F.col("__pos") == 1, F.col("__year")).otherwise(F.col("__any")).alias("pair_year"))
    return df.join(by_pair, pair).withColumn("is_future", F.coalesce(F.col("pair_year") > cutoff, F.lit(False)))


def trim_negatives(df: DataFrame, pair: str, max_neg: int, molecule: str = "molregno", um: str = "activity_um", year: str = "publication_year", row: str = "row_id") -> DataFrame:
    """Positives, and at most ``max_neg`` negatives per pair: measured first, weakest first, oldest first, then by id."""
    v = F.nanvl(F.col(um), F.lit(None).cast("double"))
    w = Window.partitionBy(pair).orderBy(v.isNull(), v.desc(), F.col(year).asc_nulls_last(), F.col(molecule).asc_nulls_last(), F.col(row))
    neg = df.filter("set_type = 'Negative'").withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_neg).drop("__rn")
    return df.filter("set_type = 'Positive'").unionByName(neg)


def quota_fill(have: DataFrame, candidates: DataFrame, pair: str, target: str, molecule: str, quota: int, seed: str = "42") -> DataFrame:
    """(pair, molecule, tier): negatives that fill each pair up to ``quota``, tier 1 before tier 2, in a fixed shuffle.

    ``have``: the present negatives and positives (pair, target, molecule, set_type); ``candidates``: (target, molecule,
    tier).  Molecules already in the pair are left out, repeated rows of a pair count once.  A pair of m molecules can
    use only the first quota + m candidates of its target and tier in the shuffle of the target, so no pair meets a whole
    target: those of usual size (m <= quota + 1) share one short list, cut by a group limit before the shuffle; the few
    larger ones meet a list as long as they need.
    """
    need = have.groupBy(pair).agg(F.min(target).alias(target), F.count_if(F.col("set_type") == "Negative").alias("n_neg"), F.count_distinct(molecule).alias("__m")).filter(F.col("n_neg") < quota)
    wt = Window.partitionBy(target, "tier").orderBy(md5_order(F.col(target), F.col(molecule), seed=seed), F.col(molecule))
    ranked = candidates.select(target, molecule, "tier").distinct().withColumn("__rn", F.row_number().over(wt))
    usual = need.filter(F.col("__m") <= quota + 1).join(ranked.filter(F.col("__rn") <= 2 * quota + 1).drop("__rn"), target)
    large = need.filter(F.col("__m") > quota + 1)
    deepest = large.groupBy(target).agg((F.max("__m") + quota).alias("__deep"))
    deep = ranked.join(deepest, target).filter(F.col("__rn") <= F.col("__deep")).drop("__deep")
    large = large.join(deep, target).filter(F.col("__rn") <= F.col("__m") + quota).drop("__rn")
    offered = usual.unionByName(large).join(have.select(pair, molecule).distinct(), [pair, molecule], "left_anti")
    wp = Window.partitionBy(pair).orderBy("tier", md5_order(F.col(target), F.col(molecule), seed=seed), F.col(molecule))
    return offered.withColumn("__rn", F.row_number().over(wp)).filter(F.col("__rn") <= F.lit(quota) - F.col("n_neg")).select(pair, molecule, "tier")


def shortage_log(have: DataFrame, added: DataFrame, pair: str, target: str, quota: int) -> DataFrame:
    """(pair, target, have_neg, need, added, shortage) of pairs that were short of the quota."""
    h = have.groupBy(pair).agg(F.min(target).alias(target), F.count_if(F.col("set_type") == "Negative").alias("have_neg")).filter(F.col("have_neg") < quota)
    a = added.groupBy(pair).agg(F.count(F.lit(1)).alias("added"))
    out = h.join(a, pair, "left").na.fill(0, ["added"]).withColumn("need", F.lit(quota) - F.col("have_neg"))
    return out.withColumn("shortage", F.col("need") - F.col("added"))


def stratified_subset(groups: DataFrame, group: str, strata: list[str], ratio: float, least: int = 1, seed: str = "42") -> DataFrame:
    """Groups of every stratum: min(n, max(least, round half even(n x ratio))) of them, by a fixed shuffle.

    ``groups`` has one row per group.  Strata compare NULL as a value of its own.
    """
    placed = sums_before(groups.withColumn("__k", md5_order(F.col(group), seed=seed)).withColumn("__1", F.lit(1)), strata, ["__k", group], ["__1"])
    sizes = placed.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    keep = F.least(F.col("__n"), F.greatest(F.lit(least), F.bround(F.col("__n") * F.lit(float(ratio)))))
    quota = sizes.select(*(F.col(s).alias(f"__{s}") for s in strata), keep.alias("__keep"))
    on = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata]
    return placed.join(quota, on).filter(F.col("before___1") < F.col("__keep")).select(*groups.columns)


def capped_sample(df: DataFrame, stratum: str, row: str, most: int, seed: str = "42") -> DataFrame:
    """All rows of a stratum, or ``most`` of them by a fixed shuffle; the group limit prunes before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(md5_order(F.col(row), seed=seed), F.col(row))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_class) for both classes; 1 where there is one class only."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return g.crossJoin(F.broadcast(total)).select(label, "n", F.when(F.col("k") < 2, 1.0).otherwise(F.col("all") / (2.0 * F.col("n"))).alias("weight"))  # one row


def pair_manifest(df: DataFrame, pair: str, molecule: str, quota: int = 10) -> DataFrame:
    """Pairs with fewer, exactly and more negatives than the quota, and molecules repeated within a pair."""
    g = df.groupBy(pair).agg(F.count_if(F.col("set_type") == "Negative").alias("neg"), (F.count(molecule) - F.count_distinct(molecule)).alias("repeats"))
    return g.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("neg") < quota).alias("below"), F.count_if(F.col("neg") == quota).alias("exact"),
        F.count_if(F.col("neg") > quota).alias("above"), F.sum("repeats").alias("repeated_molecules"),
    )
