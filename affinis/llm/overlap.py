"""Same or near-same records across splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.scaffold_text import canonical_tokens, elements
from affinis.session import cut_lineage

#: Atoms that may be changed, added or missing between almost equal scaffolds.
EDITS = 2
#: Shingle lengths by the shorter partner's number of atoms: a length q needs (EDITS + 1) * q atoms, so that EDITS
#: edits cannot touch every shingle of a prefix.  Pairs below the last bound compare by a shingle of no atoms.
LEVELS = ((7, 21), (3, 9), (1, 3), (0, 0))
#: Shingle frequencies are counted in this many hash buckets, so the table that orders shingles has a fixed size.
RARITY_BUCKETS = 1 << 16
#: Lengths and positions are joined in bands of this width; the evaluation side stands in every band it can reach.
BAND = 5
#: Chains up to this length are compared inside the join; longer ones after it, once for each pair.
SHORT_CHAIN = 256
#: Rows of one class that a task pairs with as many of another class.
PAIR_BLOCK = 1000

_GRAMS = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("pos", T.IntegerType())]))


def hash_text(text: str) -> int:
    """A 64-bit hash (FNV-1a) that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _flatten(chains: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(atom hashes of all chains, start of each chain, length of each chain)."""
    split = [c.split(" ") for c in chains]
    memo = {a: np.uint64(hash_text(a)) for a in {a for c in split for a in c}}
    lengths = np.array([len(c) for c in split], np.int64)
    flat = np.array([memo[a] for c in split for a in c], np.uint64)
    return flat, np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64), lengths


def _shingles(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chain, shingle, position, q) of every shingle of every level in which a chain may have a partner.

    A pair belongs to the level of its shorter partner, so a chain joins every level of the lengths around its own.
    """
    chain, gram, pos, qs = [], [], [], []
    above = 1 << 30
    for level, (q, least) in enumerate(LEVELS):
        own = np.flatnonzero((lengths >= least) & (lengths - EDITS < above))
        above = least
        if not len(own):
            continue
        n = lengths[own] - q + 1 if q else np.ones(len(own), np.int64)
        which = np.repeat(own, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        h = np.full(len(which), level + 1, np.uint64)
        for j in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[starts[which] + at + j]
            h ^= h >> np.uint64(29)
        chain.append(which)
        gram.append(h.view(np.int64))
        pos.append(at)
        qs.append(np.full(len(which), q))
    if not chain:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (chain, gram, pos, qs))


def _prefix_length(grams: list[int], places: list[int], q: int) -> int:
    """How many of the shingles, rarest first, EDITS edits cannot all destroy: one edit meets q starts in a row."""
    if q == 0:
        return len(grams)
    for i in range(EDITS, len(grams)):
        if i + 1 < len(grams) and grams[i + 1] == grams[i]:
            continue  # all places of a shingle come together
        touched, end = 0, -1
        for p in sorted(places[: i + 1]):
            if p >= end:
                touched, end = touched + 1, p + q
        if touched > EDITS:
            return i + 1
    return len(grams)


def prefixes(chains: pd.Series, rarity: np.ndarray) -> list[list[tuple[int, int]]]:
    """(shingle, position) of the prefix of each atom chain, in every level of the chain."""
    flat, starts, lengths = _flatten(chains)
    chain, gram, pos, q = _shingles(flat, starts, lengths)
    order = np.lexsort((gram, rarity[gram & (RARITY_BUCKETS - 1)], q, chain))
    chain, gram, pos, q = chain[order], gram[order].tolist(), pos[order].tolist(), q[order]
    cuts = np.flatnonzero(np.r_[True, (chain[1:] != chain[:-1]) | (q[1:] != q[:-1])]) if len(chain) else np.zeros(0, np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(lengths))]
    for a, b in zip(cuts, np.r_[cuts[1:], len(chain)]):
        n = _prefix_length(gram[a:b], pos[a:b], int(q[a]))
        out[chain[a]].extend(zip(gram[a : a + n], pos[a : a + n]))
    return out


def _one_letter(atom: str) -> str:
    """A character for an atom; longer symbols get one from the private planes, where two might meet by chance.

    Such a meeting could only make chains look closer, and the exact check looks at the symbols.
    """
    return atom if len(atom) == 1 else chr(0xF0000 + hash_text(atom) % 131_000)


_WRITTEN = T.StructType([T.StructField(c, T.StringType()) for c in ("body", "rings", "atoms", "code")])


@F.pandas_udf(_WRITTEN)
def _write(scaffold: pd.Series) -> pd.DataFrame:
    """body: elements and ring numbers; rings: the latter; atoms: the elements; code: one letter for each element."""
    rows = []
    for s in scaffold:
        body, rings = elements(canonical_tokens(s))
        chain = [t for t in body if "@" not in t]
        rows.append((" ".join(body), " ".join(rings), " ".join(chain), "".join(map(_one_letter, chain))) if chain else (None,) * 4)
    return pd.DataFrame(rows, columns=_WRITTEN.names)


# Not deterministic for the optimiser: else a filter on the result moves below the aggregate, and runs for every row.
_write = _write.asNondeterministic()


def _count_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros(RARITY_BUCKETS, np.int64)
    for d in frames:
        gram = _shingles(*_flatten(d["atoms"]))[1]
        count += np.bincount(gram & (RARITY_BUCKETS - 1), minlength=RARITY_BUCKETS)
    at = np.flatnonzero(count)
    yield pd.DataFrame({"bucket": at.astype("int32"), "n": count[at]})


def _edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of two lists, or most + 1 if it is larger; only the diagonal band is computed.

    Ring numbers stay as they are: they are neither changed nor added.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    free_a, free_b = [0 if "@" in x else 1 for x in a], [0 if "@" in x else 1 for x in b]
    before = [0]
    for j, free in enumerate(free_b):
        before.append(min(before[j] + 1 if free else far, far))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [far] * (len(b) + 1)
        out = 1 if free_a[i - 1] else far
        now[0] = min(before[0] + out, far)
        for j in range(low, high + 1):
            change = 0 if x == b[j - 1] else 1 if free_a[i - 1] and free_b[j - 1] else far
            now[j] = min(before[j - 1] + change, before[j] + out, now[j - 1] + (1 if free_b[j - 1] else far), far)
        if min(now[low - 1 : high + 1]) > most:
            return far
        before = now
    return before[len(b)]


@F.pandas_udf(T.BooleanType())
def _almost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_edit_distance(x.split(" "), y.split(" "), EDITS) <= EDITS for x, y in zip(a, b)], dtype=bool)


_almost = _almost.asNondeterministic()  # for the same reason as _write: after the distinct, not before


def near_pairs(chains: DataFrame) -> DataFrame:
    """(eval_class, train_class) of chains at most EDITS atoms apart, for chains (atoms, code, in_eval, in_train).

    With ``body`` and ``rings`` (see ``_write``) chains have ring numbers, which must agree; a class is then a body,
    else the atoms.  An exact prefix-filter join: the rarest shingles of every chain, as few as EDITS edits cannot all
    destroy, are matched between evaluation (indexed) and training (probing); partners have the same ring numbers, and
    differ by at most EDITS in length and in a shared shingle's position; the edit distance is then computed.
    """
    spark = chains.sparkSession
    if "body" not in chains.columns:
        chains = chains.withColumn("body", F.col("atoms")).withColumn("rings", F.lit(""))
    counted = chains.select("atoms").mapInPandas(_count_shingles, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # RARITY_BUCKETS numbers at most
    rarity = np.zeros(RARITY_BUCKETS, np.int64)
    for r in counted:
        rarity[r["bucket"]] = r["n"]
    shared = spark.sparkContext.broadcast(rarity)  # half a megabyte, whatever the data

    def prefix_of(chain: pd.Series) -> pd.Series:
        return pd.Series(prefixes(chain, shared.value))

    prefix = F.pandas_udf(prefix_of, _GRAMS)
    # rows of the join carry numbers for the chain and its rings and, for chains of usual length, its code
    short = F.when(F.length("code") <= SHORT_CHAIN, F.col("code"))
    indexed = chains.select(
        F.xxhash64("body").alias("id"), F.xxhash64("rings").alias("rings"), short.alias("code"), "in_eval", "in_train", F.length("code").alias("len"), F.explode(prefix("atoms")).alias("g")
    ).select("id", "rings", "code", "in_eval", "in_train", "len", "g.gram", "g.pos")
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - EDITS) / BAND), F.floor((F.col(c) + EDITS) / BAND)))
    e = indexed.filter("in_eval").select("gram", "rings", F.col("id").alias("e_id"), F.col("code").alias("e_code"), F.col("len").alias("e_len"), F.col("pos").alias("e_pos"))
    e = e.withColumn("len_band", reach("e_len")).withColumn("pos_band", reach("e_pos"))
    t = indexed.filter("in_train").select("gram", "rings", F.col("id").alias("t_id"), F.col("code").alias("t_code"), F.col("len").alias("t_len"), F.col("pos").alias("t_pos"))
    t = t.withColumn("len_band", F.floor(F.col("t_len") / BAND)).withColumn("pos_band", F.floor(F.col("t_pos") / BAND))
    near = (F.abs(F.col("e_len") - F.col("t_len")) <= EDITS) & (F.abs(F.col("e_pos") - F.col("t_pos")) <= EDITS) & (F.col("e_id") != F.col("t_id"))
    # the built-in distance with a bound runs in the join's own stage; few pairs are left for the shuffle and the check
    close = F.coalesce(F.levenshtein("e_code", "t_code", EDITS) >= 0, F.lit(True))
    found = e.join(t, ["gram", "rings", "len_band", "pos_band"]).filter(near).filter(close).select("e_id", "t_id").distinct()
    named = lambda side, flag: chains.filter(flag).select(F.xxhash64("body").alias(f"{side[0]}_id"), F.col("body").alias(f"{side}_class"))
    pairs = found.join(named("eval", "in_eval"), "e_id").join(named("train", "in_train"), "t_id").select("eval_class", "train_class")
    return pairs.filter(_almost("eval_class", "train_class"))


def _base(df: DataFrame, row: str, molecule: Column, scaffold: Column, is_eval: Column, is_train: Column, extra: dict[str, Column]) -> DataFrame:
    """The rows of both splits: __row, __mol, __scaffold, __eval and the extra columns, written once for all steps."""
    return cut_lineage(df.select(
        F.col(row).alias("__row"), molecule.alias("__mol"), F.nullif(F.trim(scaffold), F.lit("")).alias("__scaffold"),
        F.when(is_eval, True).when(is_train, False).alias("__eval"), *(c.alias(n) for n, c in extra.items()),
    ).filter("__eval IS NOT NULL"))


def scaffold_classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: __scaffold, class, n_eval, n_train; links: eval_class, train_class) of the distinct scaffold writings of both splits.

    A class is one writing of a ring system; links join the classes that are the same or almost the same and stand on
    either side.  Scaffolds are compared once for each class, not for each row.
    """
    written = base.filter("__scaffold IS NOT NULL").groupBy("__scaffold").agg(F.count_if("__eval").alias("n_eval"), F.count_if(~F.col("__eval")).alias("n_train"))
    classed = written.select("__scaffold", "n_eval", "n_train", _write("__scaffold").alias("w")).select("__scaffold", "n_eval", "n_train", "w.*").filter("body IS NOT NULL")
    classed = cut_lineage(classed)
    chains = classed.groupBy("body").agg(*(F.first(c).alias(c) for c in ("rings", "atoms", "code")), (F.sum("n_eval") > 0).alias("in_eval"), (F.sum("n_train") > 0).alias("in_train"))
    same = chains.filter("in_eval AND in_train").select(F.col("body").alias("eval_class"), F.col("body").alias("train_class"))
    return classed.select("__scaffold", F.col("body").alias("class"), "n_eval", "n_train"), cut_lineage(same.unionByName(near_pairs(chains)))


def _every_pair(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The join on ``key``, in which a key of many rows on both sides is spread as a grid of blocks over many tasks.

    ``sizes`` (key, l, r) has the rows of each key on either side.
    """
    blocks = lambda c: F.ceil(F.col(c) / PAIR_BLOCK).cast("int")
    hot = sizes.filter(F.col("l") * F.col("r") > PAIR_BLOCK * PAIR_BLOCK).select(key, blocks("l").alias("__nl"), blocks("r").alias("__nr"))
    one = F.lit(1)

    def placed(d: DataFrame, own: str, other: str, row: str) -> DataFrame:
        d = d.join(hot, key, "left").withColumn(f"{own}_block", F.pmod(F.xxhash64(row), F.coalesce(f"__n{own}", one)).cast("int"))
        return d.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.coalesce(f"__n{other}", one) - 1))).drop("__nl", "__nr")

    return placed(left, "l", "r", "eval_row").join(placed(right, "r", "l", "train_row"), [key, "l_block", "r_block"]).drop(key, "l_block", "r_block")


def cross_split_overlap(
    df: DataFrame,
    row: str,
    molecule: Column,
    scaffold: Column,
    is_eval: Column,
    is_train: Column,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Every pair of an evaluation and a training row with the same molecule or the same or almost the same scaffold.

    Scaffolds are the same if they write one ring system (ring numbering, stereo marks and counter-ions aside), and
    almost the same if beyond that at most EDITS atoms, each with the bond before it, are changed or added.

    Result: ``eval_row``, ``train_row`` and, prefixed ``eval_`` and ``train_``, the ``extra`` columns.  Rows of neither
    split take no part; NULL molecules and NULL or empty scaffolds match nothing; repeated rows pair like any others;
    an empty table gives no pairs.  Rows meet only through the classes that overlap, so the shuffle grows with rows and
    found pairs; a class of many rows on both sides is spread over tasks.  ``overlap_counts`` counts the pairs without
    writing them out.
    """
    extra = extra or {}
    base = _base(df, row, molecule, scaffold, is_eval, is_train, extra)
    side = lambda d, e, *keep: d.filter(F.col("__eval") == F.lit(e)).select(
        *keep, *(F.col(c).alias(("eval_" if e else "train_") + c.removeprefix("__")) for c in ("__row", *extra))
    )
    has_mol = base.filter("__mol IS NOT NULL")
    sizes = cut_lineage(has_mol.groupBy("__mol").agg(F.count_if("__eval").alias("l"), F.count_if(~F.col("__eval")).alias("r")).filter("l > 0 AND r > 0"))
    by_mol = _every_pair(side(has_mol, True, "__mol"), side(has_mol, False, "__mol"), sizes, "__mol")
    members, links = scaffold_classes(base)
    e_rows = links.join(members.select("__scaffold", F.col("class").alias("eval_class")), "eval_class").select("__scaffold", "train_class")
    t_rows = links.select("train_class").distinct().join(members.select("__scaffold", F.col("class").alias("train_class")), "train_class")
    rows = base.filter("__scaffold IS NOT NULL")
    left = side(rows, True, "__scaffold", F.col("__mol").alias("eval_mol")).join(e_rows, "__scaffold").drop("__scaffold")
    right = side(rows, False, "__scaffold", F.col("__mol").alias("train_mol")).join(t_rows, "__scaffold").drop("__scaffold")
    # pairs of one molecule are there already
    n = members.groupBy("class").agg(F.sum("n_eval").alias("n_eval"), F.sum("n_train").alias("n_train"))
    l = links.join(n.withColumnRenamed("class", "eval_class"), "eval_class").groupBy("train_class").agg(F.sum("n_eval").alias("l"))  # noqa: E741
    sizes = l.join(n.select(F.col("class").alias("train_class"), F.col("n_train").alias("r")), "train_class")
    by_scaffold = _every_pair(left, right, sizes, "train_class").filter(~F.coalesce(F.col("eval_mol") == F.col("train_mol"), F.lit(False))).drop("eval_mol", "train_mol")
    return by_mol.unionByName(by_scaffold)


def overlap_counts(
    df: DataFrame,
    row: str,
    molecule: Column,
    scaffold: Column,
    is_eval: Column,
    is_train: Column,
    by: dict[str, Column],
) -> DataFrame:
    """``n_pairs``, ``n_eval_rows`` and ``n_train_rows`` of the overlaps for each group ``by`` of evaluation rows.

    The pairs of ``cross_split_overlap`` are counted, not written: rows become counts per (molecule, class), so a class
    of any size costs a few numbers.  Pairs by molecule and by scaffold are added, those by both taken off once.
    """
    names = list(by)
    base = _base(df, row, molecule, scaffold, is_eval, is_train, by)
    members, links = scaffold_classes(base)
    units = base.join(members.select("__scaffold", "class"), "__scaffold", "left").groupBy("__eval", "__mol", "class", *names).agg(F.count(F.lit(1)).alias("n"))
    units = cut_lineage(units)
    e = units.filter("__eval").select(F.col("__mol").alias("mol"), F.col("class").alias("eval_class"), F.struct(*names).alias("g"), "n")
    t = units.filter("NOT __eval").groupBy(F.col("__mol").alias("mol"), F.col("class").alias("train_class")).agg(F.sum("n").alias("n"))
    by_mol = t.filter("mol IS NOT NULL").groupBy("mol").agg(F.sum("n").alias("n_mol"))
    by_class = t.groupBy("train_class").agg(F.sum("n").alias("n")).join(links, "train_class").groupBy("eval_class").agg(F.sum("n").alias("n_class"))
    shared = t.filter("mol IS NOT NULL").join(e.select("mol").distinct(), "mol", "left_semi")
    by_both = shared.join(links, "train_class").groupBy("mol", "eval_class").agg(F.sum("n").alias("n_both"))
    met = e.join(by_mol, "mol", "left").join(by_class, "eval_class", "left").join(by_both, ["mol", "eval_class"], "left").na.fill(0, ["n_mol", "n_class", "n_both"])
    pairs = F.col("n_mol") + F.col("n_class") - F.col("n_both")
    left = met.filter(pairs > 0).groupBy("g").agg(F.sum(F.col("n") * pairs).alias("n_pairs"), F.sum("n").alias("n_eval_rows"))
    # the groups that a training row overlaps with: no more than there are groups
    g_mol = e.filter("mol IS NOT NULL").groupBy("mol").agg(F.collect_set("g").alias("a"))
    g_class = e.join(links, "eval_class").groupBy("train_class").agg(F.collect_set("g").alias("b"))
    none = F.array().cast(g_mol.schema["a"].dataType)
    groups = F.array_union(F.coalesce("a", none), F.coalesce("b", none))
    right = t.join(g_mol, "mol", "left").join(g_class, "train_class", "left").select("n", F.explode(groups).alias("g")).groupBy("g").agg(F.sum("n").alias("n_train_rows"))
    return left.join(right, "g").select("g.*", "n_pairs", "n_eval_rows", "n_train_rows")
