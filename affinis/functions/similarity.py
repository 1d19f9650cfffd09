"""Similarity kernels as column expressions, for small frames and checks; operators.similarity has the block kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(words: Column) -> Column:
    """Set bits of a packed fingerprint (array of longs; the sign bit is a bit like any other)."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over bits of either; 0 where neither has any."""
    inter = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    union = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union)


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def shape_similarity(a: Column, b: Column, dims: int = 18) -> Column:
    """1 / (1 + d / dims) for the least L1 distance between conformers (arrays of arrays); NULL without conformers."""
    least = F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: l1_distance(x, y)))))
    return 1.0 / (1.0 + least / F.lit(float(dims)))


def pack_signs(values: Column, words: int = 2, bits: int = 32) -> Column:
    """The signs of the first words x bits values as a packed fingerprint."""
    one = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(F.element_at(values, (i + w * bits + 1).cast("int")) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.array(*(one(w) for w in range(words)))


def pack_bits(on: Column, size: int = 1024, bits: int = 64) -> Column:
    """A packed fingerprint from the list of set bits, numbered from 1."""
    word = lambda w: F.aggregate(
        F.array_distinct(F.filter(on, lambda b: F.floor((b - 1) / bits) == w)), F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b - 1, F.lit(bits)).cast("int"))),
    )
    return F.array(*(word(w) for w in range(size // bits)))
