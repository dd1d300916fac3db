"""Perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinreel.constants import HASH_BITS, LEAST_ENERGY


def without_dc(coefficients: Column) -> Column:
    """The coefficients with the first (the mean level) set to zero."""
    return F.concat(F.array(F.lit(0.0).cast("float")), F.slice(coefficients, 2, HASH_BITS - 1))


def median_hash(coefficients: Column) -> Column:
    """64-bit hash of 64 coefficients: bit 63-i is set where coefficient i is above the median."""
    sorted_ = F.array_sort(coefficients)
    median = (sorted_[HASH_BITS // 2 - 1] + sorted_[HASH_BITS // 2]) / 2
    bits = F.zip_with(coefficients, F.sequence(F.lit(HASH_BITS - 1), F.lit(0)), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(
        F.array(F.struct(bits.alias("bits"), median.alias("m"))),
        F.lit(0).cast("long"),
        lambda acc, x: F.aggregate(x["bits"], acc, lambda a, b: a.bitwiseOR(F.when(b["c"] > x["m"], F.call_function("shiftleft", F.lit(1).cast("long"), b["i"])).otherwise(F.lit(0).cast("long")))),
    )


def energy(coefficients: Column) -> Column:
    """Mean absolute coefficient."""
    return F.aggregate(F.transform(coefficients, lambda c: F.abs(c.cast("double"))), F.lit(0.0), lambda a, c: a + c) / HASH_BITS


def featureless(coefficients: Column) -> Column:
    return energy(coefficients) < LEAST_ENERGY


def popcount(value: Column) -> Column:
    return F.bit_count(value).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def block(value: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def hash_text(text: Column) -> Column:
    """60-bit hash of a text, for content that has no pixels."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
