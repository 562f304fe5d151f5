"""Column functions for read pairs between two contigs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The roundings of 1/sqrt(2 pi) and 1/sqrt(2) that the rules use.
DENSITY, PAIR_DENSITY, SCALE = 0.4, 0.39894, 0.7
#: P and a1..a5 of the rational approximation of erf (Abramowitz and Stegun 7.1.26).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Within 1.5e-7; Spark has none of its own."""
    p, *a = ERF
    t = F.lit(1.0) / (F.lit(1.0) + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def density(x: Column) -> Column:
    return DENSITY * F.exp(-x * x / 2)


def overhang(x: Column) -> Column:
    """The integral of the normal distribution's mass from the middle to `x`, up to a constant."""
    return density(x) + x * erf(SCALE * x) / 2


def pair_score(insert: Column, distance: Column, variance: Column) -> Column:
    return PAIR_DENSITY * F.exp(-(insert - distance) * (insert - distance) / (2 * variance))


def expected_pairs(distance: Column, len_a: Column, len_b: Column, count_a: Column, count_b: Column, mean: Column, sd: Column) -> Column:
    """How many read pairs of a library should join two contigs at that distance (whole pairs, 0 at least).

    A pair joins them if one read lies on the one and its mate, a normal insert length away, on the other. Over all places
    of the first read that is a double integral of the density, whose corners are the insert lengths from nearest to
    nearest, nearest to farthest (of either contig) and farthest to farthest end.

    `count_a` and `count_b` are the paired reads of the library on the two contigs. 0 without an insert length or if
    a contig has no length.
    """
    long_, short = F.greatest(len_a, len_b), F.least(len_a, len_b)
    thinner = F.least(count_a / len_a, count_b / len_b)
    gap = F.floor(distance) - F.floor((long_ + short) / 2)
    near, with_short, with_long, far = (overhang((gap + more - mean) / sd) for more in (F.lit(0), short, long_, short + long_))
    all_ = thinner * sd * (near - with_short - with_long + far)
    known = (mean > 0) & (len_a > 0) & (len_b > 0)
    return F.when(known & (all_ > 0), F.floor(all_)).otherwise(0).cast("long")
