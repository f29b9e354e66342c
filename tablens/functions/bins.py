"""Equal-width binning whose bin edges are ``lo + i * (hi - lo) / bins`` in double arithmetic.

A value belongs to the bin of the last edge that does not exceed it. The division that finds
the bin can round across an edge, so its result is checked against the two edges around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges_passed(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """How many of the edges ``1 .. bins-1`` are <= x (``x`` within ``[lo, hi]``)."""
    step = (hi - lo) / F.lit(float(bins))
    guess = F.least(
        F.greatest(F.floor(F.try_divide(x - lo, step)), F.lit(0)), F.lit(bins - 1)
    )
    fixed = (
        F.when((guess + 1 < bins) & (x >= lo + (guess + 1) * step), guess + 1)
        .when(x < lo + guess * step, guess - 1)
        .otherwise(guess)
    )
    return fixed.cast("int")


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number ``1 .. bins``; the last bin is closed, so ``hi`` falls in it."""
    return F.when(hi > lo, _edges_passed(x, lo, hi, bins) + 1).when(
        x.isNotNull(), F.lit(1)
    )


def digitized_label(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Label ``1 .. bins + 1``; the maximum alone gets ``bins + 1``; constants get 0."""
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(hi > lo, F.when(x >= hi, F.lit(bins + 1)).otherwise(
            _edges_passed(x, lo, hi, bins) + 1))
        .otherwise(F.lit(0))
    )
