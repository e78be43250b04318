"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Splits a double into two halves whose products are exact.
_SPLIT = float(2**27 + 1)


def round_half_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` places, exact ties to even.

    The built-in rounding works on the printed decimal, so 39.55, which is stored just
    below 39.55, would round up. Here the product with the power of ten is taken with
    its rounding error, and that error settles the near ties. Pass a plain column, as it
    is used many times over.
    """
    scale = float(10**digits)
    product = x * F.lit(scale)
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    low = x - high
    scale_big = scale * _SPLIT
    scale_high = scale_big - (scale_big - scale)
    scale_low = scale - scale_high
    error = low * F.lit(scale_low) - (
        ((product - high * F.lit(scale_high)) - low * F.lit(scale_high)) - high * F.lit(scale_low))
    whole = F.floor(product).cast("double")
    past_half = (product - whole - F.lit(0.5)) + error
    up = (past_half > 0) | ((past_half == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    # Beyond 2^52 a scaled double has no fraction left to round.
    rounded = F.when(up, whole + 1).otherwise(whole) / F.lit(scale)
    return F.when(F.abs(product) < F.lit(float(2**52)), rounded).otherwise(x)
