"""Order-preserving whole-number images of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRACTION = 2**52


def is_finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def ordered_bits(x: Column) -> Column:
    """A bigint that orders as the finite double does; both zeros give 0.

    It is the IEEE bit pattern with its sign applied, computed with exact
    double arithmetic inside generated code.  Null for null, NaN and infinity.
    """
    size = F.abs(x)
    exponent = F.floor(F.log2(size)).cast("int")
    # log2 may be off by one next to a power of two
    scaled = size / F.pow(F.lit(2.0), exponent)
    exponent = F.when(scaled >= 2.0, exponent + 1).when(scaled < 1.0, exponent - 1).otherwise(exponent)
    fraction = size / F.pow(F.lit(2.0), exponent) - 1.0
    normal = (exponent + 1023).cast("bigint") * F.lit(_FRACTION) + (fraction * float(_FRACTION)).cast("bigint")
    small = (size * float(2**537) * float(2**537)).cast("bigint")
    bits = F.when(size == 0.0, F.lit(0).cast("bigint")).when(size < F.lit(2.0**-1022), small).otherwise(normal)
    return F.when(is_finite(x), F.when(x < 0, -bits).otherwise(bits))
