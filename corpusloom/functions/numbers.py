"""Rounding as the binary value of a double asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (least size, bits): how far a number is scaled so that all of its bits stand before the point and in 63 of them.
_SCALES = ((2.0**-7, 60), (2.0**-17, 69), (0.0, 78))


def _by_size(size: Column, of) -> Column:
    least, bits = _SCALES[0]
    out = F.when(size >= least, of(bits))
    for least, bits in _SCALES[1:]:
        out = out.when(size >= least, of(bits))
    return out


def round_exact(c: Column, places: int = 6) -> Column:
    """A number below 8 in size, to at most 6 places, rounded half to even on its exact binary value.

    Decimal rounding of the shortest notation, which Spark's functions do, takes
    1.0000005 for a half although the double is none.  Here the number is scaled
    by a power of two to a whole one and divided in exact decimals.
    """
    if not 0 <= places <= 6:
        raise ValueError("places are 0 to 6")
    size, ten = F.abs(c), 10**places
    one = _by_size(size, lambda bits: F.lit(str(1 << bits)).cast("decimal(30,0)"))
    whole = (size * _by_size(size, lambda bits: F.lit(float(1 << bits)))).cast("bigint").cast("decimal(20,0)")
    near = F.rint(size * ten).cast("bigint")
    off = (whole * F.lit(ten).cast("decimal(8,0)") - near.cast("decimal(8,0)") * one) * 2  # from the near one, in halves
    step = F.when(off > one, 1).when(off < -one, -1).when(off == one, near % 2).when(off == -one, -(near % 2)).otherwise(0)
    out = (near + step).cast("double") / float(ten)
    return F.when(size < 8, F.when(c < 0, -out).otherwise(out)).otherwise(F.bround(c, places))
