"""A random number for a lattice place that never changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF
# Three multipliers and the finishing one.
_I, _J, _SALT, _FINISH = 73856093, 19349663, 83492791, 1274126177


def _times(a: Column, by: int) -> Column:
    """The low 32 bits of a product; both sides stay below 2^32, so a long holds it."""
    return (a.cast("long").bitwiseAND(_LOW) * F.lit(by).cast("long")).bitwiseAND(_LOW)


def cell_random(i: Column, j: Column, salt: int = 0) -> Column:
    """0 to 1, in 65,536 steps."""
    n = _times(i, _I).bitwiseXOR(_times(j, _J)).bitwiseXOR(F.lit(salt * _SALT & _LOW).cast("long"))
    n = _times(n.bitwiseXOR(F.shiftright(n, 13)), _FINISH)
    return F.shiftright(n, 8).bitwiseAND(0xFFFF) / 65535
