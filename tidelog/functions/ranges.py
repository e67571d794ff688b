"""Numbers cut into ranges of about as many rows each, however they are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDE = 16
_LAST = (1 << 63) - 1


def quantiles(df: DataFrame, column: str, ranges: int = _SIDE * _SIDE) -> list[int]:
    """At most ranges - 1 (255) bounds between ranges of a long column, from all rows; approximate, so ranges differ a little in size."""
    ranges = min(ranges, _SIDE * _SIDE)
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or []))


def range_of(x: Column, bounds: list[int]) -> Column:
    """How many bounds are at most x: two steps of comparisons, of the coarse bounds and of those between two of them."""
    padded = bounds + [_LAST] * (_SIDE * _SIDE - 1 - len(bounds))
    beyond = lambda own: sum(((x >= b).cast("int") for b in own), F.lit(0))
    coarse = beyond([F.lit(b).cast("long") for b in padded[_SIDE - 1 :: _SIDE]])
    rows = F.array(*(F.array(*(F.lit(b).cast("long") for b in padded[k * _SIDE : k * _SIDE + _SIDE - 1])) for k in range(_SIDE)))
    own = F.element_at(rows, coarse + 1)
    return (coarse * _SIDE + beyond([F.element_at(own, j + 1) for j in range(_SIDE - 1)])).cast("long")
