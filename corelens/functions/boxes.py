"""Closed boxes with integer edges: predicates, measures and orderings as Columns.

A box is two lists of Columns or numbers, `lo` and `hi`, one of each per dimension. Scalar columns lo0, hi0, ... keep
comparisons pushed down to Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for no upper edge.
UNBOUNDED = (1 << 31) - 1


@dataclass(frozen=True)
class Box:
    lo: tuple
    hi: tuple

    @property
    def dims(self) -> int:
        return len(self.lo)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def box(lo: Sequence, hi: Sequence) -> Box:
    if len(lo) != len(hi) or not lo:
        raise ValueError("a box needs as many lower as upper edges, and one at least")
    return Box(tuple(lo), tuple(hi))


def box_of(dims: int, prefix: str = "") -> Box:
    """The box in columns {prefix}lo0, {prefix}hi0, ..."""
    return Box(tuple(F.col(f"{prefix}lo{i}") for i in range(dims)), tuple(F.col(f"{prefix}hi{i}") for i in range(dims)))


def query_box(x: int, y: int, w: int, h: int) -> Box:
    return Box((x, y), (x + w, y + h))


def point_box(t: Sequence) -> Box:
    return Box(tuple(t), tuple(t))


def dominance_box(t: Sequence[int], top: Sequence[int] | None = None) -> Box:
    """All points >= t, up to t + top if given."""
    return Box(tuple(t), tuple(a + b for a, b in zip(t, top, strict=True)) if top is not None else (UNBOUNDED,) * len(t))


def row_box(t: Sequence[int], pinned: int) -> Box:
    """All points >= t whose coordinate `pinned` equals that of t."""
    return Box(tuple(t), tuple(x if i == pinned else UNBOUNDED for i, x in enumerate(t)))


def holds(b: Box, point: Sequence) -> Column:
    """The point (columns) lies in the box; edges without a bound add no comparison."""
    terms = []
    for lo, hi, p in zip(b.lo, b.hi, point, strict=True):
        if isinstance(lo, int) and lo == hi:
            terms.append(p == lo)
            continue
        terms.append(p >= lo)
        if not isinstance(hi, int) or hi < UNBOUNDED:
            terms.append(p <= hi)
    return reduce(and_, terms)


def encloses(outer: Box, inner: Box) -> Column:
    return reduce(and_, [(_column(a) <= c) & (_column(d) <= b) for a, b, c, d in zip(outer.lo, outer.hi, inner.lo, inner.hi, strict=True)])


def overlaps(one: Box, two: Box) -> Column:
    return reduce(and_, [(_column(a) <= d) & (_column(c) <= b) for a, b, c, d in zip(one.lo, one.hi, two.lo, two.hi, strict=True)])


def equal(one: Box, two: Box) -> Column:
    return reduce(and_, [(_column(a) == c) & (_column(b) == d) for a, b, c, d in zip(one.lo, one.hi, two.lo, two.hi, strict=True)])


def _product(columns: list[Column]) -> Column:
    return reduce(mul, [c.cast("double") for c in columns])


def area(b: Box) -> Column:
    return _product([_column(h) - l for l, h in zip(b.lo, b.hi, strict=True)])


def margin(b: Box) -> Column:
    return reduce(lambda x, y: x + y, [(_column(h) - l).cast("double") for l, h in zip(b.lo, b.hi, strict=True)])


def overlap_area(one: Box, two: Box) -> Column:
    sides = [F.greatest(F.lit(0), F.least(_column(b), _column(d)) - F.greatest(_column(a), _column(c))) for a, b, c, d in zip(one.lo, one.hi, two.lo, two.hi, strict=True)]
    return _product(sides)


def centre_distance(one: Box, two: Box) -> Column:
    """Squared distance of the centres."""
    return reduce(lambda x, y: x + y, [F.pow((_column(a) + b - c - d) / 2.0, F.lit(2.0)) for a, b, c, d in zip(one.lo, one.hi, two.lo, two.hi, strict=True)])


def text(b: Box) -> Column:
    """[lo..hi][lo..hi]..."""
    return F.concat(*[x for l, h in zip(b.lo, b.hi, strict=True) for x in (F.lit("["), _column(l).cast("string"), F.lit(".."), _column(h).cast("string"), F.lit("]"))])


def stretched(df: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """The smallest box around the boxes (or, with lo = hi, points) of each group."""
    return df.groupBy(*by).agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(dims)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(dims)])


def ordering(name: str, dims: int, axis: int = 0, to: Box | None = None) -> list[Column]:
    """Sort keys of box columns: first_edge, second_edge, centre_distance, area or overlap (the last two and distance ascending)."""
    b = box_of(dims)
    if name == "first_edge":
        return [b.lo[axis], b.hi[axis]]
    if name == "second_edge":
        return [b.hi[axis], b.lo[axis]]
    if name == "area":
        return [area(b)]
    if name in ("centre_distance", "overlap") and to is not None:
        return [centre_distance(b, to) if name == "centre_distance" else overlap_area(b, to)]
    raise ValueError(f"unknown ordering {name!r}")


def acceptor(name: str, query: Box | None, dims: int):
    """(test of blocks, test of points in columns c0, ...): overlapping, enclosing or any."""
    b, p = box_of(dims), [F.col(f"c{i}") for i in range(dims)]
    if name == "any":
        return F.lit(True), F.lit(True)
    if query is None:
        raise ValueError("a query box is needed")
    if name == "overlapping":
        return overlaps(query, b), holds(query, p)
    if name == "enclosing":
        return overlaps(query, b), holds(query, p) & encloses(query, point_box(p))
    raise ValueError(f"unknown acceptor {name!r}")
