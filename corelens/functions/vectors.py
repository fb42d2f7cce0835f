"""Threshold vectors as columns: equality, hashes and orderings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(one: Sequence, two: Sequence) -> Column:
    """All coordinates are equal; vectors of different lengths never are."""
    if len(one) != len(two):
        return F.lit(False)
    return reduce(and_, [F.col(a) == (F.col(b) if isinstance(b, str) else F.lit(b)) for a, b in zip(one, two, strict=True)], F.lit(True))


def vector_hash(coordinates: Sequence[str]) -> Column:
    return F.xxhash64(F.array(*[F.col(c) for c in coordinates]))


def sweep_order(coordinates: Sequence[str]) -> list[Column]:
    """Last coordinate from high to low, then the others from low to high: the order in which a sweep meets cores."""
    return [F.desc(coordinates[-1]), *[F.asc(c) for c in coordinates[:-1]]]


def prefix_order(coordinates: Sequence[str]) -> list[Column]:
    """Prefixes in descending lexicographic order."""
    return [F.desc(c) for c in coordinates[:-1]]
