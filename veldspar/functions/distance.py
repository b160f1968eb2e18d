"""Distances between two array columns, unrolled so that whole-stage code generation fuses them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantize import space_of


def squared_l2(a: Column, b: Column, dims: int, space: str) -> Column:
    """Operands are widened before they are subtracted: 64-bit whole numbers, or doubles in order of the dimensions."""
    wide = space_of(space).distance
    return reduce(add, [(x := a[i].cast(wide) - b[i].cast(wide)) * x for i in range(dims)])


def l1(a: Column, b: Column, dims: int, space: str) -> Column:
    wide = space_of(space).distance
    return reduce(add, [F.abs(a[i].cast(wide) - b[i].cast(wide)) for i in range(dims)])


def cosine(a: Column, b: Column, dims: int, space: str) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    dot = reduce(add, [a[i].cast("double") * b[i].cast("double") for i in range(dims)])
    norm = F.sqrt(reduce(add, [a[i].cast("double") * a[i].cast("double") for i in range(dims)]) * reduce(add, [b[i].cast("double") * b[i].cast("double") for i in range(dims)]))
    return F.when(norm > 0, 1 - dot / norm).otherwise(F.lit(1.0))


METRICS = {"l2": squared_l2, "l1": l1, "cosine": cosine}


def box_lower_bound(query: Column, low: Column, high: Column, dims: int, space: str) -> Column:
    """The least squared distance from a query to any point of a box; the sentinel is an ordinary coordinate."""
    wide = space_of(space).distance
    zero = F.lit(0).cast(wide)
    return reduce(add, [(x := F.greatest(low[i].cast(wide) - query[i].cast(wide), zero, query[i].cast(wide) - high[i].cast(wide))) * x for i in range(dims)])
