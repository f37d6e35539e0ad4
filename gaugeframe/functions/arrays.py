"""Array functions of thumbnails, vectors and bins (H1-H5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return _total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def standardize(a: Column) -> Column:
    """Zero mean and unit norm (1e-6 is added to the norm), so that a dot product is a correlation."""
    centred = bind(mean(a), lambda m: F.transform(a, lambda x: x - m))
    norm = lambda c: F.sqrt(_total(F.transform(c, lambda y: y * y))) + 1e-6
    return bind(centred, lambda c: bind(norm(c), lambda n: F.transform(c, lambda x: x / n)))


def permute(a: Column, order: Column) -> Column:
    """Elements of ``a`` in the (zero-based) order given."""
    return F.transform(order, lambda i: F.element_at(a, i + 1))


def bin_index(x: Column, edges: list[float], *, closed_left: bool = True) -> Column:
    """How many edges are at most (``closed_left``) or below x."""
    return sum(((F.lit(float(e)) <= x) if closed_left else (F.lit(float(e)) < x)).cast("int") for e in edges)


def orientation_maps(side: int) -> list[list[int]]:
    """Index maps of the eight orientations of a side x side array: four turns of 90 degrees, and those of the transposed array."""
    grid = np.arange(side * side).reshape(side, side)
    return [np.rot90(g, k).reshape(-1).tolist() for g in (grid, grid.T) for k in range(4)]


def orbits(side: int) -> list[list[int]]:
    """Places of a side x side array that some orientation carries into each other; each place is in one orbit."""
    maps = orientation_maps(side)
    return [list(o) for o in sorted({tuple(sorted({m[i] for m in maps})) for i in range(side * side)})]


def pool2(a: Column, side: int) -> Column:
    """Means of the 2 x 2 blocks of a side x side array, row by row."""
    half = side // 2
    at = [[(2 * r + i) * side + 2 * c + j + 1 for i in (0, 1) for j in (0, 1)] for r in range(half) for c in range(half)]
    return F.array(*(sum(F.element_at(a, k) for k in block) / 4.0 for block in at))
