"""Affines of volumes: 12 doubles by rows (three rows of a voxel's three axes and an offset), from voxel to world.

An axis is named by the world axis that it mostly runs along, and in which direction: R or L, A or P, S or I.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = (("R", "L"), ("A", "P"), ("S", "I"))


def entry(affine: Column, row: int, column: int) -> Column:
    return F.get(affine, F.lit(4 * row + column))


def from_directions(row: Column, column: Column, row_step: Column, column_step: Column, slice_step: Column, origin: Column) -> Column:
    """An affine from the direction of rows and columns (three cosines each), steps along them, the slice's step and the origin.

    A slice's step that is a number runs along the cross product of both directions; three numbers are the step itself.
    """
    return F.flatten(F.array(*[F.array(F.get(row, F.lit(i)) * row_step, F.get(column, F.lit(i)) * column_step, F.get(slice_step, F.lit(i)), F.get(origin, F.lit(i))) for i in range(3)]))


def cross(a: Column, b: Column, length: Column) -> Column:
    """The cross product of two directions, times a length."""
    g = lambda v, i: F.get(v, F.lit(i % 3))
    return F.array(*[(g(a, i + 1) * g(b, i + 2) - g(a, i + 2) * g(b, i + 1)) * length for i in range(3)])


def to_ras(affine: Column) -> Column:
    """From left, posterior, superior to right, anterior, superior: the first two world axes change sign."""
    return F.transform(affine, lambda v, i: F.when(i < 8, -v).otherwise(v))


def axis_codes(affine: Column) -> Column:
    """Three letters, one a voxel axis."""

    def code(column: int) -> Column:
        size = [F.abs(entry(affine, r, column)) for r in range(3)]
        named = [F.when(entry(affine, r, column) > 0, NAMES[r][0]).otherwise(NAMES[r][1]) for r in range(3)]
        return F.when((size[0] >= size[1]) & (size[0] >= size[2]), named[0]).when(size[1] >= size[2], named[1]).otherwise(named[2])

    return F.concat(*[code(c) for c in range(3)])


def flips(affine: Column, reference: Column) -> Column:
    """Which voxel axes run otherwise than in the reference."""
    own, other = axis_codes(affine), axis_codes(reference)
    return F.array(*[F.substring(own, c + 1, 1) != F.substring(other, c + 1, 1) for c in range(3)])


def flip(affine: Column, turned: Column, lengths: Column) -> Column:
    """The affine after the turned axes are reversed; voxels keep their place in the world."""

    def row(r: int) -> list[Column]:
        steps = [F.when(F.get(turned, F.lit(c)), -entry(affine, r, c)).otherwise(entry(affine, r, c)) for c in range(3)]
        origin = entry(affine, r, 3)
        for c in range(3):
            origin = origin + F.when(F.get(turned, F.lit(c)), entry(affine, r, c) * (F.get(lengths, F.lit(c)) - 1)).otherwise(F.lit(0.0))
        return [*steps, origin]

    return F.array(*[v for r in range(3) for v in row(r)])


def flip_voxel(at: Column, turned: Column, lengths: Column) -> Column:
    """A voxel's place after the turned axes are reversed."""
    return F.transform(at, lambda v, i: F.when(F.get(turned, i), F.get(lengths, i) - 1 - v).otherwise(v))


def transposed(at: Column) -> Column:
    """A voxel's place (z, y, x) as (x, y, z)."""
    return F.reverse(at)
