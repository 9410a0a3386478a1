"""Point rings as array columns, and the iterative ring operations that need a kernel."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is mentioned in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_points(text: Column) -> Column:
    """Points of `x,y x,y`; tokens that are no numbers are skipped and an odd last number is left out."""
    numbers = F.filter(F.transform(F.split(F.trim(F.regexp_replace(text, ",", " ")), r"\s+"), lambda t: t.try_cast("double")), lambda v: v.isNotNull())
    pair = lambda n: F.transform(F.sequence(F.lit(1), F.floor(F.size(n) / 2).cast("int")), lambda i: F.struct(F.get(n, 2 * i - 2).alias("x"), F.get(n, 2 * i - 1).alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(text.isNotNull(), bound(numbers, lambda n: F.when(F.size(n) >= 2, pair(n)).otherwise(none)))


def format_number(v: Column) -> Column:
    """Two decimals at most, without trailing zeros or exponent."""
    text = v.cast("decimal(20,2)").cast("string")
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def format_points(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat(format_number(p["x"]), F.lit(","), format_number(p["y"]))), " ")


def close_ring(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def open_ring(ring: Column) -> Column:
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def drop_repeats(ring: Column) -> Column:
    """The ring without points that equal the one before them."""
    return bound(ring, lambda r: F.filter(r, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(r, i - 1))))


def signed_area(ring: Column) -> Column:
    """Half the sum over consecutive points; the closing edge counts only if the ring is closed."""
    cross = lambda r: F.transform(r, lambda p, i: p["x"] * F.get(r, i + 1)["y"] - F.get(r, i + 1)["x"] * p["y"])
    return F.aggregate(F.filter(bound(ring, cross), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / 2


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))


def ellipse(x: Column, y: Column, rx: Column, ry: Column, n: int = 64) -> Column:
    angle = lambda i: F.lit(2 * math.pi) * i / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.round(x + rx * F.cos(angle(i)), 2).alias("x"), F.round(y + ry * F.sin(angle(i)), 2).alias("y")))


def bridge(outer: Column, hole: Column) -> Column:
    """One ring from an outer ring and a hole, wound the other way, joined at their nearest vertices (the first pair of equals).

    Which way a ring winds is judged as it is given: an open one lacks its closing edge.
    """
    turned = (signed_area(hole) >= 0) == (signed_area(outer) >= 0)
    rings = F.struct(open_ring(outer).alias("o"), open_ring(hole).alias("h"), turned.alias("t"))
    rings = bound(rings, lambda r: F.struct(r["o"].alias("o"), F.when(r["t"], F.reverse(r["h"])).otherwise(r["h"]).alias("h")))

    def nearest(r: Column) -> Column:
        far = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
        pairs = F.transform(r["o"], lambda a, i: F.array_min(F.transform(r["h"], lambda b, j: F.struct(far(a, b).alias("d"), i.alias("i"), j.alias("j")))))
        return F.struct(r["o"].alias("o"), r["h"].alias("h"), F.array_min(pairs).alias("at"))

    def join(r: Column) -> Column:
        o, h, i, j = r["o"], r["h"], r["at"]["i"], r["at"]["j"]
        return F.concat(F.slice(o, 1, i + 1), F.slice(h, j + 1, F.size(h) - j), F.slice(h, 1, j + 1), F.slice(o, i + 1, F.size(o) - i))

    return bound(bound(rings, nearest), join)


#: Points that a ring needs.
MIN_RING = 3


def bridge_all(outer: Column, holes: Column) -> Column:
    """An outer ring with all its holes folded in, one after the other, as one open ring; holes of fewer than MIN_RING points are left out.

    The ring grows from hole to hole, and each is joined where it is nearest to what has grown.
    """
    usable = F.filter(holes, lambda h: F.size(h) >= MIN_RING)
    return open_ring(F.aggregate(F.coalesce(usable, F.array().cast("array<array<struct<x:double,y:double>>>")), outer, bridge))


def without_repeats(ring: list) -> list:
    return [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]


def find_slit(ring: list) -> tuple[int, int] | None:
    """Two visits of one vertex between which a closed ring of at least four points runs.

    Vertices are tried in the order of their first visit, and for one of them all pairs of visits, the
    earliest start and then the earliest end first. The visits are listed by the point before them, where the
    end of such a ring is looked up.
    """
    visits: dict = {}
    ends: dict = {}
    for k, p in enumerate(ring):
        visits.setdefault(p, []).append(k)
        if k:
            ends.setdefault((p, ring[k - 1]), []).append(k)
    for p, starts in visits.items():
        if len(starts) < 2:
            continue
        for start in starts:
            if start + 1 < len(ring):
                fit = ends.get((p, ring[start + 1]), [])
                at = bisect_left(fit, start + 5)
                if at < len(fit):
                    return start, fit[at]
    return None


def split_bridges(ring: list) -> list[list]:
    """The outer ring, then the holes that were bridged into it, closed and wound the other way."""
    ring, holes = without_repeats(ring), []
    while (slit := find_slit(ring)) is not None:
        start, end = slit
        hole = without_repeats(ring[start + 1 : end][::-1])
        holes.append(hole if hole[0] == hole[-1] else [*hole, hole[0]])
        ring = without_repeats([*ring[: start + 1], *ring[end:]])
    return [ring, *holes]


def _unbridge(rings: pd.Series) -> pd.Series:
    points = lambda part: [{"x": a, "y": b} for a, b in part]
    return rings.map(lambda r: None if r is None else [points(part) for part in split_bridges([(p["x"], p["y"]) for p in r])])


def unbridge(ring: Column) -> Column:
    """The ring and the holes that were bridged into it."""
    return F.pandas_udf(_unbridge, "array<array<struct<x:double,y:double>>>")(ring)
