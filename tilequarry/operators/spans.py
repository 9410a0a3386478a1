"""Even-odd fill of many rings at once: the spans of their rows, as `shapes.ring_spans` gives them for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Crossings of edges with rows that are worked on at once; a ring with more of them is worked on alone.
CROSSINGS = 1_000_000


def span_lists(x: np.ndarray, y: np.ndarray, size: np.ndarray, width: np.ndarray, height: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    """Of rings i to j - 1 (size: points of each) the lists of spans (y, x_from, x_to) that lie on a raster of width x height, by y and x; half open."""
    ends = np.cumsum(size)
    after = np.arange(1, len(x) + 1)
    after[ends[size > 0] - 1] = (ends - size)[size > 0]
    ring = np.repeat(np.arange(len(size)), size)
    low, high = np.minimum(y, y[after]), np.maximum(y, y[after])
    known = np.isfinite(low) & np.isfinite(high) & (size[ring] >= 3)
    low, high = (np.clip(np.ceil(np.where(known, v, 0)), 0, height[ring]).astype(np.int64) for v in (low, high))
    rows = high - low
    total = np.concatenate([[0], np.cumsum(rows)])[np.concatenate([[0], ends])]
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CROSSINGS, "right")) - 1)
        first, last = ends[i] - size[i], ends[j - 1]
        n = rows[first:last]
        edge = np.repeat(np.arange(first, last), n)
        at = low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(invalid="ignore"):
            cross = x[edge] + (at - y[edge]) * (x[after[edge]] - x[edge]) / (y[after[edge]] - y[edge])
        real = ~np.isnan(cross)
        cross, at, of = cross[real], at[real], ring[edge[real]]
        order = np.lexsort((cross, at, of))
        cross, at, of = np.ceil(cross[order]), at[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1])
        place = np.arange(len(of)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(of) else at
        left = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
        a, b = (np.clip(cross[k], 0, width[of[left]]).astype(np.int64) for k in (left, left + 1))
        left, a, b = (v[a < b] for v in (left, a, b))
        cuts = np.searchsorted(of[left], np.arange(i, j + 1)).astype(np.int32)
        yield i, j, pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(at[left]), pa.array(a), pa.array(b)], ["y", "x_from", "x_to"]))
        i = j
