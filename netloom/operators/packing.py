"""Packing of shapes onto plates by their outlines, on a grid of cells.

A plate is a whole number, a bit for each cell. Where a shape fits in a band of
rows is found for all places at once: the cells taken in each of its rows, shifted
and spread by the shape's runs there, block places, and the lowest bit left free is
the first that fits. Groups (a colour of an order) are folded
where Spark deals them; a group is bounded by what one order prints.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .fold import ordered_fold

# Room between shapes, side of a cell, and the turns that are tried, in order.
GAP, CELL, TURNS = 2.5, 1.25, (0, 90, 45, 135)
#: Rows that are tried at once, and shapes whose cells a Python process keeps at hand (the others are worked out again); items of a task, as one takes about a millisecond.
BAND, KEPT, ITEMS_A_TASK = 24, 4096, 5_000
#: Rows of a shape that rule out most places, and places that are then tried one by one.
FIRST, TRIES = 4, 8


class Mask:
    """The cells that a turned outline touches, spread by half the gap; runs of cells for each row."""

    def __init__(self, xs: list[float], ys: list[float], turn: int, gap: float, cell: float):
        t = math.radians(turn)
        c, s = math.cos(t), math.sin(t)
        x, y = np.array(xs) * c - np.array(ys) * s, np.array(xs) * s + np.array(ys) * c
        grow = max(1, math.ceil(gap / cell / 2))
        left, low = x.min() - grow * cell, y.min() - grow * cell
        w, h = (math.ceil((v.max() - v.min()) / cell) + 2 * grow + 1 for v in (x, y))
        on = self._touched((x - left) / cell, (y - low) / cell, w, h)
        wide = np.zeros_like(on)
        for dy in range(-grow, grow + 1):
            for dx in range(-grow, grow + 1):
                a, b = slice(max(0, dy), h + min(0, dy)), slice(max(0, -dy), h + min(0, -dy))
                p, q = slice(max(0, dx), w + min(0, dx)), slice(max(0, -dx), w + min(0, -dx))
                wide[a, p] |= on[b, q]
        rows, cols = np.flatnonzero(wide.any(axis=1)), np.flatnonzero(wide.any(axis=0))
        wide = wide[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
        self.turn, self.h, self.w = turn, *wide.shape
        self.left, self.low = left + cols[0] * cell, low + rows[0] * cell
        self.bits = [int.from_bytes(r.tobytes(), "little") for r in np.packbits(wide, axis=1, bitorder="little")]
        edge = np.diff(np.pad(wide.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (at, begins), ends = (v.tolist() for v in np.nonzero(edge == 1)), np.nonzero(edge == -1)[1].tolist()
        self.runs = [[] for _ in wide]
        for j, begin, end in zip(at, begins, ends, strict=True):
            self.runs[j].append((begin, end))
        self.wholes: dict[int, int] = {}
        # the rows that are tried first: the lowest, the highest, and some between; and the others
        some = set(np.linspace(0, self.h - 1, min(self.h, FIRST)).astype(int).tolist())
        self.first, self.rest = ([(j, begin, end, (end - begin).bit_length() - 1) for j, r in enumerate(self.runs) if (j in some) == own for begin, end in r] for own in (True, False))

    def whole(self, wide: int) -> int:
        """Its cells as one number, on a plate of rows of ``wide`` cells."""
        if wide not in self.wholes:
            self.wholes[wide] = sum(bits << j * wide for j, bits in enumerate(self.bits))
        return self.wholes[wide]

    @staticmethod
    def _touched(x: np.ndarray, y: np.ndarray, w: int, h: int) -> np.ndarray:
        """Cells whose middle lies inside, or that an edge passes through."""
        cy, cx = np.mgrid[0:h, 0:w].astype(float)
        on = np.zeros((h, w), bool)
        hit = np.zeros((h, w), bool)
        for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
            if y0 != y1:
                on ^= ((y0 > cy + 0.5) != (y1 > cy + 0.5)) & (cx + 0.5 < (x1 - x0) * (cy + 0.5 - y0) / (y1 - y0) + x0)
            t0, t1 = np.zeros((h, w)), np.ones((h, w))
            out = np.zeros((h, w), bool)
            for p, q in ((x0 - x1, x0 - cx), (x1 - x0, cx + 1 - x0), (y0 - y1, y0 - cy), (y1 - y0, cy + 1 - y0)):
                if p == 0:
                    out |= q < 0
                elif p < 0:
                    t0 = np.maximum(t0, q / p)
                else:
                    t1 = np.minimum(t1, q / p)
            hit |= ~out & (t0 <= t1)
        return on | hit


@lru_cache(KEPT)
def outlines(xs: tuple, ys: tuple, turns: tuple, gap: float, cell: float) -> list[Mask]:
    """The shape in each turn; kept by the Python process, as orders print the same shapes again."""
    return [Mask(xs, ys, t, gap, cell) for t in turns]


class Plate:
    """A plate as one whole number, its rows of ``wide`` cells one after the other, from the lowest; ``spreads[k]`` has the cells from which one of the next 2^k is taken."""

    def __init__(self, rows: list[int], wide: int):
        self.wide, self.high, self.spreads = wide, len(rows), [sum(r << y * wide for y, r in enumerate(rows))]

    def put(self, mask: Mask, x: int, y: int) -> None:
        self.spreads = [self.spreads[0] | mask.whole(self.wide) << y * self.wide + x]

    def spread(self, k: int) -> int:
        while len(self.spreads) <= k:
            last = self.spreads[-1]
            self.spreads.append(last | last >> (1 << len(self.spreads) - 1))
        return self.spreads[k]


def first_on(plate: Plate, mask: Mask, below: int) -> tuple[int, int] | None:
    """The first place (row, then column) where the mask meets nothing, if it is before ``below``.

    All places of a band of rows are tried at once. A run of the mask is two overlapping stretches of a length that is a power
    of two. Some of the mask's rows leave few places; those are tried with the whole mask, one by one, and where TRIES of
    them fail, the other rows are taken as well.
    """
    wide, last = plate.wide, min(plate.high - mask.h, (below - 1) // plate.wide)
    row, all_of, cells = (1 << wide - mask.w + 1) - 1, mask.whole(wide), plate.spreads[0]
    for y in range(0, last + 1, BAND):
        n = min(BAND, last + 1 - y)
        whole = (1 << n * wide) - 1
        free = row * (whole // ((1 << wide) - 1))
        for runs in (mask.first, mask.rest):
            for j, begin, end, k in runs:
                spread = plate.spread(k)
                base = (y + j) * wide
                taken = spread >> base + begin
                if end - begin > 1 << k:
                    taken |= spread >> base + end - (1 << k)
                free &= ~taken
            for _ in range(TRIES):
                if not free:
                    break
                at = (free & -free).bit_length() - 1
                if not cells >> y * wide + at & all_of:
                    x, y = at % wide, y + at // wide
                    return (x, y) if y * wide + x < below else None
                free &= free - 1
            if not free:
                break
    return None


def first_place(grid: list[int], wide: int, mask: Mask, below: int) -> tuple[int, int] | None:
    """first_on, for a plate given as rows."""
    return first_on(Plate(grid, wide), mask, below)


def pack(items: DataFrame, group: str, bed: tuple[float, float], gap: float = GAP, cell: float = CELL, turns: tuple[int, ...] = TURNS, rows: int | None = None) -> DataFrame:
    """items(group, item, xs array, ys array, area) -> (group, item, plate, turn, dx, dy, oversize): largest area first, then by item.

    Each shape is turned and moved (turn in degrees about the origin, then by dx and dy) to the first place on the first
    plate where its outline, spread by half the gap, meets no other; of its turns the one with the first place counts.
    Plates are numbered from 1 in a group. A shape that no turn fits onto the bed gets a plate of its own, oversize. A shape
    without three corners takes the cells that it touches. rows: about how many items there are (counted, if not given).
    """
    wide, high = int(bed[0] // cell), int(bed[1] // cell)

    def fold(g):
        plates: list[Plate] = []
        closed: set[int] = set()
        for r in g:
            masks = [m for m in outlines(tuple(r["xs"]), tuple(r["ys"]), turns, gap, cell) if m.w <= wide and m.h <= high]
            if not masks:
                m = Mask(r["xs"], r["ys"], 0, gap, cell)
                plates.append(Plate([], wide))
                closed.add(len(plates) - 1)
                yield r[group], r["item"], len(plates), 0, -m.left, -m.low, True
                continue
            for k in range(len(plates) + 1):
                if k == len(plates):
                    plates.append(Plate([0] * high, wide))
                elif k in closed:
                    continue
                best, below = None, wide * high + 1
                for m in masks:
                    at = first_on(plates[k], m, below)
                    if at:
                        best, below = (m, *at), at[1] * wide + at[0]
                if best:
                    m, x, y = best
                    plates[k].put(m, x, y)
                    yield r[group], r["item"], k + 1, m.turn, x * cell - m.left, y * cell - m.low, False
                    break

    ordered = items.selectExpr(group, "item", "xs", "ys", "-area AS minus")
    return ordered_fold(ordered, [group], ["minus", "item"], fold, f"{group} long, item long, plate long, turn long, dx double, dy double, oversize boolean", items.count() if rows is None else rows, ITEMS_A_TASK)
