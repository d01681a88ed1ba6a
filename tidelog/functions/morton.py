"""Z-order codes as column expressions, and boxes as code intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(col: Column, bits: int, axes: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(col.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), axes * i))
    return out


def _compact(code: Column, bits: int, axes: int, axis: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, axes * i + axis).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def encode2(x: Column, y: Column) -> Column:
    """32 bits an axis. The code of a coordinate of 2^31 or more on the second axis is negative as a signed long: order
    such codes after XOR with the least long, or work in chunk space, where codes stay below 2^62."""
    return _spread(x, 32, 2).bitwiseOR(F.shiftleft(_spread(y, 32, 2), 1))


def decode2(code: Column) -> tuple[Column, Column]:
    return _compact(code, 32, 2, 0), _compact(code, 32, 2, 1)


def encode3(x: Column, y: Column, z: Column) -> Column:
    """The low 21 bits of each axis."""
    return _spread(x, 21, 3).bitwiseOR(F.shiftleft(_spread(y, 21, 3), 1)).bitwiseOR(F.shiftleft(_spread(z, 21, 3), 2))


def decode3(code: Column) -> tuple[Column, Column, Column]:
    return _compact(code, 21, 3, 0), _compact(code, 21, 3, 1), _compact(code, 21, 3, 2)


def chunk(coordinate: Column, size: int) -> Column:
    """The chunk of a non-negative coordinate."""
    if size < 1:
        raise ValueError("chunks need a positive size")
    return F.call_function("div", coordinate.cast("long"), F.lit(size).cast("long"))


def in_box(coordinates: Sequence[Column], low: Sequence[int], high: Sequence[int]) -> Column:
    """Inclusive corners."""
    out = F.lit(True)
    for c, a, b in zip(coordinates, low, high, strict=True):
        out &= c.between(a, b)
    return out


def code_of(cell: Sequence[int]) -> int:
    axes = len(cell)
    return sum((v >> i & 1) << (axes * i + a) for a, v in enumerate(cell) for i in range(v.bit_length()))


def intersects(low: Sequence[Column], high: Sequence[Column], box_low: Sequence[int], box_high: Sequence[int]) -> Column:
    """Whether two boxes with inclusive corners share a point."""
    out = F.lit(True)
    for a, b, x, y in zip(low, high, box_low, box_high, strict=True):
        out &= (a <= y) & (b >= x)
    return out


def box_intervals(low: Sequence[int], high: Sequence[int], size: int) -> list[tuple[int, int]]:
    """Inclusive code intervals of the chunks that a box touches, neighbours merged.

    Quadrants (octants) are taken down only where the box's edge crosses them, so the work follows the surface of the box,
    not its volume.
    """
    if any(a > b for a, b in zip(low, high, strict=True)):
        return []
    axes, first, last = len(low), [a // size for a in low], [b // size for b in high]
    out: list[tuple[int, int]] = []
    top = max(v.bit_length() for v in last)
    stack = [(0, (0,) * axes, top)]  # code, corner and level of a cell: 2 ** level chunks an axis
    while stack:
        code, corner, level = stack.pop()
        ends = [c + (1 << level) - 1 for c in corner]
        if any(c > b or e < a for c, e, a, b in zip(corner, ends, first, last, strict=True)):
            continue
        if all(c >= a and e <= b for c, e, a, b in zip(corner, ends, first, last, strict=True)):
            end = code + (1 << axes * level) - 1
            if out and out[-1][1] + 1 == code:
                out[-1] = (out[-1][0], end)
            else:
                out.append((code, end))
            continue
        for part in reversed(range(1 << axes)):  # in code order off the stack
            step = 1 << level - 1
            stack.append((code + (part << axes * (level - 1)), tuple(c + step * (part >> k & 1) for k, c in enumerate(corner)), level - 1))
    return out
