"""A squarified treemap: rectangles whose areas are values, near to squares."""

from __future__ import annotations


def squarify(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) for each value, in the given order; values of zero get no area.

    Layout is sequential and small (what a screen shows), so it runs on the driver.
    """
    total = sum(values)
    out: list = [(x, y, 0.0, 0.0)] * len(values)
    if total <= 0 or w <= 0 or h <= 0:
        return out
    scale = w * h / total
    left = sorted((i for i, v in enumerate(values) if v > 0), key=lambda i: (-values[i], i))

    def worst(row: list[float], side: float) -> float:
        s = sum(row)
        return max(max(side * side * r / (s * s), s * s / (side * side * r)) for r in row)

    while left:
        side, row = min(w, h), []
        while left:
            nxt = values[left[0]] * scale
            if row and worst([a for _, a in row] + [nxt], side) > worst([a for _, a in row], side):
                break
            row.append((left.pop(0), nxt))
        thick = sum(a for _, a in row) / side
        at = 0.0
        for i, area in row:
            length = area / thick
            out[i] = (x, y + at, thick, length) if w >= h else (x + at, y, length, thick)
            at += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
    return out
