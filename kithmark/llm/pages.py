"""Reading order of scanned pages: fused lines are split, columns found from the boxes, read one by one."""

from __future__ import annotations

import re
from statistics import median

_FUSED = re.compile(r" {3,}|\t+")


def page_lines(text: str | None, x0=None, y0=None, x1=None) -> list[str]:
    """Lines in printed order, column by column. Without a box for every line the given order stands.

    Null and empty pages have no lines. A line that was read across several columns is split at its
    wide gaps; where each part stands is estimated from its share of the line's width.
    """
    if not text:
        return []
    lines = text.split("\n")
    n = len(lines)
    if x0 is None or y0 is None or x1 is None or not (len(x0) == len(y0) == len(x1) == n):
        return [p for l in lines for p in _FUSED.split(l) if p]
    x0, y0, x1 = list(map(int, x0)), list(map(int, y0)), list(map(int, x1))
    if "   " not in text and "\t" not in text and max(x0) - min(x0) < 0.4 * (sorted(x1)[n // 2] - min(x0)):
        return [lines[k] for k in sorted(range(n), key=y0.__getitem__) if lines[k]]  # one column
    parts = []  # x, y, text, width
    for i, l in enumerate(lines):
        if "   " in l or "\t" in l:
            w = (x1[i] - x0[i]) / max(1, len(l))
            at = 0
            for p in _FUSED.split(l):
                if p:
                    j = l.index(p, at)
                    parts.append((x0[i] + j * w, y0[i], p, len(p) * w, j > 0))
                    at = j + len(p)
        elif l:
            parts.append((x0[i], y0[i], l, x1[i] - x0[i], False))
    if len(parts) < 3:
        return [p[2] for p in parts]
    step = 0.45 * median(p[3] for p in parts)
    # columns start where many parts start; estimated starts only join
    starts: list[list[float]] = []
    for x in sorted(p[0] for p in parts):
        if starts and x - starts[-1][-1] <= step * 0.5:
            starts[-1].append(x)
        else:
            starts.append([x])
    mids = [median(s) for s in starts if len(s) >= max(2, 0.04 * len(parts))] or [median(starts[0])]
    merged = [mids[0]]
    for m in mids[1:]:
        if m - merged[-1] > step:
            merged.append(m)
    order = []
    for k, (x, y, p, _, _) in enumerate(parts):
        col = 0
        while col + 1 < len(merged) and abs(merged[col + 1] - x) <= abs(merged[col] - x):
            col += 1
        order.append((col, y, k))
    order.sort()
    return [parts[k][2] for _, _, k in order]
