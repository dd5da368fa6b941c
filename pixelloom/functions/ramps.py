"""Curves, lookup tables and gradients: baked on the driver into short literal arrays, looked up in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def rounded(v: float) -> int:
    return math.floor(v + 0.5)


def _unit(v: float) -> float:
    return min(1.0, max(0.0, v))


def clean_curve(points: Points) -> Points:
    """Points by x, of equal ones the later, 16 at most: what a curve keeps by its format."""
    last: dict[float, float] = {}
    for x, y in sorted(points, key=lambda p: p[0]):
        last[next((k for k in last if abs(k - x) < 1e-9), x)] = y
    return list(last.items())[:16]


def bends(points: Points) -> list[float]:
    """Second derivatives of the natural cubic spline: none at the ends, a tridiagonal system between them."""
    n = len(points)
    (x, y), inner = zip(*points, strict=True), range(1, n - 1)
    h = [b - a for a, b in zip(x, x[1:])]
    diag = [2 * (h[k - 1] + h[k]) for k in inner]
    rhs = [6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1]) for k in inner]
    for k in range(1, n - 2):
        f = h[k] / diag[k - 1]
        diag[k] -= f * h[k]
        rhs[k] -= f * rhs[k - 1]
    out = [0.0] * n
    for k in range(n - 3, -1, -1):
        out[k + 1] = (rhs[k] - h[k + 1] * out[k + 2]) / diag[k]
    return out


def curve_at(points: Points, x: float) -> float:
    """A spline through the points, flat beyond them; a line through two, the identity for fewer."""
    points = points if len(points) >= 2 else [(0.0, 0.0), (1.0, 1.0)]
    if x <= points[0][0] or x >= points[-1][0]:
        return _unit(points[0][1] if x <= points[0][0] else points[-1][1])
    m = bends(points)
    k = max(i for i in range(len(points) - 1) if points[i][0] <= x)
    (x0, y0), (x1, y1) = points[k : k + 2]
    h = x1 - x0
    a, b = (x1 - x) / h, (x - x0) / h
    return _unit(a * y0 + b * y1 + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h * h / 6)


def curve_table(points: Points) -> list[int]:
    points = clean_curve(points)
    return [rounded(curve_at(points, i / 255) * 255) for i in range(256)]


def levels_table(black: float, gamma: float, white: float, out_black: float = 0, out_white: float = 255) -> list[int]:
    span, power = max(1e-6, white - black), 1 / max(0.01, gamma)
    return [rounded(out_black + (out_white - out_black) * _unit((i - black) / span) ** power) for i in range(256)]


def composed(first: list[int], second: list[int]) -> list[int]:
    return [second[v] for v in first]


def is_identity(table: list[int]) -> bool:
    return all(v == rounded(i / (len(table) - 1) * 255) for i, v in enumerate(table))


def looked_up(table: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), at.cast("int"))


def _between(stops: list[tuple], t: float) -> tuple[tuple, tuple, float]:
    """The stops on both sides of t, and how far t is between them, after the first one's midpoint."""
    if t <= stops[0][0] or t >= stops[-1][0]:
        end = stops[0] if t <= stops[0][0] else stops[-1]
        return end, end, 0.0
    k = next(i for i in range(len(stops) - 1) if t <= stops[i + 1][0])
    a, b = stops[k : k + 2]
    f = (t - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
    middle = a[2] if len(a) > 2 else 0.5
    return a, b, f if middle == 0.5 else f ** (math.log(0.5) / math.log(min(0.999, max(0.001, middle))))


def gradient_at(colors: list[tuple], opacities: list[tuple], t: float) -> tuple[float, float, float, float]:
    """Straight colour and opacity; stops are (place, value[, midpoint])."""
    t = _unit(t)
    a, b, f = _between(colors, t)
    c, d, g = _between(opacities, t)
    return (*(p + (q - p) * f for p, q in zip(a[1], b[1], strict=True)), c[1] + (d[1] - c[1]) * g)


def gradient_table(colors: list[tuple], opacities: list[tuple], steps: int = 256) -> list[tuple[int, int, int, int]]:
    return [tuple(rounded(v * 255) for v in gradient_at(colors, opacities, i / (steps - 1))) for i in range(steps)]


def gradient_place(style: str, x0: float, y0: float, x1: float, y1: float, x: Column, y: Column) -> Column:
    """Where a point lies along a gradient line: linear, radial, angle, reflected or diamond."""
    dx, dy = x1 - x0, y1 - y0
    far, square = math.hypot(dx, dy), dx * dx + dy * dy
    px, py = x - x0, y - y0
    if style in ("linear", "reflected"):
        t = (px * dx + py * dy) / square if square else F.lit(0.0)
        return F.abs(t) if style == "reflected" else t
    if style == "angle":
        turn = (F.atan2(py, px) - math.atan2(dy, dx)) / (2 * math.pi)
        return turn - F.floor(turn)
    if not far:
        return F.lit(1.0)
    if style == "radial":
        return F.sqrt(px * px + py * py) / far
    ux, uy = dx / far, dy / far
    return (F.abs(px * ux + py * uy) + F.abs(py * ux - px * uy)) / far


def read_cube(text: str) -> tuple[int, list[float]]:
    """Size and values (red fastest, 0...1) of a .cube table of three dimensions."""
    size, low, high, values = 0, [0.0] * 3, [1.0] * 3, []
    for line in (raw.strip() for raw in text.splitlines()):
        word = line.split(None, 1)[0].upper() if line else "#"
        if word == "LUT_3D_SIZE":
            size = int(line.split()[1])
        elif word == "LUT_1D_SIZE":
            raise ValueError("a table of one dimension")
        elif word in ("DOMAIN_MIN", "DOMAIN_MAX"):
            (low if word == "DOMAIN_MIN" else high)[:] = map(float, line.split()[1:4])
        elif not word.startswith("#") and not (word[0].isalpha() or word[0] == "_") and len(line.split()) >= 3:
            values += map(float, line.split()[:3])
    if not 2 <= size <= 256 or len(values) != 3 * size**3:
        raise ValueError(f"a table of size {size} with {len(values) // 3} entries")
    return size, [(v - low[i % 3]) / ((high[i % 3] - low[i % 3]) or 1.0) for i, v in enumerate(values)]


def read_3dl(text: str) -> tuple[int, list[float]]:
    """Size and values of a .3dl table, whose blue is fastest and whose scale follows from its greatest value."""
    rows = [line.split() for line in map(str.strip, text.splitlines()) if line and not line.startswith("#") and not line[0].isalpha()]
    size, triples = len(rows[0]) if rows else 0, [tuple(map(float, r[:3])) for r in rows[1:] if len(r) >= 3]
    if size < 2 or len(triples) != size**3:
        raise ValueError(f"a table of size {size} with {len(triples)} entries")
    peak = max(map(max, triples))
    scale = 65535 if peak > 4095 else 4095 if peak > 1023 else 1023
    red_first = (triples[(r * size + g) * size + b] for b in range(size) for g in range(size) for r in range(size))
    return size, [v / scale for t in red_first for v in t]


def read_lut(name: str, text: str) -> tuple[int, list[float]]:
    """A table by the kind of its file: .cube or .3dl."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in ("cube", "3dl"):
        raise ValueError(f"{name}: neither .cube nor .3dl")
    return read_cube(text) if kind == "cube" else read_3dl(text)


def write_cube(name: str, size: int, values: list[float]) -> str:
    body = ("{:.6f} {:.6f} {:.6f}".format(*values[i : i + 3]) for i in range(0, len(values), 3))
    return "\n".join([f'TITLE "{name}"', f"LUT_3D_SIZE {size}", *body]) + "\n"


def levels_points(black: float, gamma: float, white: float, out_black: float = 0, out_white: float = 255) -> Points:
    """Points of the curve that a levels setting draws: its ends, and the middle where gamma bends it."""
    ends = [(black / 255, out_black / 255), (white / 255, out_white / 255)]
    if abs(gamma - 1) <= 0.005:
        return ends
    return [ends[0], ((black + (white - black) * 0.5**gamma) / 255, (out_black + out_white) / 510), ends[1]]


def table_points(table: list[int], count: int = 16) -> Points:
    """A drawn table as evenly spaced points."""
    places = [rounded(i * 255 / (count - 1)) for i in range(count)]
    return [(x / 255, min(255, max(0, table[x])) / 255) for x in places]


def black_point(sample: Column, white: float) -> Column:
    """The input black that makes a sampled level black, below the white."""
    return F.least(F.floor(sample + 0.5), F.lit(white - 2)).cast("long")


def white_point(sample: Column, black: float) -> Column:
    return F.greatest(F.floor(sample + 0.5), F.lit(black + 2)).cast("long")


def gray_gammas(samples: tuple[Column, ...], blacks: tuple, whites: tuple) -> tuple[Column, ...]:
    """Gammas that bring the sampled channels to their mean, in hundredths."""
    t = [F.least(F.lit(0.999), F.greatest(F.lit(0.001), (s - b) / (w - b))) for s, b, w in zip(samples, blacks, whites, strict=True)]
    target = (t[0] + t[1] + t[2]) / 3
    return tuple(F.floor(F.least(F.lit(9.99), F.greatest(F.lit(0.1), F.log(v) / F.log(target))) * 100 + 0.5) / 100 for v in t)
