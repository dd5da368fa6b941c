"""Blurs along lines and over shapes, cells about jittered seeds, deconvolution: on tiles, with halos of any reach.

As in ``tiled``: rasters told apart by ``by``, sparse ones filled with
transparent pixels, premultiplied colour, repeated edges, straight bytes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from pixelloom.functions.painting import FILTER_HASH
from pixelloom.operators.staging import cut
from pixelloom.operators.tiled import _middle, along, gaussian_weights, premultiplied, straight_bytes
from pixelloom.operators.tiles import TILE, Keys, at_border, filtered, pointwise, stepped, to_tiles

#: Samples along a line at most: its mean has settled by then.
MOST_TAPS = 256


def position_hash(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Position noise in 0...1, as ``noise`` of column expressions: products wrap at 32 bits."""
    mask = 0xFFFFFFFF

    def times(v, k: int) -> np.ndarray:
        v = np.asarray(v).astype(np.int64)
        return ((v & 0xFFFF) * k + ((((v >> 16) & 0xFFFF) * k & 0xFFFF) << 16)) & mask

    h = times(x, FILTER_HASH[0]) ^ times(y, FILTER_HASH[1]) ^ times(seed, FILTER_HASH[2])
    h = times(h ^ (h >> 13), 1274126177)
    return (h ^ (h >> 16)) / 4294967296.0


def shifted(block: np.ndarray, reach: int, dx: float, dy: float) -> np.ndarray:
    """The block's middle, sampled ``(dx, dy)`` away between pixels."""
    ix, iy = math.floor(dx), math.floor(dy)
    fx, fy = dx - ix, dy - iy
    n, m = block.shape[1] - 2 * reach, block.shape[2] - 2 * reach
    at = lambda j, i: block[:, reach + iy + j : reach + iy + j + n, reach + ix + i : reach + ix + i + m]
    top = at(0, 0) + (at(0, 1) - at(0, 0)) * fx
    low = at(1, 0) + (at(1, 1) - at(1, 0)) * fx
    return top + (low - top) * fy


def line_mean(block: np.ndarray, reach: int, angle: float, distance: float) -> np.ndarray:
    turn = math.radians(angle)
    taps = max(2, min(MOST_TAPS, math.ceil(distance) + 1))
    places = [(t / (taps - 1) - 0.5) * distance for t in range(taps)]
    return sum(shifted(block, reach, math.cos(turn) * k, -math.sin(turn) * k) for k in places) / taps


def motion_blur(px: DataFrame, angle: float = 0.0, distance: float = 10.0, by: Keys = (), tile: int = TILE) -> DataFrame:
    """The mean along a line about each pixel, turned upwards by ``angle``."""
    reach = math.ceil(distance / 2) + 1
    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), reach, lambda v, xs, ys: straight_bytes(line_mean(v, reach, angle, distance)), by=by, tile=tile, dtype="int32")


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def shape_spans(shape: str, radius: float) -> list[tuple[int, int, int]]:
    """(dy, first, last) of the rows of a flat shape about its centre."""
    r = max(1, half_up(radius))
    out = []
    for dy in range(-r, r + 1):
        v = abs(dy) / r
        if shape == "ring":  # a quarter of the radius thick
            outer, hole = half_up(math.sqrt(max(0.0, 1 - v * v)) * r), 0.75 * r
            if abs(dy) < hole:
                inner = math.ceil(math.sqrt(hole * hole - dy * dy))
                out += [(dy, -outer, -inner), (dy, inner, outer)]
            else:
                out.append((dy, -outer, outer))
        elif shape == "triangle":
            side = -half_up(r * (dy / r + 1) / 2)
            out.append((dy, side, -side))
        else:
            half = {"square": r, "diamond": half_up(r * (1 - v)), "star": half_up(r * (1 - v) ** 2)}.get(shape, half_up(math.sqrt(max(0.0, 1 - v * v)) * r))
            out.append((dy, -half, half))
    return out


def shape_mean(block: np.ndarray, reach: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The mean over a flat shape, by running sums along rows."""
    n, m = block.shape[1] - 2 * reach, block.shape[2] - 2 * reach
    sums = np.concatenate([np.zeros((*block.shape[:2], 1)), np.cumsum(block, axis=2)], axis=2)
    total = sum(sums[:, reach + dy : reach + dy + n, reach + b + 1 : reach + b + 1 + m] - sums[:, reach + dy : reach + dy + n, reach + a : reach + a + m] for dy, a, b in spans)
    return total / sum(b - a + 1 for _, a, b in spans)


def shape_blur(px: DataFrame, shape: str = "disc", radius: float = 5, by: Keys = (), tile: int = TILE) -> DataFrame:
    """The mean over a disc, square, diamond, triangle, star or ring."""
    spans = shape_spans(shape, radius)
    reach = max(1, half_up(radius))
    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), reach, lambda v, xs, ys: straight_bytes(shape_mean(v, reach, spans)), by=by, tile=tile, dtype="int32")


def nearest_seeds(x: np.ndarray, y: np.ndarray, size: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the seeds, one in each cell of a grid, the nearest to each point: its place, its distance and that of the second.

    Only the nine cells around can hold it; of equally near ones the first, row
    by row, is taken.
    """
    cx, cy = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    best, second = np.full(x.shape, np.inf), np.full(x.shape, np.inf)
    bx, by = np.zeros(x.shape), np.zeros(x.shape)
    for j in (-1, 0, 1):
        for i in (-1, 0, 1):
            sx = (cx + i + position_hash(cx + i, cy + j, seed)) * size
            sy = (cy + j + position_hash(cx + i, cy + j, seed + 1)) * size
            d = (sx - x) ** 2 + (sy - y) ** 2
            less = d < best
            second = np.where(less, best, np.minimum(second, d))
            best, bx, by = np.where(less, d, best), np.where(less, sx, bx), np.where(less, sy, by)
    return bx, by, best, second


def _under(block: np.ndarray, reach: int, xs: np.ndarray, ys: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """The pixels under the seeds."""
    return block[:, np.floor(sy).astype(int) - ys[0] + reach, np.floor(sx).astype(int) - xs[0] + reach]


def _points(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.broadcast_to(xs[None, :] + 0.5, (len(ys), len(xs))), np.broadcast_to(ys[:, None] + 0.5, (len(ys), len(xs)))


def crystallize(px: DataFrame, cell: float = 10, seed: int = 1, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Each pixel takes the colour under the nearest seed."""
    reach = math.ceil(cell * 2) + 1

    def run(block, xs, ys):
        sx, sy, *_ = nearest_seeds(*_points(xs, ys), cell, seed)
        return straight_bytes(_under(block, reach, xs, ys, sx, sy))

    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), reach, run, by=by, tile=tile, dtype="int32")


def pointillize(px: DataFrame, cell: float = 5, seed: int = 1, background: tuple[int, int, int] = (255, 255, 255), by: Keys = (), tile: int = TILE) -> DataFrame:
    """Round dots at the seeds, in the colour under them, a little lighter or darker each, over a background."""
    reach = math.ceil(cell * 2) + 1

    def run(block, xs, ys):
        x, y = _points(xs, ys)
        sx, sy, d, _ = nearest_seeds(x, y, cell, seed)
        v = _under(block, reach, xs, ys, sx, sy)
        shade = (position_hash(np.floor(sx), np.floor(sy), seed + 2) - 0.5) * 0.12
        dot = np.stack([*np.clip(v[:3] + shade * v[3] * 1.0, 0, 65025), v[3]])
        ground = np.array([*(c * 255 for c in background), 65025])[:, None, None]
        return straight_bytes(np.where(d > (cell * 0.62) ** 2, ground, dot))

    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), reach, run, by=by, tile=tile, dtype="int32")


# Deconvolution.


def richardson_lucy(tiles: DataFrame, mean, reach: int, passes: int, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Tiles (r, g, b, a; seen r, g, b; estimate r, g, b) after ``passes`` of blur, divide, blur, multiply.

    ``mean`` blurs a block by a symmetric shape of that reach. Each pass is one
    exchange of edges, written down before the next.
    """

    def once(block: np.ndarray, row: dict) -> np.ndarray:
        left, top = row["tx"] * tile - reach, row["ty"] * tile - reach
        again = at_border(mean(block[7:], reach), left, top, row)
        more = mean(_middle(block, reach)[4:7] / np.maximum(1e-4 * 65025, again), reach)
        own = _middle(block, 2 * reach)
        return np.concatenate([own[:7], np.minimum(own[3], np.maximum(0, own[7:] * more))])

    for _ in range(passes):
        tiles = cut(stepped(tiles, 2 * reach, once, 10, by, tile))
    return tiles


def smart_sharpen(px: DataFrame, amount: float = 2.0, radius: float = 1.0, noise: float = 0.1, remove: str = "lens", angle: float = 0.0, passes: int = 4, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Adds ``amount`` of the detail that is found by taking back a blur: gaussian, lens (a disc) or motion (a line).

    ``noise`` smooths what the detail is taken from; gaussian is an unsharp mask,
    the others are ``passes`` of deconvolution.
    """
    smooth = gaussian_weights(0.6 * noise) if 0.6 * noise >= 0.05 else [1.0]
    wide = gaussian_weights(radius) if remove == "gaussian" and radius >= 0.05 else [1.0]
    soft = lambda v, w: along(along(v, w, 2), w, 1)
    near, far = len(smooth) - 1, len(wide) - 1

    def begin(block: np.ndarray, row: dict) -> np.ndarray:
        calm = at_border(soft(block, smooth), row["tx"] * tile - far, row["ty"] * tile - far, row)[:3]
        return np.concatenate([_middle(block, near + far), _middle(calm, far), soft(calm, wide)])

    tiles = cut(stepped(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), near + far, begin, 4, by, tile, "int32"))
    if remove == "gaussian":
        done = lambda v: v[:3] + amount * (v[:3] - v[7:])
    else:
        width = max(1.0, radius * 2)
        spans = shape_spans("disc", max(1.0, radius))
        mean = (lambda v, r: line_mean(v, r, angle, width)) if remove == "motion" else lambda v, r: shape_mean(v, r, spans)
        tiles = richardson_lucy(tiles, mean, math.ceil(width / 2) + 1 if remove == "motion" else half_up(max(1.0, radius)), passes, by, tile)
        done = lambda v: v[:3] + (v[7:] - v[4:7]) * amount
    return pointwise(tiles, lambda v, xs, ys: straight_bytes(np.stack([*done(v), v[3]])), 10, by=by, tile=tile)
