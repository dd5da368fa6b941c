"""Filters on tiles of arrays: box and Gaussian blurs, medians, extremes and kernels of any reach.

All take rasters told apart by ``by`` and may be sparse: absent pixels within a
raster's bounds are transparent, and stand in the result. Colour is filtered
premultiplied (colour times alpha, alpha times 255: whole numbers); edges repeat
the border pixel; results are straight bytes, rounded to even, and without alpha
there is no colour.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut
from pixelloom.operators.tiles import RGBA, TILE, Keys, beside, box, filtered, pointwise, to_tiles

RGB = RGBA[:3]
#: Gaussians beyond are three boxes, as is usual.
WIDEST_KERNEL = 12.0
#: Windows up to so many pixels are sorted; larger ones are counted level by level.
SORTED_WINDOW = 121


def premultiplied(px: DataFrame, by: Keys = ()) -> DataFrame:
    return px.select(*by, "x", "y", *((F.col(c) * F.col("a")).alias(c) for c in RGB), (F.col("a") * 255).alias("a"))


def clear_colors(px: DataFrame, by: Keys = ()) -> DataFrame:
    """Straight values; without alpha no colour."""
    return px.select(*by, "x", "y", *(F.when(F.col("a") == 0, 0).otherwise(F.col(c)).cast("long").alias(c) for c in RGB), "a")


def straight_bytes(v: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
    """Straight bytes of premultiplied planes; with ``a``, an alpha that stays as it is."""
    a = v[3] if a is None else a
    empty = a <= 127.5
    safe = np.where(empty, 1, a)
    rgb = np.where(empty, 0, np.rint(np.minimum(a, np.maximum(0, v[:3])) * 255 / safe))
    return np.concatenate([rgb, np.where(empty, 0, np.rint(a / 255))[None]])


def _middle(block: np.ndarray, reach: int) -> np.ndarray:
    """A block without ``reach`` pixels at each side."""
    return block[:, reach : block.shape[1] - reach, reach : block.shape[2] - reach]


def along(block: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """A one-sided symmetric kernel (centre first) along an axis; the result is shorter by its reach at both ends."""
    reach = len(weights) - 1
    n = block.shape[axis] - 2 * reach
    cut = lambda k: np.take(block, range(reach + k, reach + k + n), axis)
    return cut(0) * weights[0] + sum((cut(k) + cut(-k)) * w for k, w in enumerate(weights) if k)


def gaussian_weights(sigma: float) -> list[float]:
    """Weights from the centre outwards, to three sigma; both sides sum to one."""
    half = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(max(1, math.ceil(3 * sigma)) + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [v / total for v in half]


def box_radius(sigma: float) -> int:
    """The radius of each of three boxes whose variances add up to a Gaussian's."""
    return max(1, math.floor((math.sqrt(4 * sigma * sigma + 1) - 1) / 2 + 0.5))


def convolve(px: DataFrame, kernel: list[float], scale: float = 1, offset: float = 0, alpha: bool = False, by: Keys = (), tile: int = TILE) -> DataFrame:
    """A square kernel of odd size (row by row); ``offset`` in levels; alpha is kept or convolved too."""
    size = math.isqrt(len(kernel))
    reach = size // 2

    def run(block, xs, ys):
        n = len(xs)
        total = sum(block[:, i // size : i // size + n, i % size : i % size + n] * k for i, k in enumerate(kernel) if k) / scale
        a = np.clip(total[3] + offset * 255, 0, 65025) if alpha else _middle(block, reach)[3]
        return straight_bytes(np.stack([*(total[:3] + a * (offset / 255)), a]))

    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), reach, run, by=by, tile=tile, dtype="int32")


def box_blur(px: DataFrame, radius: int = 10, by: Keys = (), tile: int = TILE) -> DataFrame:
    """The mean of a square of any radius: what is shuffled does not grow with it."""
    blurred = box(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), radius, by=by, tile=tile, dtype="int32")
    return pointwise(blurred, lambda v, xs, ys: straight_bytes(v), by=by, tile=tile)


def _with_blur(px: DataFrame, sigma: float, one, by: Keys, tile: int) -> DataFrame:
    """The pixels ``one`` makes of premultiplied planes and their Gaussian blur."""
    tiles = to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32")
    if sigma <= WIDEST_KERNEL:
        weights = gaussian_weights(sigma) if sigma >= 0.05 else [1.0]
        reach = len(weights) - 1
        return filtered(tiles, reach, lambda v, xs, ys: one(_middle(v, reach), along(along(v, weights, 2), weights, 1)), by=by, tile=tile, dtype="int32")
    tiles = cut(tiles)
    blurred = box(tiles, box_radius(sigma), 3, by=by, tile=tile, dtype="int32")
    return pointwise(beside(tiles, blurred, by, tile), lambda v, xs, ys: one(v[:4], v[4:]), channels=8, by=by, tile=tile)


def gaussian(px: DataFrame, sigma: float = 0.6, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Gaussian blur of colour and alpha: a kernel up to WIDEST_KERNEL, three boxes beyond."""
    return _with_blur(px, sigma, lambda v, g: straight_bytes(g), by, tile)


def unsharp_mask(px: DataFrame, amount: float = 0.5, sigma: float = 0.6, threshold: int = 10, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Adds ``amount`` of the difference to a blur where that reaches the threshold; alpha stays."""

    def one(v, g):
        a = np.where(v[3] == 0, 255, v[3]) / 255
        new = np.where(np.abs(v[:3] - g[:3]) / a < threshold, v[:3], v[:3] + amount * (v[:3] - g[:3]))
        return straight_bytes(np.stack([*new, v[3]]))

    return _with_blur(px, sigma, one, by, tile)


def high_pass(px: DataFrame, sigma: float = 2, by: Keys = (), tile: int = TILE) -> DataFrame:
    """What a blur takes away, about middle grey, in straight colour; alpha stays."""

    def one(v, g):
        clear, a, ga = v[3] == 0, np.where(v[3] == 0, 255, v[3]), np.where(g[3] == 0, 1, g[3])
        rgb = np.rint(np.clip((v[:3] * 255 / a - g[:3] * 255 / ga) / 255 + 0.5, 0, 1) * 255)
        return np.stack([*np.where(clear, 0, rgb), np.rint(v[3] / 255)])

    return _with_blur(px, sigma, one, by, tile)


def window_median(plane: np.ndarray, reach: int) -> np.ndarray:
    """The median of the square around each value (whole numbers 0 to 255); smaller by the reach at each side."""
    side = 2 * reach + 1
    n = plane.shape[0] - 2 * reach
    if side * side <= SORTED_WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(plane.astype(np.uint8), (side, side))
        return np.stack([np.partition(view[k].reshape(n, -1), side * side // 2, axis=1)[:, side * side // 2] for k in range(n)]).astype(np.float64)
    out = np.zeros((n, n))
    for level in range(256):
        sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
        sums[1:, 1:] = np.cumsum(np.cumsum(plane <= level, 0), 1)
        count = sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]
        out += count <= side * side // 2
    return out


def median(px: DataFrame, radius: int = 1, by: Keys = (), tile: int = TILE) -> DataFrame:
    """The median of each straight channel and of alpha over a square."""

    def run(block, xs, ys):
        got = np.stack([window_median(v, radius) for v in block])
        return np.stack([*np.where(got[3] == 0, 0, got[:3]), got[3]])

    return filtered(to_tiles(clear_colors(px, by), by=by, tile=tile), radius, run, by=by, tile=tile)


def dust_and_scratches(px: DataFrame, radius: int = 1, threshold: int = 20, by: Keys = (), tile: int = TILE) -> DataFrame:
    """The median of a channel where it is further off than the threshold; alpha stays."""

    def run(block, xs, ys):
        own = _middle(block, radius)
        got = np.stack([window_median(v, radius) for v in block[:3]])
        rgb = np.where(np.abs(own[:3] - got) > threshold, got, own[:3])
        return np.stack([*np.where(own[3] == 0, 0, rgb), own[3]])

    return filtered(to_tiles(clear_colors(px, by), by=by, tile=tile), radius, run, by=by, tile=tile)


def sliding(v: np.ndarray, width: int, axis: int, f=np.maximum) -> np.ndarray:
    """The extreme of ``width`` values in a row, by doubling; shorter by width - 1."""
    size = 1
    while size < width:
        step = min(size, width - size)
        n = v.shape[axis] - step
        v = f(np.take(v, range(n), axis), np.take(v, range(step, step + n), axis))
        size += step
    return v


def extreme(px: DataFrame, radius: int = 1, largest: bool = True, disc: bool = False, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Greatest or least of a square or disc, of each premultiplied channel."""
    f = np.maximum if largest else np.minimum

    def run(block, xs, ys):
        n, side = len(xs), 2 * radius + 1
        if not disc:
            return straight_bytes(sliding(sliding(block, side, 2, f), side, 1, f))
        best = None
        for dy in range(-radius, radius + 1):
            half = math.isqrt(radius * radius - dy * dy)
            row = block[:, radius + dy : radius + dy + n, radius - half : radius + half + n]
            row = sliding(row, 2 * half + 1, 2, f)
            best = row if best is None else f(best, row)
        return straight_bytes(best)

    return filtered(to_tiles(premultiplied(px, by), by=by, tile=tile, dtype="int32"), radius, run, by=by, tile=tile, dtype="int32")


def sharpen(px: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    return convolve(px, [-1, -1, -1, -1, 12, -1, -1, -1, -1], 4, by=by, tile=tile)


def sharpen_more(px: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    return convolve(px, [-1, -1, -1, -1, 9, -1, -1, -1, -1], by=by, tile=tile)


def sharpen_edges(px: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    return unsharp_mask(px, 1.0, 1.0, 8, by, tile)


def find_edges(px: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Dark edges on white: one less half the Sobel magnitude of each straight channel; alpha stays."""

    def run(block, xs, ys):
        n = len(xs)
        at = lambda j, i: block[:3, j : j + n, i : i + n]
        gx = at(0, 2) + 2 * at(1, 2) + at(2, 2) - at(0, 0) - 2 * at(1, 0) - at(2, 0)
        gy = at(2, 0) + 2 * at(2, 1) + at(2, 2) - at(0, 0) - 2 * at(0, 1) - at(0, 2)
        a = block[3, 1:-1, 1:-1]
        return np.stack([*np.where(a == 0, 0, np.rint(255 - np.minimum(255, np.sqrt(gx * gx + gy * gy) / 2))), a])

    return filtered(to_tiles(clear_colors(px, by), by=by, tile=tile), 1, run, by=by, tile=tile)
