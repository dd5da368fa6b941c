"""Operators over several tiles against numpy, dense solves and brute force, on sparse rasters of several documents."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import compositing, distance, effects, healing, inpainting, paths, selections, text, tiled, tracing
from pixelloom.sources import psd
from pixelloom.streaming import strokes

H, W = 21, 90


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (2, 4, H, W))
    img[:, 3][rng.random((2, H, W)) < 0.1] = 0
    img[1, :, 5:9, 30:60] = 0  # absent from the table
    return img


@pytest.fixture(scope="module")
def px(spark, image):
    rows = [(d, x, y, *map(int, image[d, :, y, x])) for d in (0, 1) for y in range(H) for x in range(W) if not (d and 5 <= y < 9 and 30 <= x < 60)]
    return spark.createDataFrame(rows, "doc long, x long, y long, r long, g long, b long, a long").cache()


def array(df, channels="rgba", n=2):
    out = np.full((n, len(channels), H, W), -1.0)
    for r in df.collect():
        out[r["doc"], :, r["y"], r["x"]] = [r[c] for c in channels]
    return out


def premultiplied(img):
    return np.concatenate([img[:, :3] * img[:, 3:], img[:, 3:] * 255], 1).astype(float)


def boxed(v, r):
    for ax in (2, 3):
        n = v.shape[ax]
        p = np.take(v, np.clip(np.arange(-r, n + r), 0, n - 1), ax)
        c = np.concatenate([np.zeros_like(np.take(p, [0], ax)), np.cumsum(p, ax)], ax)
        v = np.take(c, range(2 * r + 1, 2 * r + 1 + n), ax) - np.take(c, range(n), ax)
    return v / (2 * r + 1) ** 2


def straight(v):
    return np.stack([tiled.straight_bytes(x) for x in v])


@pytest.mark.parametrize("radius", [1, 16, 300, 2000])
def test_box_of_any_radius(px, image, radius):
    assert np.array_equal(array(tiled.box_blur(px, radius, ("doc",), 16)), straight(boxed(premultiplied(image), radius)))


@pytest.mark.parametrize("sigma", [0.01, 2.5, 13, 50])
def test_gaussian_of_any_sigma(px, image, sigma):
    v = premultiplied(image)
    if sigma > 12:
        for _ in range(3):
            v = boxed(v, tiled.box_radius(sigma))
    elif sigma >= 0.05:
        half = tiled.gaussian_weights(sigma)
        k = len(half) - 1
        p = np.pad(v, ((0, 0), (0, 0), (k, k), (k, k)), mode="edge")
        full = [*half[:0:-1], *half]
        v = sum(w * p[..., i : i + W] for i, w in enumerate(full))
        v = sum(w * v[..., i : i + H, :] for i, w in enumerate(full))
    assert np.array_equal(array(tiled.gaussian(px, sigma, ("doc",), 16)), straight(v))


@pytest.mark.parametrize("radius", [2, 7])
def test_windows_over_tiles(px, image, radius):
    clear = image.copy()
    clear[:, :3] = np.where(clear[:, 3:] == 0, 0, clear[:, :3])
    side = 2 * radius + 1
    view = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (0, 0), (radius, radius), (radius, radius)), mode="edge"), (side, side), axis=(2, 3)).reshape(2, 4, H, W, -1)
    want = np.sort(view(clear), -1)[..., side * side // 2]
    want[:, :3] = np.where(want[:, 3:] == 0, 0, want[:, :3])
    assert np.array_equal(array(tiled.median(px, radius, ("doc",), 16)), want)
    assert np.array_equal(array(tiled.extreme(px, radius, by=("doc",), tile=16)), straight(view(premultiplied(image)).max(-1)))
    assert np.array_equal(array(tiled.extreme(px, radius, False, True, ("doc",), 16)), straight(disc(view(premultiplied(image)), radius)))


def disc(view, radius):
    at = np.arange(-radius, radius + 1)
    return view[..., (at[:, None] ** 2 + at[None, :] ** 2 <= radius * radius).ravel()].min(-1)


def test_empty_raster(spark, px):
    none = px.limit(0)
    assert tiled.box_blur(none, 3, ("doc",), 16).count() == 0 and tiled.median(none, 2, ("doc",), 16).count() == 0
    assert selections.feather(none.withColumn("cov", F.lit(1)), 9, ("doc",), 16).count() == 0 and distance.expand(none.withColumn("cov", F.lit(1)), 9, ("doc",), 16).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.002, 0.3, 1.0])
def test_nearest_marked_pixel(spark, share):
    rng = np.random.default_rng(3)
    cov = np.where(rng.random((2, H, W)) < share, 255, 0)
    cov[1, :, : W // 2] = 0
    sel = spark.createDataFrame([(d, x, y, int(cov[d, y, x])) for d in (0, 1) for y in range(H) for x in range(W)], "doc long, x long, y long, cov long")
    got = distance.nearest(sel, lambda c: c >= 128, ("doc",), 16).collect()
    assert len(got) == 2 * H * W
    marks = [np.argwhere(cov[d] >= 128) for d in (0, 1)]
    for r in got:
        if not len(m := marks[r["doc"]]):
            assert r["d2"] is None
            continue
        want = min((int((x - r["x"]) ** 2 + (y - r["y"]) ** 2), int(x), int(y)) for y, x in m)
        assert (r["d2"], r["nx"], r["ny"]) == want


def test_deconvolution_passes(px, image):
    """Blur, divide, blur, multiply on the whole raster at once."""
    v = premultiplied(image)
    cross = lambda z: sum(np.pad(z, ((0, 0), (0, 0), (1, 1), (1, 1)), mode="edge")[..., 1 + dy : 1 + dy + H, 1 + dx : 1 + dx + W] for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) / 5
    for passes in (1, 5):
        est = v[:, :3]
        for _ in range(passes):
            est = np.minimum(v[:, 3:], np.maximum(0, est * cross(v[:, :3] / np.maximum(6.5025, cross(est)))))
        want = straight(np.concatenate([v[:, :3] + (est - v[:, :3]) * 1.5, v[:, 3:]], 1))
        got = array(effects.smart_sharpen(px, 1.5, 1.0, 0.0, "lens", passes=passes, by=("doc",), tile=16))
        assert np.abs(got - want).max() <= 1 and (got != want).mean() < 1e-3  # halves may fall either way


def test_membrane_equals_dense_solve(spark, px, image):
    rng = np.random.default_rng(7)
    source = px.select("doc", "x", "y", *(((F.col(c) * 3 + F.col("x") * 2) % 256).alias(c) for c in "rgb"))
    yy, xx = np.mgrid[:H, :W]
    on = np.stack([(xx - 40) ** 2 / 9 + (yy - 10) ** 2 <= 70, rng.random((H, W)) < 0.97])
    on[1, :, 28:62] = False
    region = spark.createDataFrame([(d, x, y, 255) for d in (0, 1) for y in range(H) for x in range(W) if on[d, y, x]] + [(d, x, y, 0) for d in (0, 1) for x, y in ((0, 0), (W - 1, H - 1))], "doc long, x long, y long, cov long").groupBy("doc", "x", "y").agg(F.max("cov").alias("cov"))
    got = array(healing.heal(source, px, region, ("doc",), 16), "rgb")
    src = (image[:, :3] * 3 + xx * 2) % 256
    for d in (0, 1):
        deep = on[d].copy()
        deep[1:-1, 1:-1] &= on[d][:-2, 1:-1] & on[d][2:, 1:-1] & on[d][1:-1, :-2] & on[d][1:-1, 2:]
        deep[0] = deep[-1] = deep[:, 0] = deep[:, -1] = False
        at = -np.ones((H, W), int)
        at[deep] = np.arange(deep.sum())
        a, b, diff = np.zeros((deep.sum(),) * 2), np.zeros((deep.sum(), 3)), image[d, :3] - src[d]
        for y, x in zip(*np.nonzero(deep)):
            a[at[y, x], at[y, x]] = 4
            for j, i in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if at[j, i] >= 0:
                    a[at[y, x], at[j, i]] = -1
                else:
                    b[at[y, x]] += diff[:, j, i]
        v = np.linalg.solve(a, b)
        want = image[d, :3].astype(float)
        for k in range(3):
            want[k][deep] = np.clip(src[d, k][deep] + v[:, k], 0, 255)
        there = got[d, 0] >= 0
        assert np.abs(got[d] - want)[:, there].max() <= 0.52


def test_layers_of_files_round_trip(spark, px, image, tmp_path):
    pixels = px.where("doc = 1 or x > 10").withColumn("layer", F.col("doc") * 2 + 5).select(F.lit(3).alias("doc"), "layer", "x", "y", "r", "g", "b", "a")
    layers = spark.createDataFrame([(3, 5, None, 0, "pixel", "below"), (3, 6, None, 1, "group", "Gruppe ☃ " * 30), (3, 7, 6, 0, "pixel", "")], "doc int, id long, parent long, z long, kind string, name string").withColumn("mode", F.when(F.col("id") == 7, "hardLight").otherwise("normal"))
    masks = pixels.where("layer = 7 and x < 20").select("doc", "layer", "x", "y", F.col("r").alias("cov"))
    layers = layers.withColumn("masked", F.col("id") == 7)
    flat = compositing.composite(layers, pixels, masks)
    psd.save(psd.written(layers, pixels, flat, masks), str(tmp_path))
    good = (tmp_path / "3.psd").read_bytes()
    for k, cut in enumerate((1, 3, 25, 40, 200, len(good) // 2, len(good) - 30_000)):
        (tmp_path / f"cut{k}.psd").write_bytes(good[:cut])
    read = psd.parsed(psd.files(spark, str(tmp_path))).cache()
    about = {r["doc"].rsplit("/", 1)[1]: r for r in psd.documents(read).collect()}
    assert about["3.psd"]["error"] is None and (about["3.psd"]["width"], about["3.psd"]["height"]) == (W, H)
    assert all(about[f"cut{k}.psd"]["error"] for k in range(6))
    own = F.col("doc").endswith("/3.psd")
    rows = {r["name"]: r for r in psd.layers(read).where(own).collect()}
    assert {n: (r["kind"], r["mode"], r["z"], r["masked"]) for n, r in rows.items()} == {"below": ("pixel", "normal", 0, False), "Gruppe ☃ " * 30: ("group", "normal", 1, False), "": ("pixel", "hardLight", 0, True)}
    assert rows[""]["parent"] == rows["Gruppe ☃ " * 30]["id"]
    number = {rows["below"]["id"]: 5, rows[""]["id"]: 7}
    value = lambda r: (number.get(r["layer"], r["layer"]), r["x"], r["y"], r["r"], r["g"], r["b"], r["a"])
    seen = lambda r: any(value(r)[3:])
    assert {value(r) for r in psd.pixels(read).where(own).collect() if seen(r)} == {value(r) for r in pixels.collect() if seen(r)}
    again = compositing.composite(psd.layers(read).where(own), psd.pixels(read).where(own), psd.masks(read).where(own))
    key = lambda r: tuple(r[c] for c in "xyrgba")
    assert {key(r) for r in again.collect()} == {key(r) for r in flat.collect()}


@pytest.mark.parametrize("depth", [8, 16])
def test_channels_in_all_compressions(depth):
    rng = np.random.default_rng(4)
    v = rng.choice([0, 7, 7, 7, 255], (9, 300)).astype(np.int64)
    raw = (v * (257 if depth == 16 else 1)).astype(">u2" if depth == 16 else "u1")
    lines = [psd.packed_row(line.tobytes()) for line in raw]
    differences = np.diff(raw.astype(np.int64), axis=1, prepend=0).astype(raw.dtype)
    for kind, body in enumerate((raw.tobytes(), struct.pack(">9H", *map(len, lines)) + b"".join(lines), zlib.compress(raw.tobytes()), zlib.compress(differences.tobytes()))):
        assert np.array_equal(psd.unpacked(struct.pack(">H", kind) + body, 300, 9, depth, False), v)


def test_strokes_go_on_after_a_restart(spark, tmp_path):
    """Two runs over two files give the dabs of one fold, without those of the first again."""
    rng = np.random.default_rng(5)
    brush = strokes.Brush(size=9.0, smoothing=0.4)
    samples = [(int(s), k, float(rng.uniform(0, 80)), float(rng.uniform(0, 40)), float(rng.uniform(0, 1))) for k in range(60) for s in (1, 2)]
    schema = "stroke long, seq long, x double, y double, pressure double, at timestamp"
    for part, name in ((samples[:70], "a"), (samples[70:], "b")):
        spark.createDataFrame(part, "stroke long, seq long, x double, y double, pressure double").withColumn("at", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = strokes.run_strokes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), brush)
    want = []
    for s in (1, 2):
        state = None
        for _, _, x, y, p in (r for r in samples if r[0] == s):
            state, dabs = strokes.follow(brush, state, x, y, p)
            want += [(s, *d) for d in dabs]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    parts = strokes.coverage(got, spark.createDataFrame([(0, 0, 80, 40)], "x0 long, y0 long, x1 long, y1 long"), brush, 16)
    cover = {(r["stroke"], r["x"], r["y"]): r["cover"] for r in parts.collect()}
    for (s, x, y), c in list(cover.items())[::97]:
        left = np.prod([1 - strokes.dab_alpha(brush, np.array(x + 0.5), np.array(y + 0.5), d[2], d[3], d[4]) for d in want if d[0] == s])
        assert abs(c - (1 - left)) < 1e-9


def test_leash_and_catch_up():
    """A leashed brush stays its leash behind; one that catches up ends where the pen left, with dabs all along."""
    lag = strokes.Brush(size=8.0, smoothing=0.5)
    end = strokes.Brush(size=8.0, smoothing=0.5, catch_up=True)
    leash = strokes.Brush(size=8.0, smoothing=0.5, leash=True)
    state, _ = strokes.follow(leash, None, 0.0, 0.0, 1.0)
    state, dabs = strokes.follow(leash, state, 20.0, 0.0, 1.0)
    assert state[:2] == (0.0, 0.0) and not dabs
    state, dabs = strokes.follow(leash, state, 40.0, 0.0, 1.0)
    assert state[:2] == (10.0, 0.0) and [d[1] for d in dabs] == [2, 4, 6, 8, 10]
    for brush, last in ((lag, 20.0), (end, 40.0)):
        state, _ = strokes.follow(brush, None, 0.0, 0.0, 1.0)
        state, dabs = strokes.follow(brush, state, 40.0, 0.0, 1.0, lift=True)
        assert state[0] == last and [d[1] for d in dabs] == [2.0 * k for k in range(1, int(last / 2) + 1)]
        assert [d[0] for d in dabs] == list(range(1, len(dabs) + 1))


def test_cubics_stay_within_tolerance(spark):
    """A circle of four cubics: its area, its outline's distance to the curve, and its coverage."""
    k = 0.5522847498
    knots = [(0, 0, n, 30.0 + 20 * x, 25.0 + 20 * y, 30 + 20 * (x + k * y), 25 + 20 * (y - k * x), 30 + 20 * (x - k * y), 25 + 20 * (y + k * x)) for n, (x, y) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1)))]
    rows = spark.createDataFrame(knots, "doc long, shape long, n long, ax double, ay double, ix double, iy double, ox double, oy double")
    shapes = spark.createDataFrame([(0, 0, True, "add", "nonzero")], "doc long, shape long, closed boolean, op string, rule string")
    outline = paths.edges(rows, shapes)
    assert all(abs(np.hypot(r["x0"] - 30, r["y0"] - 25) - 20) < 0.06 for r in outline.collect())
    area = paths.areas(outline).first()["area"]
    assert abs(area - np.pi * 400) < 4
    assert abs(paths.areas(paths.edges(paths.reversed_knots(rows), shapes)).first()["area"] + area) < 1e-6
    box = spark.createDataFrame([(0, 0, 0, 60, 60)], "doc long, x0 long, y0 long, x1 long, y1 long")
    covered = paths.coverage(outline, shapes, box).agg(F.sum("cover")).first()[0]
    assert abs(covered - area) < 0.5
    moved = paths.edges(paths.transformed(rows, 2, 0, 0, 1, 3, -4), shapes)
    assert abs(paths.areas(moved).first()["area"] - 2 * area) < 1


def test_reversed_runs():
    """A paragraph of each direction, by the published rules."""

    def show(t):
        kind = text.directions(text.code_points(t))
        return "".join(t[k] for k in text.visual_order(text.levels(kind, text.paragraph_level(kind))))

    assert show("abc אבג def") == "abc גבא def"
    assert show("abc אב 12 גד e") == "abc דג 12 בא e"
    assert show("אבג abc דה") == "הד abc גבא"
    assert show("") == "" and text.break_places(text.code_points("a-b c")).tolist() == [2, 4, 5]
    assert text.break_places(text.code_points("漢字。漢")).tolist() == [1, 3, 4]


def test_contours_become_closed_curves(spark, monkeypatch):
    """Rings against a walk from point to point; each point within the tolerance of the curves, in one arc and in several."""
    rng = np.random.default_rng(8)
    yy, xx = np.mgrid[:40, :60]
    far = np.hypot(xx - 25, yy - 20)
    cov = np.clip((16 - far) * 200, 0, 255) * (far > 7)
    cov[:, 45:] = rng.integers(0, 256, (40, 15))
    sel = spark.createDataFrame([(d, x, y, int(cov[y, x])) for d in (4, 9) for y in range(40) for x in range(60)], "doc long, x long, y long, cov long")
    rows = tracing.rings(tracing.links(sel)).cache()
    got = [r for r in rows.collect() if r["doc"] == 4]
    after, place = {r["node"]: r["next"] for r in got}, {r["node"]: (r["ring"], r["n"]) for r in got}
    assert len(after) == len(got) and set(after) == set(after.values())
    left = set(after)
    while left:
        node = ring = min(left)
        for n in range(len(after)):
            assert place[node] == (ring, n)
            left.discard(node)
            node = after[node]
            if node == ring:
                break
    at = np.linspace(0, 1, 50)
    for arc in (tracing.ARC, 20):
        monkeypatch.setattr(tracing, "ARC", arc)
        cubics = [r for r in tracing.curves(rows, 0.5).collect() if r["doc"] == 4]
        by_ring = {}
        for c in sorted(cubics, key=lambda c: (c["shape"], c["n"])):
            by_ring.setdefault(c["shape"], []).append(np.array([[c[f"x{k}"], c[f"y{k}"]] for k in range(4)]))
        assert set(by_ring) == {r["ring"] for r in got}
        for ring, cs in by_ring.items():
            assert all(np.allclose(a[3], b[0]) for a, b in zip(cs, [*cs[1:], cs[0]]))
            on = np.concatenate([tracing._at(c, at) for c in cs])
            points = np.array([(r["x"], r["y"]) for r in got if r["ring"] == ring])
            assert max(np.hypot(*(on - p).T).min() for p in points) < 0.55


def test_no_contour(spark):
    none = spark.createDataFrame([(1, 0, 0, 0)], "doc long, x long, y long, cov long")
    assert tracing.rings(tracing.links(none)).count() == 0 and tracing.curves(tracing.rings(tracing.links(none))).count() == 0


def test_hole_takes_up_the_texture(spark):
    """A texture that repeats comes back exactly; distances never rise in a step; reruns agree; nothing known, nothing found."""
    yy, xx = np.mgrid[:40, :48]
    img = np.stack([((xx // 4 + yy // 4) % 2) * 200 + 20, (xx % 8) * 30, (yy % 8) * 30])
    px = spark.createDataFrame([(x, y, *map(int, img[:, y, x]), 255) for y in range(40) for x in range(48)], "x long, y long, r long, g long, b long, a long")
    hole = spark.createDataFrame([(x, y, 255) for y in range(14, 24) for x in range(18, 30)], "x long, y long, cov long")
    marked = px.join(hole, ["x", "y"], "left").select("x", "y", *(F.when(F.col("cov").isNull(), F.col(c)).otherwise(0).alias(f"v{k}") for k, c in enumerate("rgb")), F.col("cov").isNotNull().cast("int").alias("hole"))
    runs = [inpainting.match(marked.repartition(n, "x"), tile=32) for n in (1, 3)]
    assert runs[0][1] == runs[1][1] == sorted(runs[0][1], reverse=True)
    assert set(map(tuple, runs[0][0].collect())) == set(map(tuple, runs[1][0].collect()))
    got = inpainting.inpaint(px, hole, tile=32)
    assert all((r["r"], r["g"], r["b"], r["a"]) == (*img[:, r["y"], r["x"]], 255) for r in got.collect())
    small = px.where("x < 9 and y < 9")
    assert inpainting.inpaint(small, hole.limit(0), tile=16).exceptAll(small).isEmpty()
    assert inpainting.inpaint(small, small.select("x", "y", F.lit(255).alias("cov")), tile=16).count() == 81
