"""Plans and results that must hold when tables grow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import gather as G


def raster(spark, w, h):
    at = spark.range(w * h).select((F.col("id") % w).alias("x"), F.floor(F.col("id") / w).alias("y"), F.col("id"))
    return at.select("x", "y", (F.col("id") * 37 % 256).alias("r"), (F.col("id") * 11 % 251).alias("g"), (F.col("id") * 5 % 199).alias("b"), F.when(F.col("id") % 7 == 0, 0).otherwise(255).cast("long").alias("a"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gathers_join_no_taps(spark):
    """A target is one row; no table of pixels is broadcast or collected."""
    px = raster(spark, 30, 20)
    for df in (G.resample(px, 0.7, 1.3), G.wave(px), G.polar(px, False)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" not in plan(df) and "collect_list" not in plan(df)


@pytest.mark.parametrize("edge", ["repeat", "wrap", "transparent"])
@pytest.mark.parametrize("w,h", [(1, 1), (2, 3), (70, 130)])
def test_gather_takes_every_tap(spark, edge, w, h):
    """Targets far beyond the raster, rasters smaller than a kernel and of several blocks, all on one block."""
    px = raster(spark, w, h)
    at = spark.range(400).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), (F.col("id") * 1.37 - 150).alias("u"), (F.col("id") * 0.71 - 90).alias("v"), F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h"))
    got = {r.x: (r.r, r.g, r.b, r.a) for r in G.gather(at, px, "bicubic", edge).collect()}
    src = np.zeros((h, w, 4))
    for p in px.collect():
        src[p.y, p.x] = p.r * p.a, p.g * p.a, p.b * p.a, p.a * 255
    a = G.SHARPNESS["bicubic"]
    key = lambda t: (a + 2) * t**3 - (a + 3) * t * t + 1 if t <= 1 else a * t**3 - 5 * a * t * t + 8 * a * t - 4 * a if t < 2 else 0.0
    want = {}
    for k in range(400):
        u, v = k * 1.37 - 150, k * 0.71 - 90
        u0, v0 = math.floor(u), math.floor(v)
        for j in range(-1, 3):
            for i in range(-1, 3):
                x, y = u0 + i, v0 + j
                if edge == "repeat":
                    x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
                elif edge == "wrap":
                    x, y = x % w, y % h
                if 0 <= x < w and 0 <= y < h:
                    want[k] = want.get(k, 0) + key(abs(u - u0 - i)) * key(abs(v - v0 - j)) * src[y, x]
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-6)


#: Pixels of the events six times over, and what DuckDB makes of them.
HUES = [(73, 217, 113, 255), (0, 210, 140, 128), (11, 255, 175, 128), (102, 203, 47, 255), (0, 170, 118, 255), (172, 232, 2, 255)]
HUE_RESULTS = [(165, 205, 136), (0, 223, 167), (21, 255, 200), (187, 197, 105), (0, 180, 149), (120, 236, 0)]


def test_hue_bands_round_as_the_sql_does(spark):
    """A pixel whose red lies on a half by the remainder's last bits."""
    from pixelloom.operators import adjust as A
    from pixelloom.plans.adjustments import _BANDS

    found = spark.createDataFrame([(0, 0, *c) for c in HUES], "x long, y long, r long, g long, b long, a long")
    got = [(r.r, r.g, r.b) for r in A.hue_bands(found, (15, 10, 0), _BANDS).collect()]
    assert got == HUE_RESULTS


def test_coverage_gathers_no_row_of_pixels(spark):
    """Crossings stream through; no group of them becomes one value."""
    from pixelloom.operators import paths as P

    points = spark.createDataFrame([(0, 0, n, float(n * 7 % 11), float(n * 5 % 13)) for n in range(9)], "doc long, shape long, n long, x double, y double")
    shapes = spark.createDataFrame([(0, 0, True, "add", "evenodd")], "doc long, shape long, closed boolean, op string, rule string")
    boxes = spark.createDataFrame([(0, 0, 0, 12, 14)], "doc long, x0 long, y0 long, x1 long, y1 long")
    cover = P.coverage(P.edges(P.straight_knots(points), shapes), shapes, boxes)
    assert "turn" not in "".join(line for line in plan(cover).splitlines() if "collect_list" in line) and "struct(k" not in plan(cover)


def test_texts_are_sent_on_in_chunks(spark, monkeypatch):
    """One batch of texts becomes several of results."""
    import pyarrow as pa

    from pixelloom.operators import text as T

    monkeypatch.setattr(T, "CHUNK", 10)
    held = {}

    class Docs:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            held["run"] = run

    T.breaks(Docs())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": ["ab cd ef"] * 6})
    made = list(held["run"](iter([batch])))
    assert [b.num_rows for b in made] == [2, 2, 2] and made[0].column(1).to_pylist() == [[3, 6, 8]] * 2


def test_components_broadcast_no_graph(spark):
    """Small files of many edges are merged."""
    from pixelloom.operators import regions as R

    edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = R.components(edges)
    assert {r.label for r in found.collect()} == {0}
    px = raster(spark, 12, 9)
    assert "BroadcastHashJoin" not in plan(R.regions(px, F.lit(True), ("r",)))


def test_views_round_as_the_sql_does(spark, tmp_path):
    """A view whose matrix lies on half a millionth by the last bits of its shift."""
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    con.sql(f"copy (select 60000000 + k as event_id, k * 7 as user_id, k % 256 + 0.5::double as value, 'view' as event_type, timestamp '2024-01-01' as ts from range(0, 60000) t(k)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = E.queries()["scalar_views"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({E.oracle_sql()['scalar_views']})").fetchall())


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_parts_and_round_seconds(spark, tmp_path, parts):
    """Events half a second about a window's edge; a table of several files."""
    import duckdb

    import __spark_entry__ as E

    con, folder = duckdb.connect(), tmp_path / "events.parquet"
    if parts > 1:
        folder.mkdir()
    for part in range(parts):
        con.sql(f"copy (select {part} * 100 + k as event_id, timestamp '2024-02-17' + to_microseconds((k - 9) * 100000) as ts, k * 7 as user_id, 'view' as event_type, k * 3.5::double as value from range(0, 20) t(k)) to '{folder if parts == 1 else folder / f'part-{part}.parquet'}' (format parquet)")
    con.sql(f"create view events as select * from '{folder if parts == 1 else folder / '*.parquet'}'")
    got = E.queries()["stream_histogram"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({E.oracle_sql()['stream_histogram']})").fetchall())


def test_rings_close_over_many_blocks(spark, monkeypatch):
    """Rings within a block, over several and around the origin, put end to end in a few passes however long they are."""
    from pixelloom.operators import tracing as T

    rng = np.random.default_rng(6)
    cov = rng.integers(0, 256, (40, 30))
    cov[2:38, 18:29] = 255
    sel = spark.createDataFrame([(d, x, y, int(cov[y, x])) for d in (1, 2) for y in range(40) for x in range(30)], "doc long, x long, y long, cov long")
    points, joined = T.links(sel).cache(), []
    checkpoint = type(sel).checkpoint
    monkeypatch.setattr(type(sel), "checkpoint", lambda df, *a: joined.append(1) or checkpoint(df, *a))
    monkeypatch.setattr(T, "SIDE", 4)
    monkeypatch.setattr(T, "GROWTH", 4)
    got = T.rings(points).collect()
    assert len(joined) <= 5
    after, place = {(r.doc, r.node): r.next for r in got}, {(r.doc, r.node): (r.ring, r.n, r.size) for r in got}
    assert len(got) == points.count() == len(after)
    seen = {}
    for (doc, node), (ring, n, size) in place.items():
        assert ring <= node and (n == 0) == (node == ring)
        assert place[doc, after[doc, node]] == (ring, (n + 1) % size, size)
        seen[doc, ring] = seen.get((doc, ring), 0) + 1
    assert all(seen[doc, ring] == size for (doc, _), (ring, _, size) in place.items())


def test_places_are_not_worked_out_under_a_condition(spark):
    """What u and v share is worked out once; neither the test of a pixel nor a branch repeats it."""
    for line in plan(G.spherize(raster(spark, 30, 20))).splitlines():
        assert "ASIN" not in line or not ("CASE WHEN" in line or "Filter" in line or "NestedLoopJoin" in line)


def test_distances_bring_the_coverage_along(spark):
    """Nearest pixels of other tiles with their coverage; pixels are not joined by them, as thousands share one."""
    from pixelloom.operators import distance as D

    cov = np.random.default_rng(27).integers(0, 100, (40, 9))
    cov[[3, 30], [2, 7]] = 150, 250
    sel = spark.createDataFrame([(x, y, int(cov[y, x])) for y in range(40) for x in range(9)], "x long, y long, cov long")
    got = D.with_coverage(sel, lambda c: c >= 128, tile=4).collect()
    assert len(got) == cov.size and all(r.ncov == cov[r.ny, r.nx] and r.d2 == min((r.x - x) ** 2 + (r.y - y) ** 2 for x, y in ((2, 3), (7, 30))) for r in got)
    assert "nx" not in "".join(line for line in plan(D.signed_distance(sel, tile=4)).splitlines() if "Join" in line)


def test_surface_blur_sorts_no_pixels_in_windows(spark):
    """A tile's squares are summed as arrays of the tile, not as an array a pixel (F34); values against a walk over pixels."""
    from pixelloom.operators import stencils as S

    px = raster(spark, 12, 9)
    df = S.surface_blur(px, 2, 20)
    assert "Window" not in plan(df)
    src = {(p.x, p.y): (p.r, p.g, p.b, p.a) if p.a else (0, 0, 0, 0) for p in px.collect()}
    for p in df.collect():
        near = [src[min(max(p.x + i, 0), 11), min(max(p.y + j, 0), 8)] for j in range(-2, 3) for i in range(-2, 3)]
        own = src[p.x, p.y]
        for k, c in enumerate("rgb"):
            w = [max(0.0, 1 - abs(n[k] - own[k]) / 50.0) * n[3] for n in near]
            want = round(sum(n[k] * v for n, v in zip(near, w)) / sum(w)) if own[3] else 0
            assert p[c] == want
        assert p.a == own[3]


def test_documents_shuffle_no_values_of_channels(spark, tmp_path):
    """A pixel is one row where channels are packed and none where they become tiles (F25); layers and masks that begin beyond the canvas."""
    from pixelloom.operators import compositing as C
    from pixelloom.operators import tiles as T
    from pixelloom.sources import psd

    px = raster(spark, 90, 70).select(F.lit(4).cast("long").alias("doc"), F.lit(1).cast("long").alias("layer"), "x", "y", "r", "g", "b", "a")
    px = px.union(px.where("x < 80 and y > 8").select("doc", F.lit(2).cast("long"), F.col("x") - 7, F.col("y") - 9, "g", "b", "r", "a"))
    masks = px.where("layer = 2 and x < 65").select("doc", "layer", "x", "y", F.col("b").alias("cov"))
    layers = spark.createDataFrame([(4, 1, None, 0, "pixel", False), (4, 2, None, 1, "pixel", True)], "doc long, id long, parent long, z long, kind string, masked boolean")
    for df in (psd._channel_bytes(px, {"a": -1, "r": 0, "g": 1, "b": 2}), psd._channel_bytes(masks, {"cov": -2})):
        assert "Generate" not in plan(df) and "Join" not in plan(df)
    psd.save(psd.written(layers, px, C.composite(layers, px, masks, T.bounds(px.where("layer = 1"), ("doc",))), masks), str(tmp_path))
    read = psd.parsed(psd.files(spark, str(tmp_path)))
    for df in (psd.pixels(read), psd.masks(read), psd.tiles(read), psd.boxes(read)):
        assert not any(", x#" in line for line in plan(df).splitlines() if "Exchange" in line)
    got, want = C.folded(psd.layers(read), psd.tiles(read), psd.boxes(read)), C.composite(psd.layers(read), psd.pixels(read), psd.masks(read))
    assert {tuple(r)[1:] for r in got.collect()} == {tuple(r)[1:] for r in want.collect()} == {tuple(r)[1:] for r in C.composite(layers, px, masks).collect()}


def test_run_lengths_of_planes():
    """Rows packed together are those of a walk over bytes: runs of 128 and more, rests of one and two."""
    from pixelloom.sources import psd

    rng = np.random.default_rng(25)
    for w in (0, 1, 2, 3, 127, 128, 129, 130, 131, 259):
        for share in (0.02, 0.5, 1.0):
            v = np.cumsum(rng.random((5, w)) > share, axis=1).astype(np.uint8)
            assert [psd._runs(line, w) for line in psd.packed_rows(v)] == [row.tobytes() for row in v]


def test_membranes_move_only_open_tiles(spark, monkeypatch):
    """A round holds the tiles that have open pixels, in groups of one tile and no batches of tiles (F32, F29); values against a dense solve."""
    from pixelloom.operators import healing as H

    w, h = 70, 90
    rng = np.random.default_rng(32)
    v, on = rng.integers(0, 256, (h, w)).astype(float), np.zeros((h, w), bool)
    on[20:43, 10:22] = on[88:, 67:] = True
    rows = [(7, x, y, *[float(v[y, x])] * 3, int(on[y, x])) for y in range(h) for x in range(w) if (x, y) != (60, 5)]
    df = spark.createDataFrame(rows, "doc long, x long, y long, v0 double, v1 double, v2 double, open int")
    held, checkpoint = [], H.cut
    monkeypatch.setattr(H, "cut", lambda d: [r := checkpoint(d), held.append(r.count()) if "moved" in r.columns else None][0])
    monkeypatch.setattr(H, "SETTLED", 1e-6)
    out = H.membrane(df, ("doc",), 8)
    assert "MapInArrow" not in plan(out)
    # Tiles of 8 pixels get pieces of at most 25: of the 108, 8 are open in one hole and 1 in the other.
    assert held and max(held) <= 25 * 10
    got = {(r.x, r.y): r for r in out.collect()}
    assert len(got) == w * h and tuple(got[60, 5])[3:] == (0.0, 0.0, 0.0, 0)
    place = {p: k for k, p in enumerate(zip(*np.nonzero(on)))}
    a, b = np.zeros((len(place),) * 2), np.zeros(len(place))
    for (y, x), k in place.items():
        for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= j < h and 0 <= i < w:
                a[k, k] += 1
                if on[j, i]:
                    a[k, place[j, i]] -= 1
                else:
                    b[k] += v[j, i]
    want = np.linalg.solve(a, b)
    assert all(abs(got[x, y].v0 - want[k]) < 1e-2 and got[x, y].open == 1 for (y, x), k in place.items())
    assert all(got[x, y].v1 == v[y, x] for y in range(h) for x in range(w) if not on[y, x] and (x, y) != (60, 5))


def test_regions_join_in_few_rounds(spark, monkeypatch):
    """A U, whose least label once climbed its second leg a pixel a round, and regions over many cells against a walk (F1, F2)."""
    from pixelloom.operators import regions as R

    rng, cut, held = np.random.default_rng(1), R.cut, []
    on = rng.random((37, 29)) < 0.62
    u = np.zeros((20, 3), bool)
    u[:, 0] = u[1:, 2] = u[19, 1] = True

    def counted(df):
        held.append(1)
        assert len(held) <= 16
        return cut(df)

    monkeypatch.setattr(R, "cut", counted)
    monkeypatch.setattr(R, "SIDE", 2, raising=False)
    monkeypatch.setattr(R, "GROWTH", 2, raising=False)
    for mask in (u, on):
        held.clear()
        px = spark.createDataFrame([(x, y) for y, x in np.argwhere(mask).tolist()], "x long, y long")
        got = {(r.x, r.y): r.region for r in R.regions(px, F.lit(True), ()).collect()}
        want = {}
        for y, x in np.argwhere(mask).tolist():
            todo, least = [(x, y)] if (x, y) not in want else [], (y << 31) + x
            while todo:
                i, j = todo.pop()
                if (i, j) not in want and 0 <= i < mask.shape[1] and 0 <= j < mask.shape[0] and mask[j, i]:
                    want[i, j] = least
                    todo += [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
        assert got == want


def test_views_turn_and_zoom_as_the_sql_does(spark, tmp_path):
    """Angles whose cosine or sine Java rounds otherwise than the C library, and points whose zoomed centre hangs on the order of divisions."""
    import duckdb

    import __spark_entry__ as E

    turned = [(1818380, 250, 159), (5250572, 131, 142)]
    zoomed = [(3168, 7, 33), (1544, 20, 27), (3252, 113, 240), (2405, 136, 31)]
    rows = ", ".join(f"({n}, {g * pow(37, -1, 256) % 256}, {r}.5::double)" for n, g, r in turned + zoomed)
    con = duckdb.connect()
    con.sql(f"copy (select n::bigint as event_id, u::bigint as user_id, v as value, 'view' as event_type, timestamp '2024-01-01' as ts from (values {rows}) t(n, u, v)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = E.queries()["scalar_views"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({E.oracle_sql()['scalar_views']})").fetchall())


def test_views_stop_at_the_limits_of_zoom(spark):
    """Beyond the limits the point under the pointer stays too; a view without an angle has none of the results."""
    from pixelloom.functions import geometry as V

    for factor, zoom in ((1e6, V.MAX_ZOOM), (1e-6, V.MIN_ZOOM), (1.5, 3.0)):
        v = V.view(2.0, 10.0, 20.0, 0.7, 640, 480)
        near = V.zoom_at(v, factor, 100, 50)
        a, b, z = spark.range(1).select(F.struct(*V.at_screen(v, 100, 50)), F.struct(*V.at_screen(near, 100, 50)), near["zoom"]).first()
        assert z == zoom and np.allclose(a, b, atol=1e-6)
    assert tuple(spark.range(1).select(*V.at_screen(V.view(2.0, 10.0, 20.0, F.lit(None), 640, 480), 100, 50)).first()) == (None, None)
