"""Layered documents as files: read into layers, pixels and masks, and written from them.

Files are read as bytes by Spark, from wherever it reads. One task a file walks
the header and the layer records, and hands on each channel's bytes; layers
are then decoded apart, in as many tasks as there are. Damaged files, and kinds
that are not read (other than 8 or 16 bits a channel, colour or grey), give a
row with an error in ``documents`` and nothing else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pixelloom.operators.compositing import TILE, with_defaults
from pixelloom.operators.tiles import BOUNDS, RGBA

# The format's signatures and keys.
SIGNATURE, BLOCK = b"8BPS", b"8BIM"
MODES = {
    "normal": b"norm", "dissolve": b"diss", "darken": b"dark", "multiply": b"mul ", "colorBurn": b"idiv", "linearBurn": b"lbrn", "lighten": b"lite", "screen": b"scrn", "colorDodge": b"div ", "linearDodge": b"lddg",
    "overlay": b"over", "softLight": b"sLit", "hardLight": b"hLit", "vividLight": b"vLit", "linearLight": b"lLit", "pinLight": b"pLit", "hardMix": b"hMix", "difference": b"diff", "exclusion": b"smud",
    "subtract": b"fsub", "divide": b"fdiv", "hue": b"hue ", "saturation": b"sat ", "color": b"colr", "luminosity": b"lum ", "darkerColor": b"dkCl", "lighterColor": b"lgCl", "passThrough": b"pass",
}
RGB_MODE, GREY_MODE = 3, 1
MASK_CHANNEL, ALPHA_CHANNEL = -2, -1
OPEN_GROUP, CLOSED_GROUP, GROUP_END = 1, 2, 3
KNOCKOUTS = ("none", "shallow", "deep")
#: Layer data that makes an adjustment of a layer.
ADJUSTMENTS = set(b"levl curv nvrt thrs post brit hue2 blnc blwh phfl mixr expA vibA grdm selc clrL".split())

NAME_OF = {v: k for k, v in MODES.items()}
LAYER = "id long, parent long, z long, name string, kind string, visible boolean, opacity double, fill double, mode string, clipped boolean, as_group boolean, knockout string, masked boolean, density double, adjustment string, x0 long, y0 long, x1 long, y1 long"
CHANNEL = "layer long, channel int, x0 long, y0 long, x1 long, y1 long, other int, depth int, grey boolean, wide boolean, data binary"


class Reader:
    """A place in the bytes of a file; reading past the end raises."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise ValueError(f"cut off at byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, form: str):
        got = struct.unpack(f">{form}", self.take(struct.calcsize(f">{form}")))
        return got if len(got) > 1 else got[0]

    def part(self, n: int) -> Reader:
        self.take(n)
        return Reader(self.data, self.at - n, self.at)


def _blocks(r: Reader) -> dict[bytes, bytes]:
    """The keyed blocks at the end of a layer's record."""
    out = {}
    while r.at + 12 <= r.end:
        _, key, size = r.get("4s4sI")
        out[key] = r.take(size)
        r.take(min(size % 2, r.end - r.at))
    return out


def _record(r: Reader, wide: bool) -> dict:
    """One layer's record."""
    y0, x0, y1, x1, n = r.get("iiiiH")
    channels = [r.get("hQ" if wide else "hI") for _ in range(n)]
    _, mode, opacity, clipping, flags, _, size = r.get("4s4sBBBBI")
    extra = r.part(size)
    mask = extra.part(extra.get("I"))
    box, density = None, 1.0
    if mask.end - mask.at >= 18:
        top, left, low, right, other, mask_flags = mask.get("iiiiBB")
        box = (left, top, right, low, other, not mask_flags & 2)
        if mask_flags & 16 and mask.at < mask.end and mask.get("B") & 1:
            density = mask.get("B") / 255
    extra.take(extra.get("I"))
    size = extra.get("B")
    name = extra.take(size).decode("latin-1")
    extra.take((-size - 1) % 4)
    more = _blocks(extra)
    if b"luni" in more:
        name = more[b"luni"][4:].decode("utf-16-be", "replace").rstrip("\0")
    section = struct.unpack(">I", more[b"lsct"][:4])[0] if b"lsct" in more else 0
    if section and len(more[b"lsct"]) >= 12:
        mode = more[b"lsct"][8:12]
    byte = lambda key, other: more[key][0] if key in more else other
    return {"box": (x0, y0, x1, y1), "channels": channels, "mode": NAME_OF.get(mode, "normal"), "opacity": opacity / 255, "clipped": clipping == 1, "visible": not flags & 2, "mask": box, "density": density, "name": name, "section": section, "fill": byte(b"iOpa", 255) / 255, "knockout": KNOCKOUTS[min(2, byte(b"knko", 0))], "as_group": byte(b"clbl", 1) != 0, "adjustment": next((k.decode() for k in sorted(ADJUSTMENTS & more.keys())), None)}


def walk(data: bytes) -> tuple[dict, list[dict], list[tuple]]:
    """A file's head, its layers as rows of LAYER, and its channels as rows of CHANNEL."""
    r = Reader(data)
    if r.take(4) != SIGNATURE:
        raise ValueError("not a layered document")
    version, _, n, height, width, depth, mode = r.get("H6sHIIHH")
    if version not in (1, 2) or depth not in (8, 16) or mode not in (RGB_MODE, GREY_MODE):
        raise ValueError(f"version {version}, {depth} bits, colour mode {mode}")
    wide = version == 2
    long_ = "Q" if wide else "I"
    for _ in range(2):
        r.take(r.get("I"))
    section = r.part(r.get(long_))
    layers, channels, records = [], [], []
    if section.at < section.end and (size := section.get(long_)):
        info = section.part(size)
        records = [_record(info, wide) for _ in range(abs(info.get("h")))]

    numbers: dict[int, int] = {}
    groups: list[int] = []
    for k in range(len(records) - 1, -1, -1):  # from above, where a group's record comes before what it holds
        section_ = records[k]["section"]
        if section_ == GROUP_END:
            groups.pop() if groups else None
            continue
        numbers[k] = groups[-1] if groups else -1
        if section_ in (OPEN_GROUP, CLOSED_GROUP):
            groups.append(k)
    places: dict[int, int] = {}
    for k, x in enumerate(records):
        for channel, size in x["channels"]:
            box = x["mask"][:4] if channel == MASK_CHANNEL and x["mask"] else x["box"]
            bytes_ = info.take(size)
            if x["section"] != GROUP_END and channel >= MASK_CHANNEL:
                channels.append((k, channel, *box, x["mask"][4] if channel == MASK_CHANNEL and x["mask"] else 0, depth, mode == GREY_MODE, wide, bytes_))
        if k in numbers:
            parent = numbers[k]
            z = places.get(parent, 0)
            places[parent] = z + 1
            kind = "group" if x["section"] else "adjustment" if x["adjustment"] else "pixel"
            layers.append({"id": k, "parent": None if parent < 0 else parent, "z": z, "kind": kind, "masked": bool(x["mask"] and x["mask"][5])} | {c: x[c] for c in ("name", "visible", "opacity", "fill", "mode", "clipped", "as_group", "knockout", "density", "adjustment")} | dict(zip(("x0", "y0", "x1", "y1"), x["box"])))
    return {"width": width, "height": height, "depth": depth}, layers, channels


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc: path, content) of the files under a path or pattern."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")


def parsed(found: DataFrame) -> DataFrame:
    """A row per file: doc, width, height, depth, error (null: none), layers and channels as arrays."""
    kind = f"doc string, width int, height int, depth int, error string, layers array<struct<{LAYER.replace(' ', ':').replace(',:', ',')}>>, channels array<struct<{CHANNEL.replace(' ', ':').replace(',:', ',')}>>"
    names = [c.split()[0] for c in CHANNEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    head, layers, channels = walk(data)
                    row = {"doc": doc, "error": None, "layers": layers, "channels": [dict(zip(names, c)) for c in channels]} | head
                except (ValueError, struct.error, IndexError) as e:
                    row = {"doc": doc, "error": str(e), "layers": [], "channels": [], "width": None, "height": None, "depth": None}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kind))
    return found.select("doc", "content").mapInArrow(run, kind)


def documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "width", "height", "depth", "error")


def layers(rows: DataFrame) -> DataFrame:
    """As ``compositing`` takes them, with names and boxes; of adjustments, inversions are read, others change nothing."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: 255 - v)
    return rows.select("doc", F.explode("layers").alias("l")).select("doc", "l.*", F.when(F.col("l.adjustment") == "nvrt", F.array(levels, levels, levels)).alias("tables"))


def unpacked(data: bytes, width: int, height: int, depth: int, wide: bool) -> np.ndarray:
    """A channel of 8 bits: raw, run lengths by rows, or compressed."""
    r, size = Reader(data), depth // 8
    kind = r.get("H")
    if kind == 1:
        counts = struct.unpack(f">{height}{'I' if wide else 'H'}", r.take(height * (4 if wide else 2)))
        raw = b"".join(_runs(r.take(n), width * size) for n in counts)
    else:
        raw = r.data[r.at :]
        raw = zlib.decompress(raw) if kind > 1 else raw
    v = np.frombuffer(raw[: width * height * size], ">u2" if size == 2 else "u1").reshape(height, width)
    if kind == 3:  # differences along rows
        v = np.cumsum(v, axis=1, dtype=np.uint16 if size == 2 else np.uint8)
    return np.floor(v / 257 + 0.5).astype(np.uint8) if size == 2 else v


def _runs(row: bytes, size: int) -> bytes:
    """Run lengths: a count and what it copies, or 1 less the count and the byte it repeats."""
    out, at = bytearray(), 0
    while at < len(row) and len(out) < size:
        n = row[at]
        if n < 128:
            out += row[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += row[at + 1 : at + 2] * (257 - n)
            at += 2
    if len(out) < size:
        raise ValueError("a row is cut off")
    return bytes(out[:size])


def packed_rows(v: np.ndarray) -> list[bytes]:
    """The run lengths of each row of a plane: runs of three or more are repeated, the rest copied."""
    h, w = v.shape
    flat, held = v.ravel(), v.tobytes()
    begins = np.ones(h * w, bool)
    begins[1:] = flat[1:] != flat[:-1]
    begins[np.arange(h) * w if w else []] = True  # no run goes on into the next row
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=h * w)
    long_ = sizes >= 3
    runs = list(zip(starts[long_].tolist(), sizes[long_].tolist()))
    lines, k = [], 0

    def copied(out: bytearray, lo: int, hi: int) -> None:
        for a in range(lo, hi, 128):
            z = min(a + 128, hi)
            out.append(z - a - 1)
            out.extend(held[a:z])

    for at in range(0, h * w, w or 1):
        out, end = bytearray(), at + w
        while k < len(runs) and runs[k][0] < end:
            start, size = runs[k]
            copied(out, at, start)
            whole, rest = divmod(size, 128)
            out += bytes((129, held[start])) * whole
            if rest >= 3:
                out += bytes((257 - rest, held[start]))
            at = start + size - (rest if rest < 3 else 0)
            k += 1
        copied(out, at, end)
        lines.append(bytes(out))
    return lines or [b""] * h


def packed_row(row: bytes) -> bytes:
    """The run lengths of a row."""
    return packed_rows(np.frombuffer(row, np.uint8)[None])[0]


def _by_layer(rows: DataFrame, kept: str) -> DataFrame:
    """(doc, layer, channels): the packed channels of a layer that are wanted as one row, dealt by layer."""
    dealt = rows.select("doc", F.explode("channels").alias("c")).select("doc", "c.*").where("x1 > x0 and y1 > y0").where(kept)
    return dealt.groupBy("doc", "layer").agg(F.collect_list(F.struct("channel", "x0", "y0", "x1", "y1", "depth", "grey", "wide", "data")).alias("channels"))


def _decoded(channels: list[dict]) -> dict[int, np.ndarray]:
    """The channels of a layer that can be decoded; of one that comes twice the greater values."""
    out: dict[int, np.ndarray] = {}
    for c in channels:
        try:
            v = unpacked(c["data"], c["x1"] - c["x0"], c["y1"] - c["y0"], c["depth"], c["wide"])
        except (ValueError, struct.error, zlib.error):
            continue
        k = c["channel"]
        out[k] = np.maximum(out[k], v) if k in out else v
    return out


def _planes(channels: list[dict]) -> np.ndarray | None:
    """Colour and alpha of a layer, or its mask; without an alpha channel it is solid, grey is all three colours. Null if nothing can be decoded."""
    found = _decoded(channels)
    if not found:
        return None
    if MASK_CHANNEL in found:
        return found[MASK_CHANNEL][None]
    none = np.zeros_like(next(iter(found.values())))
    first = found.get(0, none)
    other = first if channels[0]["grey"] else none
    return np.stack([first, found.get(1, other), found.get(2, other), found.get(ALPHA_CHANNEL, none + np.uint8(255))])


#: Channels of a layer's colour and alpha, and of its mask.
COLOUR, MASK = f"channel >= {ALPHA_CHANNEL}", f"channel = {MASK_CHANNEL}"


def _each(rows: DataFrame, kept: str, make: Callable[[dict, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """Rows (doc, layer) beside the columns that ``make`` yields of each layer's box and planes; a batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                v = _planes(row["channels"])
                for made in () if v is None else make(row["channels"][0], v):
                    n = len(next(iter(made.values())))
                    yield pa.RecordBatch.from_pydict({"doc": pa.array([row["doc"]] * n), "layer": pa.array([row["layer"]] * n, pa.int64())} | made)

    return _by_layer(rows, kept).mapInArrow(run, f"doc string, layer long, {schema}")


def _spread(rows: DataFrame, kept: str, names: tuple) -> DataFrame:
    """(doc, layer, x, y, names): a row for each pixel of the box."""

    def make(box: dict, v: np.ndarray) -> Iterator[dict]:
        _, h, w = v.shape
        step = max(1, (1 << 16) // w)
        for lo in range(0, h, step):
            part = v[:, lo : lo + step]
            n = part.shape[1]
            yield {"x": np.tile(np.arange(w), n) + box["x0"], "y": np.repeat(np.arange(n) + lo, w) + box["y0"]} | {c: p.ravel().astype(np.int64) for c, p in zip(names, part)}

    return _each(rows, kept, make, ", ".join(f"{c} long" for c in ("x", "y", *names)))


def pixels(rows: DataFrame) -> DataFrame:
    """(doc, layer, x, y, r, g, b, a) of the layers' own boxes; without an alpha channel they are solid. Grey is all three colours."""
    return _spread(rows, COLOUR, RGBA)


def masks(rows: DataFrame) -> DataFrame:
    """(doc, layer, x, y, cov) of the masks' own boxes."""
    return _spread(rows, MASK, ("cov",))


def boxes(rows: DataFrame) -> DataFrame:
    """(doc, x0, y0, x1, y1): what the layers' pixels cover."""
    own = _each(rows, COLOUR, lambda box, v: iter([{c: [box[c]] for c in BOUNDS}]), ", ".join(f"{c} long" for c in BOUNDS))
    return own.groupBy("doc").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc, layer, tx, ty, data, mask) as ``compositing.folded`` takes them: channels become tiles where they are decoded, without a row for a pixel."""

    def make(box: dict, v: np.ndarray) -> Iterator[dict]:
        for ty in range(box["y0"] // tile, (box["y1"] - 1) // tile + 1):
            for tx in range(box["x0"] // tile, (box["x1"] - 1) // tile + 1):
                left, top = tx * tile - box["x0"], ty * tile - box["y0"]
                part = v[:, max(0, top) : top + tile, max(0, left) : left + tile]
                out = np.zeros((len(v), tile, tile), np.uint8)
                y, x = max(0, -top), max(0, -left)
                out[:, y : y + part.shape[1], x : x + part.shape[2]] = part
                yield {"tx": [tx], "ty": [ty], "data": [out.tobytes()]}

    made = [_each(rows, kept, make, "tx long, ty long, data binary").withColumn("mask", F.lit(kept == MASK)) for kept in (COLOUR, MASK)]
    return made[0].union(made[1])


# Writing.


def _channel_bytes(px: DataFrame, channels: dict[str, int]) -> DataFrame:
    """(doc, layer, channel, x0, y0, x1, y1, data): channels over each layer's box, packed; one task holds a layer's pixels."""
    rows = px.select("doc", "layer", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(F.col(c).cast("int").alias(c) for c in channels))

    def pack(t: pa.Table) -> pa.Table:
        x, y = (t.column(c).to_numpy() for c in "xy")
        box = {"x0": x.min(), "y0": y.min(), "x1": x.max() + 1, "y1": y.max() + 1}
        out = []
        for c in channels:
            v = np.zeros((box["y1"] - box["y0"], box["x1"] - box["x0"]), np.uint8)
            v[y - box["y0"], x - box["x0"]] = t.column(c).to_numpy()
            lines = packed_rows(v)
            out.append(struct.pack(">H", 1) + struct.pack(f">{len(lines)}H", *map(len, lines)) + b"".join(lines))
        n = len(out)
        same = {c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in ("doc", "layer")}
        return pa.table(same | {"channel": pa.array(channels.values(), pa.int32())} | {c: pa.array([v] * n, pa.int64()) for c, v in box.items()} | {"data": out})

    kind = dict(px.dtypes)
    return rows.groupBy("doc", "layer").applyInArrow(pack, f"doc {kind['doc']}, layer {kind['layer']}, channel int, x0 long, y0 long, x1 long, y1 long, data binary").withColumn("layer", F.col("layer").cast("long"))


def _written(row: dict) -> bytes:
    """The file of a document: layers from below, groups closed below and opened above what they hold."""
    by_layer: dict[int, list[dict]] = {}
    for c in row["channels"] or []:
        by_layer.setdefault(c["layer"], []).append(c)
    children: dict[int | None, list[dict]] = {}
    for x in sorted(row["layers"] or [], key=lambda x: x["z"]):
        children.setdefault(x["parent"], []).append(x)
    records, data = [], []

    def block(key: bytes, body: bytes) -> bytes:
        return BLOCK + key + struct.pack(">I", len(body) + len(body) % 2) + body + b"\0" * (len(body) % 2)

    def record(x: dict, section: int, name: str) -> None:
        own = sorted(by_layer.get(x["id"], []), key=lambda c: c["channel"]) if section != GROUP_END else []
        body = [c for c in own if c["channel"] != MASK_CHANNEL]
        mask = next((c for c in own if c["channel"] == MASK_CHANNEL), None)
        box = tuple(body[0][c] for c in ("y0", "x0", "y1", "x1")) if body else (0, 0, 0, 0)
        lists = [(c["channel"], c["data"]) for c in own] or [(k, struct.pack(">H", 0)) for k in (-1, 0, 1, 2)]
        mode = MODES["normal" if section == GROUP_END else x["mode"]]
        flags = (0 if x["visible"] else 2) | 8 | (16 if x["kind"] != "pixel" else 0)
        extra = struct.pack(">I", 0)
        if mask and x["masked"]:
            extra = struct.pack(">iiiiBB", mask["y0"], mask["x0"], mask["y1"], mask["x1"], 0, 16) + struct.pack(">BB", 1, int(x["density"] * 255 + 0.5))
            extra = struct.pack(">I", len(extra)) + extra
        short = name.encode("latin-1", "replace")[:255]
        extra += struct.pack(">I", 0) + bytes([len(short)]) + short + b"\0" * ((-len(short) - 1) % 4)
        extra += block(b"luni", struct.pack(">I", len(name.encode("utf-16-be")) // 2) + name.encode("utf-16-be"))
        extra += block(b"iOpa", bytes([int(x["fill"] * 255 + 0.5), 0, 0, 0])) + block(b"knko", bytes([KNOCKOUTS.index(x["knockout"]), 0, 0, 0])) + block(b"clbl", bytes([x["as_group"], 0, 0, 0]))
        if section:
            extra += block(b"lsct", struct.pack(">I", section) + BLOCK + mode)
        if x["kind"] == "adjustment":
            extra += block(b"nvrt", b"")
        keys = b"".join(struct.pack(">hI", k, len(d)) for k, d in lists)
        records.append(struct.pack(">iiiiH", *box, len(lists)) + keys + struct.pack(">4s4sBBBBI", BLOCK, MODES["normal"] if mode == MODES["passThrough"] else mode, int(x["opacity"] * 255 + 0.5), x["clipped"], flags, 0, len(extra)) + extra)
        data.extend(d for _, d in lists)

    def place(parent: int | None) -> None:
        for x in children.get(parent, []):
            if x["kind"] == "group":
                record(x | {"masked": False}, GROUP_END, "</Layer group>")
                place(x["id"])
                record(x, OPEN_GROUP, x["name"])
            else:
                record(x, 0, x["name"])

    place(None)
    info = struct.pack(">h", len(records)) + b"".join(records) + b"".join(data)
    info += b"\0" * (len(info) % 2)
    section = struct.pack(">I", len(info)) + info + struct.pack(">I", 0)
    merged = {c["channel"]: c["data"] for c in row["merged"] or []}
    parts = [merged.get(k, struct.pack(">H", 1) + struct.pack(f">{row['height']}H", *[0] * row["height"])) for k in (0, 1, 2, ALPHA_CHANNEL)]
    counts = b"".join(p[2 : 2 + 2 * row["height"]] for p in parts)
    rows = b"".join(p[2 + 2 * row["height"] :] for p in parts)
    head = SIGNATURE + struct.pack(">H6sHIIHH", 1, b"", 4, row["height"], row["width"], 8, RGB_MODE)
    return head + struct.pack(">II", 0, 0) + struct.pack(">I", len(section)) + section + struct.pack(">H", 1) + counts + rows


def written(layer_rows: DataFrame, px: DataFrame, merged: DataFrame, mask_rows: DataFrame | None = None) -> DataFrame:
    """(doc, content) of a file for each document of ``merged`` (doc, x, y, r, g, b, a: its flattened pixels, from 0).

    Channels are packed apart; a document's file is put together in one task,
    as it is one file. Adjustment layers are written as inversions, the only
    kind of table that is. Layers without a name are numbered.
    """
    named = layer_rows if "name" in layer_rows.columns else layer_rows.withColumn("name", F.concat(F.lit("Layer "), F.col("id").cast("string")))
    every = with_defaults(named).join(named.select("doc", "id", "name"), ["doc", "id"])
    trees = every.groupBy("doc").agg(F.collect_list(F.struct("id", "parent", "z", "kind", "name", "visible", "opacity", "fill", "mode", "clipped", "as_group", "knockout", "masked", "density")).alias("layers"))
    rgba = {"a": ALPHA_CHANNEL, "r": 0, "g": 1, "b": 2}
    packed = _channel_bytes(px, rgba)
    if mask_rows is not None:
        packed = packed.union(_channel_bytes(mask_rows, {"cov": MASK_CHANNEL}))
    packed = packed.groupBy("doc").agg(F.collect_list(F.struct("layer", "channel", "x0", "y0", "x1", "y1", "data")).alias("channels"))
    flat = _channel_bytes(merged.withColumn("layer", F.lit(0).cast("long")), rgba).groupBy("doc").agg(F.collect_list(F.struct("channel", "data")).alias("merged"), F.max("x1").cast("int").alias("width"), F.max("y1").cast("int").alias("height"))
    rows = flat.join(packed, "doc", "left").join(trees, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                yield pa.RecordBatch.from_arrays([b.column("doc")[k : k + 1], pa.array([_written(row)], pa.binary())], names=["doc", "content"])

    return rows.mapInArrow(run, f"doc {dict(merged.dtypes)['doc']}, content binary")


class FileSink(DataSource):
    """Writes rows (doc, content) as files <path>/<doc>.psd, wherever pyarrow can write."""

    @classmethod
    def name(cls) -> str:
        return "pixelloom_files"

    def schema(self) -> str:
        return "doc string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        where.create_dir(folder, recursive=True)
        for doc, content in rows:  # a rerun of the task writes the same files again
            with where.open_output_stream(f"{folder}/{doc}.psd") as f:
                f.write(bytes(content))
        return WriterCommitMessage()


def save(found: DataFrame, path: str) -> None:
    """Writes the files of ``written`` into a folder, named by their documents."""
    found.sparkSession.dataSource.register(FileSink)
    found.select(F.col("doc").cast("string").alias("doc"), "content").write.format("pixelloom_files").mode("append").save(path)
