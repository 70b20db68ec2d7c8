"""Screenshots of matched pages compared pixel by pixel. The images are taken elsewhere and read as binary files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetwin.operators import diffs as d
from pagetwin.session import prepare

#: Squared colour distance (YIQ, Kotsarenko and Ramos, 2010) of the most unlike colours.
MOST = 35215.0
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the PNG files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "content")


def decode_png(data: bytes) -> np.ndarray:
    """RGBA pixels (height, width, 4) of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, alpha = 8, b"", None, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or interlaced or colour not in _CHANNELS:
                raise ValueError("only 8-bit PNG files without interlacing are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    k = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * k)
    rows, above = np.empty((height, width * k), np.uint8), np.zeros(width * k, np.uint8)
    for y in range(height):
        above = rows[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, k)
    px = rows.reshape(height, width, k)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        return table[px[..., 0]]
    out[..., :3] = px[..., :3] if k >= 3 else px[..., :1]
    if k in (2, 4):
        out[..., 3] = px[..., -1]
    return out


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, k: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, k), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out, up, src = [0] * len(row), above.tolist(), row.tolist()
    for i, x in enumerate(src):
        a = out[i - k] if i >= k else 0
        if kind == 3:
            guess = (a + up[i]) // 2
        else:
            c = up[i - k] if i >= k else 0
            p = a + up[i] - c
            guess = min(((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c)))[2]
        out[i] = x + guess & 255
    return np.array(out, np.uint8)


def padded(px: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.full((height, width, 4), 255, np.uint8)
    out[: px.shape[0], : px.shape[1]] = px[:height, :width]
    return out


def _yiq(px: np.ndarray) -> np.ndarray:
    """Pixels blended with white, as brightness and two colour axes."""
    rgb = 255 + (px[..., :3].astype(np.float64) - 255) * (px[..., 3:] / 255)
    return rgb @ np.array([[0.29889531, 0.59597799, 0.21147017], [0.58662247, -0.2741761, -0.52261711], [0.11448223, -0.32180189, 0.31114694]])


def _many_siblings(px: np.ndarray, y: int, x: int) -> bool:
    """Three or more neighbours of the same colour; a place at the border counts as having one more."""
    h, w = px.shape[:2]
    near = px[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
    same = int((near == px[y, x]).all(-1).sum()) - 1
    return same + (y in (0, h - 1) or x in (0, w - 1)) > 2


def _smoothed(px: np.ndarray, light: np.ndarray, other: np.ndarray, y: int, x: int) -> bool:
    """Whether a pixel looks like the smoothed edge of a shape (Vysniauskas, 2009): between a darker and a brighter flat neighbour."""
    h, w = light.shape
    around = [(j, i) for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if (j, i) != (y, x)]
    delta = [light[j, i] - light[y, x] for j, i in around]
    if sum(abs(v) < 1e-9 for v in delta) + (y in (0, h - 1) or x in (0, w - 1)) > 2 or not min(delta) < 0 < max(delta):
        return False
    ends = (around[int(np.argmin(delta))], around[int(np.argmax(delta))])
    return any(_many_siblings(px, *e) and _many_siblings(other, *e) for e in ends)


def changed_share(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Percentage of pixels that differ visibly, smoothed edges not counted; the smaller image is padded with white."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    a, b = padded(a, h, w), padded(b, h, w)
    ya, yb = _yiq(a), _yiq(b)
    far = ((ya - yb) ** 2 @ np.array([0.5053, 0.299, 0.1957])) > MOST * threshold**2
    n = sum(not (_smoothed(a, ya[..., 0], b, y, x) or _smoothed(b, yb[..., 0], a, y, x)) for y, x in np.argwhere(far))
    return 100.0 * n / (h * w) if h * w else 0.0


def first_compared(pairs: DataFrame, most: int) -> DataFrame:
    """The first compared pairs in pairing order: each task hands on its own first ones only."""
    return pairs.where("kind = 'compared'").orderBy("ord").limit(most)


def visual_diffs(pairs: DataFrame, shots: DataFrame, cfg: dict) -> DataFrame:
    """Differences of category `visual` for the first compared pairs in pairing order. shots: (site, key, png, full_height, error)."""
    prepare(pairs.sparkSession)
    v = cfg["visual"]
    first = first_compared(pairs, v["maxPages"]).select("path", "key_a", "key_b")
    side = lambda s: shots.where(F.col("site") == s).select(F.col("key").alias(f"key_{s.lower()}"), *(F.col(c).alias(f"{c}_{s.lower()}") for c in ("png", "full_height", "error")))

    @F.arrow_udf("struct<pct:double,problem:string>")
    def compare(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(xs, ys):
            try:
                a, b = (decode_png(z.as_py() or b"")[: v["maxHeight"]] for z in (x, y))
                rows.append({"pct": changed_share(a, b, v["pixelThreshold"]), "problem": None})
            except (ValueError, zlib.error, struct.error) as e:
                rows.append({"pct": None, "problem": str(e)})
        return pa.array(rows, pa.struct([("pct", pa.float64()), ("problem", pa.string())]))

    both = first.join(side("A"), "key_a").join(side("B"), "key_b").withColumn("r", compare("png_a", "png_b"))
    ok = F.col("error_a").isNull() & F.col("error_b").isNull() & F.col("r.problem").isNull()
    said = lambda s: F.array(F.coalesce(f"error_{s}", F.lit("OK")))
    failed = d.made(both.where(~ok), "visual", F.lit("cosmetic"), F.lit("Visual comparison not possible"), said("a"), F.when(F.col("error_b").isNull() & F.col("error_a").isNull(), F.array("r.problem")).otherwise(said("b")), note=F.lit("A screenshot could not be taken; the content comparison above still applies."))
    gap, tall = F.abs(F.col("full_height_a") - F.col("full_height_b")), F.greatest("full_height_a", "full_height_b")
    px = lambda s: F.array(F.concat(F.col(f"full_height_{s}").cast("string"), F.lit("px tall")))
    height = d.made(both.where(ok & (gap > 50)), "visual", F.when(gap / tall > 0.15, F.lit("structural")).otherwise(F.lit("cosmetic")), F.lit("Page height differs"), px("a"), px("b"))
    pct = F.col("r.pct")
    looks = d.made(both.where(ok & (pct >= v["ignoreBelowPct"])), "visual", F.when(pct < v["cosmeticBelowPct"], F.lit("cosmetic")).otherwise(F.lit("structural")), F.format_string("Looks different: %.1f%% of pixels changed", pct), d.as_list(None), d.as_list(None), place=1)
    return failed.unionByName(height).unionByName(looks)
