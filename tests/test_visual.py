import struct
import zlib

import numpy as np
import pytest

from pagetwin.config import build_config
from pagetwin.operators.visual import changed_share, decode_png, visual_diffs


def png(px, filters=(0,), colour=6):
    h, w, k = px.shape
    rows, above = b"", np.zeros(w * k, int)
    for y in range(h):
        row = px[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(k, int), row[:-k]])
        corner = np.concatenate([np.zeros(k, int), above[:-k]])
        f = filters[y % len(filters)]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, near][f]
        rows += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_png_filters():
    px = np.random.default_rng(1).integers(0, 256, (10, 7, 4), dtype=np.uint8)
    assert (decode_png(png(px, (0, 1, 2, 3, 4))) == px).all()
    assert (decode_png(png(px[..., :3], (4, 3), 2))[..., :3] == px[..., :3]).all()
    with pytest.raises(ValueError):
        decode_png(b"no")


def test_shares():
    white = np.full((20, 10, 4), 255, np.uint8)
    black = white.copy()
    black[:10, :, :3] = 0
    assert changed_share(white, white, 0.1) == 0 and changed_share(white, black, 0.1) == 50
    assert changed_share(white, black[:10], 0.1) == 50 and changed_share(white, white - np.array([2, 2, 2, 0], np.uint8), 0.1) == 0
    edge = black.copy()
    edge[9, :, :3] = 128  # a smoothed edge
    assert changed_share(black, edge, 0.1) < 5


def test_visual_diffs(spark):
    white = np.full((40, 20, 4), 255, np.uint8)
    part, all_ = white.copy(), white.copy()
    part[:1, :, :3], all_[:20, :, :3] = 0, 0
    pairs = spark.createDataFrame([(p, p, p, "compared", k) for k, p in enumerate(["/same", "/part", "/all", "/fail", "/late"])], "path string, key_a string, key_b string, kind string, ord int")
    shots = [(s, p, png(a if s == "A" else b), 100 if s == "A" else h, e if s == "B" else None) for p, a, b, h, e in [("/same", white, white, 120, None), ("/part", white, part, 100, None), ("/all", white, all_, 200, None), ("/fail", white, white, 100, "Timed out"), ("/late", white, all_, 100, None)] for s in "AB"]
    got = visual_diffs(pairs, spark.createDataFrame(shots, "site string, key string, png binary, full_height int, error string"), build_config({"visual": {"maxPages": 4}})).collect()
    assert sorted((r["path"], r["sig"], r["title"]) for r in got) == [
        ("/all", "structural", "Looks different: 50.0% of pixels changed"),
        ("/all", "structural", "Page height differs"),
        ("/fail", "cosmetic", "Visual comparison not possible"),
        ("/part", "cosmetic", "Looks different: 2.5% of pixels changed"),
    ]
