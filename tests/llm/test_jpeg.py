import numpy as np

from lodestone.llm import jpeg as J


def means(pixels):
    h, w = pixels.shape
    full = np.pad(pixels, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float)
    return full.reshape(full.shape[0] // 8, 8, -1, 8).mean((1, 3))


def test_thumbnails_are_block_means():
    r = np.random.default_rng(0)
    for shape, step, restart in (((8, 8), 4, 0), ((37, 50), 6, 3), ((120, 64), 2, 1), ((1, 1), 8, 0), ((256, 256), 16, 0)):
        pixels = r.integers(0, 256, shape).astype(np.uint8)
        w, h, parts, thumb = J.luminance_dc(J.encode(pixels, step, restart))
        assert (h, w, parts) == (*shape, 1) and np.abs(thumb - means(pixels)).max() <= step / 16 + 0.51


def colour(lum, chroma, sampling=(2, 2)):
    """A three-part file whose blocks are flat: lum per luminance block in scan order, chroma per unit."""
    dc, ac = J._codes(J.DC_COUNTS + J.DC_SYMBOLS).codes, J._codes(J.AC_COUNTS + J.AC_SYMBOLS).codes
    bits, last = "", [0, 0, 0]

    def block(i, value):
        nonlocal bits
        d = value - last[i]
        last[i] = value
        size = abs(d).bit_length()
        bits += format(dc[size][0], f"0{dc[size][1]}b") + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "") + format(ac[0][0], f"0{ac[0][1]}b")

    per = sampling[0] * sampling[1]
    for u in range(len(chroma)):
        for v in lum[u * per : (u + 1) * per]:
            block(0, v)
        block(1, chroma[u])
        block(2, -chroma[u])
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    h, w = 8 * sampling[1], 8 * sampling[0] * len(chroma)
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8]) * 64 + b"\xff\xc0\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03\x01" + bytes([sampling[0] << 4 | sampling[1]]) + b"\x00\x02\x11\x00\x03\x11\x00"
    head += b"\xff\xc4" + (19 + 12).to_bytes(2, "big") + b"\x00" + J.DC_COUNTS + J.DC_SYMBOLS + b"\xff\xc4" + (19 + 162).to_bytes(2, "big") + b"\x10" + J.AC_COUNTS + J.AC_SYMBOLS
    return head + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00" + raw + b"\xff\xd9"


def test_subsampled_colour():
    w, h, parts, thumb = J.luminance_dc(colour([1, 2, 3, 4, 5, 6, 7, 8], [9, -9]))
    assert (w, h, parts) == (32, 16, 3) and (thumb.astype(int) - 128).tolist() == [[1, 2, 5, 6], [3, 4, 7, 8]]


def test_resize_and_hash():
    x = np.arange(64).reshape(8, 8).astype(np.uint8)
    assert np.allclose(J.resize(x, 2, 4), x.reshape(2, 4, 4, 2).mean((1, 3)))
    assert J.difference_hash(x) == J.difference_hash(x + 20) != J.difference_hash(x[:, ::-1])


def test_edges(spark):
    good = J.encode(np.full((16, 16), 200, np.uint8))
    rows = [(1, good, 1), (1, good, 1), (None, None, 1), (2, b"", 1), (3, good[:-6], 1), (4, b"GIF89a", 1), (5, good.replace(b"\xff\xc0", b"\xff\xc2"), 1)]
    out = J.media_columns(spark.createDataFrame([(i, None if c is None else bytearray(c), w) for i, c, w in rows], "media_id long, content binary, width int")).collect()
    assert [(r.media_id, r.width, r.thumb_width) for r in out] == [(1, 16, 2), (1, 16, 2), (None, None, None), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]
    assert [r.error is None for r in out] == [True] * 3 + [False] * 4
    for cut in range(len(good)):  # whatever is cut off, the file is named broken or read, never an exception
        J.describe(good[:cut])
    assert J.media_columns(spark.createDataFrame([], "media_id long, content binary")).count() == 0


def test_media_of_vectors_round_trip(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = J.media_columns(J.media_of_vectors(rows)).toPandas()
    assert out["error"].isna().all() and (out["width"] == 64).all() and (out["thumb_width"] == 8).all()
