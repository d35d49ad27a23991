import hashlib
import os
import zlib

import numpy as np
import pytest

from codequery.llm import jpeg
from codequery.llm import op9_media_columns as op9


def payloads():
    rng = np.random.default_rng(0)
    yield from (b"\0" * 64, op9.padded(b"hello world"), b"\xff" * 6400, b"\x80" * 640)
    yield rng.integers(0, 256, 64 * 50, dtype=np.uint8).tobytes()
    yield (rng.integers(0, 256, 64 * 333) * (rng.random(64 * 333) < 0.03)).astype(np.uint8).tobytes()
    yield rng.integers(-2, 3, 6400).astype(np.int8).tobytes()


def test_coefficients_come_back():
    given = list(payloads())
    files = jpeg.encode(given)
    pictures = [jpeg.parse(f) for f in files]
    for p, picture, c in zip(given, pictures, jpeg.coefficients(pictures), strict=True):
        assert c.astype(np.int8).tobytes()[: len(p)] == p and int(picture.comment) == len(p) // 64
    assert files == [jpeg.encode([p])[0] for p in given]


def test_pixels_are_the_same_in_any_batch():
    pictures = [jpeg.parse(f) for f in jpeg.encode(list(payloads()))]
    coefs = jpeg.coefficients(pictures)
    for p, c, tensor in zip(pictures, coefs, jpeg.rgb_all(pictures, coefs), strict=True):
        assert (jpeg.rgb(p, c) == tensor).all() and tensor.shape == (p.height, p.width, 3)


def test_another_decoder_agrees(spark, tmp_path):
    """The JVM's own decoder sees the same picture; its chroma is smoothed, so luma is compared."""
    rng = np.random.default_rng(2)
    blocks = np.zeros((24, 64), np.int8)
    blocks[:, 0] = rng.integers(-100, 100, 24)
    blocks[:16, 1:8] = rng.integers(-60, 60, (16, 7))
    blocks[16:] = 0
    file = jpeg.encode([blocks.tobytes()])[0]
    path = os.path.join(tmp_path, "x.jpg")
    with open(path, "wb") as f:
        f.write(file)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(path))
    picture = jpeg.parse(file)
    own = jpeg.rgb(picture, jpeg.coefficients([picture])[0]).astype(int)
    assert (image.getHeight(), image.getWidth()) == own.shape[:2]
    other = np.array([[(image.getRGB(x, y) >> 8) & 255 for x in range(own.shape[1])] for y in range(own.shape[0])])
    assert np.abs(other - own[..., 1]).max() <= 2 and np.ptp(other) > 50


def interleaved_file():
    """A one-MCU greyscale-free file with an interleaved DC scan, written bit by bit."""
    bits = ""
    for component, n in ((1, 4), (2, 1), (3, 1)):
        for _ in range(n):
            size = 3
            bits += f"{int(jpeg.DC_CODE.code[size]):04b}" + f"{4 + component:03b}"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = jpeg.struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0]))
    return b"\xff\xd8" + jpeg._SETUP + jpeg._segment(0xC2, frame) + scan + data + b"\xff\xd9"


def test_interleaved_scan():
    picture = jpeg.parse(interleaved_file())
    (c,) = jpeg.coefficients([picture])
    assert c[:, 0].tolist() == [5, 10, 15, 20, 6, 7] and not c[:, 1:].any()


def test_query_on_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(80_001, None), (80_002, ""), (None, "é" * 31 + "xx"), (80_004, "z" * 300_000), (80_004, "z" * 300_000)]
    got = op9.digest(op9.archive(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for doc_id, text in rows:
        data = (text or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        r = by[doc_id, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_decode_column(spark):
    rows = [(1, jpeg.encode([b"abc".ljust(64, b"\0")])[0]), (2, None), (3, b"no"), (4, jpeg.encode([b"q" * 640])[0][:300])]
    got = {r.id: r for r in op9.decode(spark.createDataFrame(rows, "id long, f binary"), "id", "f").collect()}
    assert len(got[1].rgb) == got[1].height * got[1].width * 3
    assert got[2].rgb is None and got[3].rgb is None and got[4].rgb is None


def test_broken_data_is_an_error():
    file = jpeg.encode([bytes(range(64)) * 20])[0]
    at = file.rindex(b"\xff\xda")
    with pytest.raises(ValueError):
        jpeg.coefficients([jpeg.parse(file[: at + 10] + b"\xff\xd9")])


def test_broken_files_give_null_tensors(spark):
    whole = jpeg.encode([op9.padded(b"some text")])[0]
    at = whole.index(b"\xff\xc2")
    four = bytearray(whole)
    four[at + 9] = 4  # number of components
    large = bytearray(whole)
    large[at + 5 : at + 9] = b"\xff" * 4  # height and width
    rows = [(1, whole), (2, whole[: at + 4] + whole[at + 40 :]), (3, b"\xff\xd8\xff\xc2\x00\x03\x08"), (4, b"\xff\xd8\xff\xdd\x00\x02"), (5, bytes(four)), (6, bytes(large)), (7, None), (8, b""), (None, whole)]
    got = op9.decode(spark.createDataFrame(rows, "k long, f binary"), "k", "f").collect()
    assert [(r.id, r.rgb is not None) for r in got] == [(1, True), *((k, False) for k in range(2, 9)), (None, True)]


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2, "b"), (1, "a", 2, "b"), (None, None, 3, "c")], "doc_id long, text string, media long, n_bytes string")
    rows = op9.digest(op9.archive(df)).collect()
    assert [(r.doc_id, r.n_bytes) for r in rows] == [(1, 1), (1, 1), (None, 0)] and rows[0].media_sha256 == rows[1].media_sha256
    assert op9.digest(op9.archive(df.limit(0))).collect() == []
