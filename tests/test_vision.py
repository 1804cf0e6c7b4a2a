import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.pixels import decode_image
from skylattice.operators import evaluation, models
from skylattice.sources import config, images


def png(pixels, colour=2, depth=8, filters=(0, 1, 2, 3, 4), palette=None):
    """An image file of samples (height, width, channels), its lines filtered in turn."""
    height, width, channels = pixels.shape
    step = max(1, channels * depth // 8)
    lines, above = [], None
    for y, row in enumerate(pixels):
        raw = row.astype(">u2").tobytes() if depth == 16 else row.astype(np.uint8).tobytes() if depth == 8 else np.packbits(((row[:, 0, None] >> np.arange(depth - 1, -1, -1)) & 1).ravel()).tobytes()
        above, kind, out = above or bytes(len(raw)), filters[y % len(filters)], []
        for i, x in enumerate(raw):
            a, b, c = (raw[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        lines.append(bytes([kind, *out]))
        above = raw
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    plte = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + plte + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def bmp(pixels):
    height, width, _ = pixels.shape
    rows = b"".join(r[:, ::-1].tobytes() + bytes(-3 * width % 4) for r in pixels[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


RNG = np.random.default_rng(0)
RGB = RNG.integers(0, 256, (9, 7, 3)).astype(np.uint8)


def test_decoding():
    assert (decode_image(png(RGB)) == RGB).all() and (decode_image(bmp(RGB)) == RGB).all()
    assert (decode_image(png(np.dstack([RGB, RGB[..., :1]]), 6)) == RGB).all()
    assert (decode_image(png(RGB[..., :1], 0)) == RGB[..., :1]).all()
    assert (decode_image(png(RGB[..., :2], 4)) == RGB[..., :1]).all()
    assert (decode_image(png(RGB.astype(np.int64) * 257, 2, 16)) == RGB).all()
    palette, index = RNG.integers(0, 256, (4, 3)).astype(np.uint8), RNG.integers(0, 4, (5, 6, 1))
    assert (decode_image(png(index, 3, 2, (0,), palette)) == palette[index[..., 0]]).all()
    assert (decode_image(png(index // 2, 0, 1, (0,))) == index // 2 * 255).all()
    for bad in (None, b"", b"nothing", png(RGB)[:60], b"BM", png(RGB)[:-40]):
        assert decode_image(bad) is None


def mean_colour(stack):
    return stack.reshape(len(stack), 3, -1).mean(axis=2)


def test_folder_and_bytes_give_equal_vectors(spark, tmp_path):
    content = {f"{i}.png": png(RNG.integers(0, 256, (8 + i, 12, 3)).astype(np.uint8)) for i in range(6)} | {"bad.png": b"no image"}
    for name, x in content.items():
        (tmp_path / name).write_bytes(x)
    table = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(content.items())] + [(99, "null", None)], "id long, name string, image_bytes binary")
    got = {r.name: r.vec for r in models.image_vectors(table, "image_bytes", "id", lambda: mean_colour, size=16).collect()}
    folder = images.black_if_invalid(images.decode(spark, str(tmp_path)), 16).collect()
    assert len(folder) == 7 and len(got) == 8
    for r in folder:
        pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., ::-1]
        want = mean_colour(models.normalise_pixels(models.resize_crop(pixels, 16))[None])[0]
        assert got[r.origin.rsplit("/", 1)[1]] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert got["null"] == got["bad.png"]
    kept = models.image_vectors(table, "image_bytes", "id", lambda: mean_colour, size=16, invalid="drop")
    assert sorted(r.name for r in kept.collect()) == sorted(n for n in content if n != "bad.png") and kept.columns == ["id", "name", "vec"]


def test_crops_depend_on_the_row_alone(spark):
    table = spark.createDataFrame([(i, png(RGB), "x") for i in range(12)], "id long, image_bytes binary, vec string")
    run = lambda t, **o: {r.id: r.vec for r in models.image_vectors(t, "image_bytes", "id", None, models.train_transform(8), **o).collect()}
    first = run(table, batch_size=5)
    assert first == run(table.repartition(3), batch_size=1) and first != run(table, seed="1")
    assert len({tuple(x) for x in first.values()}) > 6 and len(first[0]) == 3 * 8 * 8
    assert run(table.limit(0)) == {}


def test_a_checkpoint_is_loaded_once_a_worker(spark):
    def read(path):
        return {"state_dict": {"w": random.random()}}

    model = config.LazyModel("one", read, lambda hyper, weights, strict: lambda stack: np.full((len(stack), 2), weights["w"] + 1))
    table = spark.createDataFrame([(i, png(RGB)) for i in range(40)], "id long, image_bytes binary").coalesce(1)
    vecs = models.image_vectors(table, "image_bytes", "id", model, size=8, batch_size=4, normalised=False)
    assert vecs.select("vec").distinct().count() == 1


def test_from_a_folder_to_the_page(spark, tmp_path):
    root = tmp_path / "bench"
    shades = {"a/red": (250, 0, 0), "a/blue": (0, 0, 250), "b/one": (9, 200, 9)}
    for folder, rgb in shades.items():
        (root / folder).mkdir(parents=True)
        for k in range(3):
            (root / folder / f"{k}.png").write_bytes(png(np.tile(np.array(rgb, np.uint8) + np.uint8(k), (6, 6, 1))))
    (root / "a/empty").mkdir()
    (root / "none/empty").mkdir(parents=True)
    (root / "a/red/bad.png").write_bytes(b"broken")
    report = evaluation.evaluate_to_html(spark, str(root), lambda: mean_colour, "m.ckpt", str(tmp_path / "out/report.html"), size=8, include_self=False)
    rows = {r.dataset: r for r in report.collect()}
    assert {k: (r.num_images, r.num_classes) for k, r in rows.items()} == {"a": (7, "3"), "b": (3, "1"), "Average": (10, "-")}
    assert rows["b"]["R@1"] == "1.0000" and float(rows["a"].MAP) > 0.7
    page = (tmp_path / "out/report.html").read_text()
    assert page.count("<tr") == 4 and "10 images in 2 sets" in page
    labels = {(r.dataset, r.label) for r in evaluation.image_embeddings(spark, str(root), lambda: mean_colour, size=8).select("dataset", "label").distinct().collect()}
    assert labels == {("a", 0), ("a", 2), ("b", 0)}  # blue, red; empty is 1
