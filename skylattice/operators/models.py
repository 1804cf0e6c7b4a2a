"""Model hooks on image rows: encoders, detectors and transforms are injected and loaded once for each task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, IntegerType

from skylattice.functions.pixels import black, decode_image

# Channel means and deviations of the image normalisation.
CLIP_MEAN = (0.48145466, 0.4578275, 0.40821073)
CLIP_STD = (0.26862954, 0.26130258, 0.27577711)


def normalise_pixels(pixels: np.ndarray) -> np.ndarray:
    """Channels-first float array of an RGB image (height, width, 3) of bytes."""
    scaled = (pixels.astype(np.float32) / 255 - np.array(CLIP_MEAN, np.float32)) / np.array(CLIP_STD, np.float32)
    return scaled.transpose(2, 0, 1)


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights of an antialiased bicubic resize along one axis."""
    scale = n_in / n_out
    support = max(1.0, scale)
    centres = (np.arange(n_out) + 0.5) * scale - 0.5
    x = np.abs(np.arange(n_in)[None, :] - centres[:, None]) / support
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize_crop(pixels: np.ndarray, size: int = 224) -> np.ndarray:
    """Shorter side to ``size`` (bicubic), then the centre square."""
    h, w = pixels.shape[:2]
    nh, nw = (size, max(size, int(w * size / h))) if h <= w else (max(size, int(h * size / w)), size)
    out = np.einsum("oh,hwc->owc", _cubic(h, nh), pixels.astype(np.float64))
    out = np.einsum("pw,owc->opc", _cubic(w, nw), out)
    top, left = round((nh - size) / 2), round((nw - size) / 2)
    return np.clip(np.rint(out[top : top + size, left : left + size]), 0, 255).astype(np.uint8)


def random_resized_crop(pixels: np.ndarray, rng: np.random.Generator, size: int = 224, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3)) -> np.ndarray:
    """A random area and shape cut out and resized, mirrored every other time. The generator comes from the row's id."""
    h, w = pixels.shape[:2]
    for _ in range(10):
        area, shape = h * w * rng.uniform(*scale), np.exp(rng.uniform(*np.log(ratio)))
        cw, ch = round(np.sqrt(area * shape)), round(np.sqrt(area / shape))
        if 0 < cw <= w and 0 < ch <= h:
            top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
            cut = pixels[top : top + ch, left : left + cw]
            break
    else:
        side = min(h, w)
        cut = pixels[(h - side) // 2 : (h - side) // 2 + side, (w - side) // 2 : (w - side) // 2 + side]
    out = np.einsum("oh,hwc->owc", _cubic(cut.shape[0], size), cut.astype(np.float64))
    out = np.clip(np.rint(np.einsum("pw,owc->opc", _cubic(cut.shape[1], size), out)), 0, 255).astype(np.uint8)
    return out[:, ::-1] if rng.random() < 0.5 else out


def eval_transform(size: int = 224) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    return lambda pixels, rng: normalise_pixels(resize_crop(pixels, size))


def train_transform(size: int = 224, scale=(0.08, 1.0)) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    return lambda pixels, rng: normalise_pixels(random_resized_crop(pixels, rng, size, scale))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def image_vectors(rows: DataFrame, column: str, key: str, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None, transform: Callable[[np.ndarray, np.random.Generator], np.ndarray] | None = None, invalid: str = "black", size: int = 224, batch_size: int = 64, seed: str = "0", out: str = "vec", normalised: bool = True, decode: Callable[[bytes], np.ndarray | None] = decode_image) -> DataFrame:
    """``rows`` without ``column``, the bytes of images, and with what the encoder makes of them.

    Bytes are decoded to RGB pixels; undecodable and null ones become a black square (``invalid="black"``) or their rows
    go (``"drop"``). ``transform`` (``eval_transform`` by default) gives the tensor of an image; its generator is seeded
    by ``seed`` and the row's ``key``, so a repeated task draws the same crops. The encoder gets stacks of up to
    ``batch_size`` tensors; a ``LazyModel`` is built once in each worker process. Without an encoder the tensors
    themselves are returned, flat. An extra column of the name ``out`` is replaced."""
    if invalid not in ("black", "drop"):
        raise ValueError("invalid is black or drop")
    transform = transform or eval_transform(size)
    kept = [f for f in rows.schema.fields if f.name not in (column, out)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = encoder() if encoder else None
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                pixels = [decode(x) if x is not None else None for x in part[column]]
                if invalid == "drop":
                    part = part[[x is not None for x in pixels]]
                    pixels = [x for x in pixels if x is not None]
                draws = (np.random.default_rng(zlib.crc32(f"{seed}/{k}".encode())) for k in part[key])
                tensors = [transform(black(size) if x is None else x, rng) for x, rng in zip(pixels, draws)]
                if tensors:
                    vecs = np.asarray(model(np.stack(tensors)) if model else [t.ravel() for t in tensors], np.float32)
                    vecs = _unit(vecs) if normalised and model else vecs
                    yield part[[f.name for f in kept]].assign(**{out: list(vecs)})

    return rows.mapInPandas(run, type(rows.schema)([*kept]).add(out, ArrayType(FloatType())))


def encode(rows: DataFrame, column: str, encoder: Callable[[], Callable[[list], np.ndarray]], batch_size: int = 64, out: str = "vec", normalised: bool = True) -> DataFrame:
    """``rows`` with the encoder's vectors of ``column`` (images or texts), of unit length unless told otherwise."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                x = np.asarray(model(part[column].tolist()), np.float32)
                if normalised:
                    x = _unit(x)
                yield part.assign(**{out: list(x)})

    return rows.mapInPandas(run, type(rows.schema)([*rows.schema.fields]).add(out, ArrayType(FloatType())))


def tokenise(rows: DataFrame, column: str, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], context: int = 256, pad: int = 0, batch_size: int = 64) -> DataFrame:
    """``rows`` with token ids of ``column``, cut at the context length and padded to the longest of their batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = tokenizer()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                ids = [list(x)[:context] for x in model(part[column].tolist())]
                longest = max(map(len, ids), default=0)
                yield part.assign(token_ids=[x + [pad] * (longest - len(x)) for x in ids])

    return rows.mapInPandas(run, type(rows.schema)([*rows.schema.fields]).add("token_ids", ArrayType(IntegerType())))


def detect(rows: DataFrame, detector: Callable[[list[str] | None], Callable[[bytes], list[tuple]]], classes: list[str] | None = None) -> DataFrame:
    """Boxes of each image (id, image_bytes) from an open-vocabulary detector with the given (or its own) classes: one row
    per box (id, cls, score, x0, y0, x1, y1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = detector(classes)
        for frame in frames:
            out = [(i, *box) for i, content in zip(frame["id"], frame["image_bytes"]) for box in model(content)]
            yield pd.DataFrame(out, columns=["id", "cls", "score", "x0", "y0", "x1", "y1"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "image_bytes").mapInPandas(run, f"id {kind}, cls string, score double, x0 double, y0 double, x1 double, y1 double")
