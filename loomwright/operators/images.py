"""Images as rows: grey or colour pixels in Arrow batches, perceptual hashes, near copies by Hamming distance."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loomwright.operators import corpus as C
from loomwright.storage import materialize, release

#: The side that images are hashed at, and the coefficients of a side that count.
HASH_SIDE, HASH_KEPT = 32, 8
#: Weights of red, green and blue in grey; what is ink, and the least share of it; borders.
GREY, INK_BELOW, LEAST_INK, TOLERANCE, PADDING = (0.299, 0.587, 0.114), 250, 0.002, 10, 4


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """origin, height, width, data (RGB bytes, row by row) of a folder's images, as far as the JVM can decode them."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    return read.select("image.origin", "image.height", "image.width", _rgb(F.col("image.data"), F.col("image.nChannels")).alias("data"))


@F.pandas_udf(BinaryType())
def _rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw: bytes, n: int) -> bytes:
        x = np.frombuffer(raw, np.uint8).reshape(-1, n)
        if n == 1:
            x = np.repeat(x, 3, axis=1)
        elif n == 4:  # blue, green, red, alpha, on white
            a = x[:, 3:].astype(np.float64) / 255
            x = np.rint(x[:, :3] * a + 255 * (1 - a)).astype(np.uint8)
            x = x[:, ::-1]
        else:
            x = x[:, ::-1]
        return x.tobytes()

    return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)], dtype=object)


def to_png(pixels: np.ndarray) -> bytes:
    """An RGB or grey image (height, width[, 3]) as PNG."""
    pixels = np.asarray(pixels, np.uint8)
    kind = 2 if pixels.ndim == 3 else 0
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb.astype(np.float64) @ np.array(GREY) + 0.5)


def _kernel(n: int, m: int) -> np.ndarray:
    """Weights of n pixels in each of m, by a windowed sinc of three lobes, wider where the image shrinks."""
    scale = n / m
    reach = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    x = (np.arange(n)[None] + 0.5 - centre[:, None]) / reach
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.tensordot(_kernel(pixels.shape[0], height), pixels.astype(np.float64), axes=1)
    out = np.moveaxis(np.tensordot(_kernel(pixels.shape[1], width), np.moveaxis(out, 1, 0), axes=1), 0, 1)
    return np.clip(np.floor(out + 0.5), 0, 255)


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits as a signed number: which of the lowest frequencies reach the median, the first in the highest bit."""
    small = resized(grey(pixels) if pixels.ndim == 3 else pixels, HASH_SIDE, HASH_SIDE)
    d = _cosines(HASH_SIDE)[:HASH_KEPT]
    low = (d @ small @ d.T).ravel()
    return int(np.packbits(low >= np.median(low)).view(">i8")[0])


def cropped(pixels: np.ndarray, tolerance: int = TOLERANCE, padding: int = PADDING) -> np.ndarray:
    """Without the white around what is drawn, but for a border; a blank image stays as it is."""
    ink = (255 - pixels.astype(np.int16) > tolerance).any(axis=2)
    if not ink.any():
        return pixels
    rows, columns = (np.nonzero(ink.any(axis=a))[0] for a in (1, 0))
    return pixels[max(0, rows[0] - padding) : rows[-1] + 1 + padding, max(0, columns[0] - padding) : columns[-1] + 1 + padding]


def on_square(pixels: np.ndarray, size: int, upscale: bool = True) -> np.ndarray:
    """As large as fits a white square, in its middle."""
    scale = min(size / pixels.shape[0], size / pixels.shape[1])
    scale = scale if upscale else min(scale, 1.0)
    h, w = (max(1, round(x * scale)) for x in pixels.shape[:2])
    out = np.full((size, size, 3), 255, np.uint8)
    top, left = (size - h) // 2, (size - w) // 2
    out[top : top + h, left : left + w] = resized(pixels, h, w)
    return out


def displaced(pixels: np.ndarray, alpha: float, sigma: float, seed: int) -> np.ndarray:
    """Warped by a smooth random field that the seed fixes; the edges are reflected."""
    h, w = pixels.shape[:2]
    r = np.random.default_rng(seed)
    reach = max(1, int(3 * sigma))
    g = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(sigma, 1e-9)) ** 2)
    g /= g.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            x = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, wide)
        return x

    dy, dx = (smooth(r.uniform(-1, 1, (h, w))) * alpha for _ in range(2))
    mirror = lambda v, n: np.abs((v + n) % (2 * n) - n).clip(0, n - 1)
    y, x = mirror(np.arange(h)[:, None] + dy, h), mirror(np.arange(w)[None] + dx, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    p = pixels.astype(np.float64).reshape(h, w, -1)
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8).reshape(pixels.shape)


def ink_share(pixels: np.ndarray) -> float:
    return float((grey(pixels) < INK_BELOW).mean())


def structural_similarity(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, reach: int = 5) -> float:
    """Mean SSIM of two grey images of one size, by Gaussian windows of 11 pixels."""
    g = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            x = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, x)
        return x

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = blur(a), blur(b)
    va, vb, vab = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def pixel_congruence(a: Column, b: Column) -> Column:
    """Cosine of two arrays of grey values; 0 where one is all black."""
    norm = F.sqrt(C.dot(a, a) * C.dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(C.dot(a, b) / norm)


def multiple_of(size: Column, unit: int = 16) -> Column:
    """The nearest lower multiple, one unit at least."""
    return F.greatest(F.lit(unit), F.floor(size / unit) * unit).cast("int")


def of_image(f: Callable[[np.ndarray], object], kind: str) -> Callable[[Column, Column, Column], Column]:
    """A column function (data, height, width) of what ``f`` makes of an RGB image; null where it can't be read."""

    @F.pandas_udf(kind)
    def run(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def one(raw: bytes | None, h: float, w: float) -> object:
            try:
                return f(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(*x) for x in zip(data, height, width, strict=True)], dtype=object)

    return run


def hashed(images: DataFrame) -> DataFrame:
    """``images`` with hash; those that can't be read are left out."""
    hash_ = of_image(perceptual_hash, "long")(F.col("data"), F.col("height"), F.col("width"))
    return images.withColumn("hash", hash_).where("hash is not null")


def keep_greedily(hashes: DataFrame, distance: int = 2, rounds: int = 1000) -> DataFrame:
    """id, hash that stay if rows are seen by id and one stays unless a row that stayed is within ``distance``.

    Equal hashes leave their first row. Rounds settle rows whose earlier neighbours are settled: a row without any
    open or kept earlier neighbour stays, one with a kept one goes. Only undecided rows take part in a round.
    """
    firsts = materialize(hashes.groupBy("hash").agg(F.min("id").alias("id")).select("id", "hash"), "hashes")
    near = C.hamming_pairs(firsts, firsts, distance).where("id_a < id_b").select(F.col("id_a").alias("early"), F.col("id_b").alias("late"))
    edges = materialize(near, "near")
    lost: DataFrame | None = None
    for _ in range(rounds):
        open_ = edges.select(F.col("late").alias("id")).distinct()
        stays = edges.select(F.col("early").alias("id")).distinct().join(open_, "id", "left_anti")
        goes = materialize(edges.join(stays.select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "goes")
        if goes.isEmpty():
            break
        lost = goes if lost is None else lost.unionByName(goes)
        left = edges.join(goes.select(F.col("id").alias("late")), "late", "left_anti").join(goes.select(F.col("id").alias("early")), "early", "left_anti")
        after = materialize(left.select("early", "late"), "near")
        release(edges)
        edges = after
    else:
        raise RuntimeError(f"not settled in {rounds} rounds")
    return firsts if lost is None else firsts.join(lost, "id", "left_anti")


def cross_duplicates(a: DataFrame, b: DataFrame, distance: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, distinct ids of the first side, distinct ids of the second side)."""
    pairs = materialize(C.hamming_pairs(a, b, distance), "pairs")
    return pairs, pairs.select("id_a").distinct(), pairs.select("id_b").distinct()
