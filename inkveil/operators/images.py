"""Images on pages against boxes: which are covered, which of their pixels, and the pixels blackened.

An image's matrix (a, b, c, d, e, f) takes the unit square to the page: x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.boxes import RECTS, at, intersects

REGIONS = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
#: Filters whose samples can be rewritten here; all others are told as not done.
RAW, FLATE = "", "FlateDecode"


def transformed(rect: Column, m: list[Column]) -> Column:
    """The box around a rectangle's corners under a matrix."""
    a, b, c, d, e, f = m
    corners = [(at(rect, i), at(rect, j)) for i in (0, 2) for j in (1, 3)]
    xs, ys = F.array(*[a * x + c * y + e for x, y in corners]), F.array(*[b * x + d * y + f for x, y in corners])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def image_box(matrix: Column) -> Column:
    return transformed(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), [at(matrix, k) for k in range(6)])


def pixel_regions(matrix: Column, width: Column, height: Column, rects: Column) -> Column:
    """Pixels (x0, y0, x1, y1) of an image that boxes cover, with one more around them."""
    a, b, c, d, e, f = [at(matrix, k) for k in range(6)]
    det = a * d - b * c
    inverse = [d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det]
    low = lambda u, n: F.greatest(F.floor(u * n) - 1, F.lit(0)).cast("int")
    high = lambda u, n: F.least(F.ceil(u * n) + 1, n).cast("int")
    region = lambda u: F.struct(low(at(u, 0), width).alias("x0"), low(at(u, 1), height).alias("y0"), high(at(u, 2), width).alias("x1"), high(at(u, 3), height).alias("y1"))
    found = F.transform(F.transform(rects, lambda r: transformed(r, inverse)), region)
    return F.when(det != 0, F.filter(found, lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]))).otherwise(F.array().cast(REGIONS))


def covered(images: DataFrame, boxes: DataFrame, page: tuple[str, ...]) -> DataFrame:
    """Images (matrix, width, height) with the boxes (rects, an array for each page) that touch them, their pixel regions, and whether the image can't be rewritten in place.

    images may have is_mask, inline and nested, which tell images that can't."""
    touched = F.filter("rects", lambda r: intersects(image_box(F.col("matrix")), r))
    found = images.join(boxes.select(*page, F.col("rects").cast(RECTS).alias("rects")), list(page)).withColumn("rects", touched).where(F.size("rects") > 0)
    odd = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_mask", "inline", "nested") if c in images.columns]
    fallback = odd[0] if odd else F.lit(False)
    for c in odd[1:]:
        fallback = fallback | c
    return found.withColumn("regions", pixel_regions(F.col("matrix"), F.col("width"), F.col("height"), F.col("rects"))).withColumn("fallback", fallback)


def pixels(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """(height, width, components) of samples; of 1 bit: 0 or 255."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 1:
        rows = raw[: (width * components + 7) // 8 * height].reshape(height, -1)
        return (np.unpackbits(rows, axis=1, count=width * components) * np.uint8(255)).reshape(height, width, components)
    return raw[: width * height * components].reshape(height, width, components).copy()


def fill(image: np.ndarray, regions: list[tuple[int, int, int, int]], value: int) -> np.ndarray:
    for x0, y0, x1, y1 in regions:
        image[y0:y1, x0:x1] = value
    return image


def packed(image: np.ndarray, bits: int) -> bytes:
    """Samples again; of 1 bit: from half of white on."""
    return np.packbits(image.reshape(image.shape[0], -1) >= 128, axis=1).tobytes() if bits == 1 else image.tobytes()


def blackened(images: DataFrame, keep: tuple[str, ...], value: int = 0) -> DataFrame:
    """keep, data, and done: images (data, filter, width, height, components, bits, regions, fallback) with their regions filled.

    Samples that are raw or deflated are rewritten in the same form. Others (there's no codec for them here), and those marked
    fallback, lose their data, so nothing under a box survives: done is false."""

    def run(batches):
        for batch in batches:
            made, done = [], []
            for r in batch.select([c for c in batch.schema.names if c not in keep]).to_pylist():
                whole = (r["width"] * r["components"] * r["bits"] + 7) // 8 * r["height"]
                able = not r["fallback"] and r["filter"] in (RAW, FLATE) and r["bits"] in (1, 8)
                raw = (zlib.decompress(r["data"]) if r["filter"] == FLATE else r["data"]) if able else b""
                able = able and len(raw) >= whole
                if able:
                    image = pixels(raw, r["width"], r["height"], r["components"], r["bits"])
                    raw = packed(fill(image, [(p["x0"], p["y0"], p["x1"], p["y1"]) for p in r["regions"]], value), r["bits"])
                    raw = zlib.compress(raw) if r["filter"] == FLATE else raw
                made.append(raw if able else None)
                done.append(able)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(made, pa.binary()), pa.array(done)], [*keep, "data", "done"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in images.select(*keep).dtypes)
    own = images.select(*keep, *[F.col(c) for c in ("data", "filter", "width", "height", "components", "bits", "regions", "fallback") if c not in keep])
    return own.mapInArrow(run, f"{kinds}, data binary, done boolean")


__all__ = ["blackened", "covered", "image_box", "pixel_regions", "transformed"]
