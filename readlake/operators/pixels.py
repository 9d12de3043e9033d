"""Pixel tables (img, x, y, r, g, b): grey values, quantizing and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 4 x 4 threshold matrix.
BAYER = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def bayer_quantize(grey: Column, x: Column, y: Column, levels: int) -> Column:
    """The nearest of ``levels`` greys after an ordered threshold by position."""
    step = 255.0 / (levels - 1)
    table = F.array(*(F.lit((v + 0.5) / 16 - 0.5) for v in BAYER))
    shifted = grey + F.element_at(table, (y.bitwiseAND(3) * 4 + x.bitwiseAND(3) + 1).cast("int")) * step
    return F.floor(F.greatest(F.least(F.floor(shifted / step + 0.5), F.lit(levels - 1)), F.lit(0)) * step + 0.5).cast("int")


def diffuse_quantize(pixels: DataFrame, levels: int) -> DataFrame:
    """img, x, y, q by error diffusion (7, 3, 5 and 1 sixteenths), each image on its own.

    An image's pixels are gathered in one row, as its order of pixels asks for.  Pixels with the same x + 2y wait for
    none of each other, so an image takes width + 2 × height steps, and images of a batch that share a size take them
    together.  Missing pixels count as black and give no row.
    """
    step = 255.0 / (levels - 1)

    def spread(grey: np.ndarray) -> np.ndarray:
        """Quantized values of images × rows × columns."""
        n, height, width = grey.shape
        work = np.zeros((height + 1, width + 2, n))
        work[:height, 1 : width + 1] = grey.transpose(1, 2, 0)
        out = np.zeros((height, width, n), np.int32)
        for front in range(width + 2 * (height - 1)):
            y = np.arange(max(0, (front - width + 2) // 2), min(height - 1, front // 2) + 1)
            x = front - 2 * y
            old = work[y, x + 1]
            new = (np.clip(np.trunc(old / step + 0.5), 0, levels - 1) * step + 0.5).astype(np.int32)
            out[y, x] = new
            off = old - new
            # in the order in which a pixel-by-pixel pass would add to each
            for down, k, share in ((1, 0, 3), (1, 1, 5), (1, 2, 1), (0, 2, 7)):
                work[y + down, x + k] += off * share / 16
        return out.transpose(2, 0, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (width, height), alike in batch.groupby(["width", "height"]):
                size = alike["x"].map(len).to_numpy()
                at = np.repeat(np.arange(len(alike)), size)
                x, y = np.concatenate(alike["x"].to_list()), np.concatenate(alike["y"].to_list())
                grey = np.zeros((len(alike), height, width))
                grey[at, y, x] = np.concatenate(alike["grey"].to_list())
                yield pd.DataFrame({"img": np.repeat(alike["img"].to_numpy(), size), "x": x, "y": y, "q": spread(grey)[at, y, x]})

    own = F.array_sort(F.collect_list(F.struct("y", "x", "grey")))
    sized = pixels.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), own.alias("p"))
    rows = sized.where("img is not null and width is not null and height is not null").select("img", "width", "height", *(F.col(f"p.{c}").alias(c) for c in ("x", "y", "grey")))
    return rows.mapInPandas(run, "img long, x int, y int, q int")


def contrast(grey: Column, step: int) -> Column:
    """Contrast 1 + 0.12 × ``step`` about the middle grey."""
    return F.greatest(F.least((grey - 128) * (1 + 0.12 * step) + 128, F.lit(255.0)), F.lit(0.0))


def image_stats(pixels: DataFrame, before: str, after: str, levels: int) -> DataFrame:
    """img, levels used, mean shift and whether every value is a level."""
    step = 255.0 / (levels - 1)
    on = F.floor(F.floor(F.col(after) / step + 0.5) * step + 0.5) == F.col(after)
    return pixels.groupBy("img").agg(F.countDistinct(after).alias("used"), F.round(F.avg(F.col(after) - F.col(before)), 6).alias("shift"), F.bool_and(on).alias("on_levels"))


def fit_box(w: Column, h: Column, dw: int, dh: int) -> list[Column]:
    """turned, scale, left and top of a picture contained in the target; a landscape one turns for a portrait target."""
    turned = (w > h) & F.lit(dw < dh)
    sw, sh = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    scale = F.least(dw / sw, dh / sh)
    margin = lambda d, s: F.floor((d - s * scale) / 2 + 0.5).cast("int")
    return [turned.alias("turned"), F.round(scale, 9).alias("scale"), margin(dw, sw).alias("left"), margin(dh, sh).alias("top")]


def sample_factor(w: Column, h: Column, max_w: int, max_h: int) -> Column:
    """The largest power of two by which a picture can be decoded smaller and still cover the target."""
    ratio = F.least(w / max_w, h / max_h)
    return F.when(ratio < 1, 1).otherwise(F.pow(F.lit(2), F.floor(F.log2(ratio)))).cast("int")


def rotate_pixels(x: Column, y: Column, width: int, height: int, degrees: int) -> tuple[Column, Column]:
    turn = degrees % 360
    if turn == 90:
        return height - 1 - y, x
    if turn == 180:
        return width - 1 - x, height - 1 - y
    if turn == 270:
        return y, width - 1 - x
    return x, y


def frame_arrays(pixels: DataFrame, grey: Column) -> DataFrame:
    """img, values: each image's greys in row order.  An image is one row, so this is for sampled frames."""
    return pixels.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", grey.alias("v")))), lambda p: p["v"]).alias("values"))
