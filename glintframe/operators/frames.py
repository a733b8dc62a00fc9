"""Movies as one array per frame, and numpy kernels over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.functions import kernels
from glintframe.operators import VOXEL


def to_frames(movie: DataFrame, by: tuple = ()) -> DataFrame:
    """(frame, h, w, pixels): row-major arrays; the grid must be dense."""
    cells = F.sort_array(F.collect_list(F.struct("height", "width", "value")))
    return movie.groupBy(*by, "frame").agg((F.max("height") + 1).alias("h"), (F.max("width") + 1).alias("w"), F.transform(cells, lambda c: c["value"]).alias("pixels"))


def to_movie(frames: DataFrame, by: tuple = ()) -> DataFrame:
    at = frames.select(*by, "frame", "w", F.posexplode("pixels").alias("i", "value"))
    return at.select(*by, "frame", F.floor(F.col("i") / F.col("w")).cast("int").alias("height"), (F.col("i") % F.col("w")).cast("int").alias("width"), "value")


def pictures(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The images of a batch's h, w and pixels, without a copy."""
    pixels = b.column("pixels")
    flat, ends = pixels.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(pixels.offsets.to_numpy()))
    for end, h, w in zip(ends.tolist(), b.column("h").to_pylist(), b.column("w").to_pylist()):
        yield flat[end - h * w : end].astype(float, copy=False).reshape(h, w)


def map_frames(frames: DataFrame, fn) -> DataFrame:
    """frames with fn(image, row) in place of each image; no shuffle."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select([n for n in names if n != "pixels"]).to_pylist()
            out = [fn(im, r).ravel() for im, r in zip(pictures(b), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if n == "pixels" else b.column(n) for n in names], names=names)

    return frames.mapInArrow(run, frames.schema)


def on_frames(movie: DataFrame, method: str, by: tuple = (), **args) -> DataFrame:
    """A numpy kernel on every frame of a long movie."""
    run = {"bilateral": lambda im, _: kernels.bilateral(im, args.get("size", 5)), "anisotropic": lambda im, _: kernels.anisotropic(im, args.get("steps", 1))}[method]
    return to_movie(map_frames(to_frames(movie, by), run), by).select(*by, *VOXEL, "value")
