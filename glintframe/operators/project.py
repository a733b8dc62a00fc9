"""Projections, selections, set operations and windows of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.operators import PIXEL, VOXEL


def deglow(movie: DataFrame, factor: float = 1.0, by: tuple = ()) -> DataFrame:
    """Each pixel less `factor` times its least value over all frames."""
    least = movie.groupBy(*by, *PIXEL).agg(F.min("value").alias("_least"))
    return movie.join(least, [*by, *PIXEL]).select(*by, *VOXEL, (F.col("value") - factor * F.col("_least")).alias("value"))


def projection(movie: DataFrame, how: str = "max", frames: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """Each pixel's max, min or mean over the frames, or those in frames(frame)."""
    picked = movie if frames is None else movie.join(frames.select("frame").distinct(), "frame", "left_semi")
    return picked.groupBy(*by, *PIXEL).agg({"max": F.max, "min": F.min, "mean": F.avg}[how]("value").alias("value"))


def top_pixels(image: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    """The k brightest pixels, ties in row-major order; a top-k without a full sort."""
    if not by:
        return image.orderBy(F.desc("value"), *PIXEL).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), *PIXEL))
    return image.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def stride(movie: DataFrame, step: int, start: int = 0) -> DataFrame:
    """Every step-th frame from `start` on, with the numbers they have."""
    return movie.where((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))


def coarsen(movie: DataFrame, frame: int = 1, height: int = 1, width: int = 1, by: tuple = ()) -> DataFrame:
    """Means of whole blocks, at their least coordinates; blocks that the end cuts
    short, known by their count in the dense grid, are left out."""
    sizes = {"frame": frame, "height": height, "width": width}
    keys = [(F.col(c) - F.col(c) % n).cast("int").alias(c) for c, n in sizes.items()]
    out = movie.groupBy(*by, *keys).agg(F.avg("value").alias("value"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == frame * height * width).drop("_n")


def clip(movie: DataFrame, low: float = 0.0) -> DataFrame:
    return movie.withColumn("value", F.greatest("value", F.lit(low)))


def select_pixels(movie: DataFrame, pixels: DataFrame, by: tuple = ()) -> DataFrame:
    """The traces of the pixels listed in pixels(height, width)."""
    return movie.join(pixels.select(*by, *PIXEL).distinct(), [*by, *PIXEL], "left_semi")


def crop(movie: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Label slices, both ends included: crop(movie, frame=(10, 20), height=(0, 3))."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).between(*kv[1])), bounds.items(), movie)


def split_overlap(movie: DataFrame, size: int = 100) -> DataFrame:
    """Parts of `size` frames, each holding the next one's first frame as well:
    (part, frame, height, width, value)."""
    part = F.floor(F.col("frame") / size).cast("int")
    both = F.when((F.col("frame") % size == 0) & (F.col("frame") > 0), F.array(part - 1, part)).otherwise(F.array(part))
    return movie.select(F.explode(both).alias("part"), *VOXEL, "value")


def concat(movies: list[DataFrame], dim: str = "frame") -> DataFrame:
    """One after the other along `dim`: each movie's coordinates go on where the one
    before it ends. The ends are single rows."""
    out, ends = movies[0], movies[0].agg((F.max(dim) + 1).alias("_end"))
    for m in movies[1:]:
        moved = m.crossJoin(F.broadcast(ends)).withColumn(dim, (F.col(dim) + F.coalesce("_end", F.lit(0))).cast("int")).drop("_end")
        grown = m.agg((F.max(dim) + 1).alias("_more")).crossJoin(F.broadcast(ends)).select((F.coalesce("_end", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("_end"))
        out, ends = out.unionByName(moved), grown
    return out


def merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Outer merge over shared dimensions. A variable that both have must agree
    wherever both know it, or the query fails."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    l, r = left.alias("l"), right.alias("r")
    out = l.join(r, on, "full_outer")

    def one(c: str):
        if c not in shared:
            return F.col(c)
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        conflict = a.isNotNull() & b.isNotNull() & (a != b)
        return F.when(conflict, F.raise_error(F.lit(f"conflicting values of {c}"))).otherwise(F.coalesce(a, b)).alias(c)

    return out.select(*on, *[one(c) for c in dict.fromkeys([*left.columns, *right.columns]) if c not in on])


def concat_nested(parts, dims: list[str]) -> DataFrame:
    """Movies in lists of lists put together: the outermost list along the first of
    dims, and so on; each part follows the one before it in its list."""
    if not dims:
        return parts
    return concat([concat_nested(p, dims[1:]) for p in parts], dims[0])


def layout_statistics(movie: DataFrame, chunk_bytes: int = 256 << 20, cell_bytes: int = 8, by: tuple = ()) -> DataFrame:
    """What a layout in chunks of whole frames of about chunk_bytes comes to: (chunk,
    frames, cells, bytes), chunk being the frame over the frames that a chunk holds."""
    size = movie.agg(F.countDistinct("height").alias("_h"), F.countDistinct("width").alias("_w"))
    per = F.greatest(F.floor(F.lit(float(chunk_bytes)) / (F.col("_h") * F.col("_w") * cell_bytes)), F.lit(1)).cast("long")
    at = movie.crossJoin(F.broadcast(size.select(per.alias("_per")))).withColumn("chunk", F.floor(F.col("frame") / F.col("_per")))  # one row
    return at.groupBy(*by, "chunk").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("cells"), (F.count("*") * cell_bytes).alias("bytes"))


def rolling_windows(n_frames: int, size: int, step: int) -> list[tuple[int, int, int]]:
    """(window, first frame, past the last) around evenly spread centres, so many
    that they lie `step` apart at most; windows are cut at the movie's ends."""
    count, half = -(-n_frames // step) + 1, -(-size // 2)
    centres = [i * (n_frames - 1) / (count - 1) if count > 1 else 0.0 for i in range(count)]
    floor, ceil = (lambda x: int(x // 1)), (lambda x: -int(-x // 1))
    return [(i, max(floor(c - half), 0), min(ceil(c + half), n_frames)) for i, c in enumerate(centres)]


def random_windows(n_frames: int, size: int, count: int, seed: int = 0) -> list[tuple[int, list[int]]]:
    """`count` draws of `size` frames with replacement, the last frame excluded."""
    import random

    rng = random.Random(seed)
    return [(i, [rng.randrange(max(n_frames - 1, 1)) for _ in range(size)]) for i in range(count)]


def window_projections(movie: DataFrame, windows: list[tuple[int, int, int]], by: tuple = ()) -> DataFrame:
    """Max projection of each window: (window, height, width, value).

    Each frame is tagged with the windows it is in by an expression over the
    (short, driver-made) list; partial maxima are taken before the shuffle.
    """
    tagged = F.array(*[F.when((F.col("frame") >= a) & (F.col("frame") < b), F.lit(i)) for i, a, b in windows])
    rows = movie.select(*by, F.explode(F.array_compact(tagged)).alias("window"), *PIXEL, "value")
    return rows.groupBy(*by, "window", *PIXEL).agg(F.max("value").alias("value"))
