"""Frame-local neighbourhood operators, as window functions along rows and columns.

Rectangular and separable kernels are two passes of windows; a disk is a row
window for each of its heights, shifted vertically. All windows of a frame are
clustered by frame, so operators have one shuffle at most, together too (none of a
movie stored by frame, see sources.catalog), and work is linear in the kernel's
extent, not in its area.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.operators import PIXEL, VOXEL

#: Smoothing kernels for sigma 0, by size: fixed values of the common 8-bit tables.
SMALL_GAUSSIANS = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def by_frame(movie: DataFrame, by: tuple = ()) -> DataFrame:
    """The movie with its frames' heights and widths as _h and _w, frame by frame.

    A window over each frame finds them. It needs a frame's rows in one place and in
    order, as all later windows along rows and columns do; whether that takes an
    exchange is up to the plan: none where the movie is stored by frame, or comes from
    another operator of this kind.
    """
    w = Window.partitionBy(*by, "frame").orderBy(*PIXEL).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return movie.withColumns({"_h": F.max("height").over(w) + 1, "_w": F.max("width").over(w) + 1})


def _along(axis: str, by: tuple):
    other = "width" if axis == "height" else "height"
    return Window.partitionBy(*by, "frame", other).orderBy(axis)


def padded(movie: DataFrame, axis: str, before: int, after: int, mode: str, size: Column) -> DataFrame:
    """The movie with rows beyond its borders along an axis: "reflect" repeats the
    edge (b a | a b), "reflect101" doesn't (c b | a b), "replicate" is a a | a b.
    Only pixels near a border are copied, by an expression of their place."""
    x, n = F.col(axis), size
    if mode == "replicate":
        head = F.when(x == 0, F.sequence(F.lit(-before), F.lit(-1))) if before else F.lit(None)
        tail = F.when(x == n - 1, F.sequence(n, n + (after - 1))) if after else F.lit(None)
        copies = [c for c in ((F.coalesce(head, F.array().cast("array<int>")) if before else None), (F.coalesce(tail, F.array().cast("array<int>")) if after else None)) if c is not None]
        at = F.concat(F.array(x), *copies)
    else:
        # every image of x under reflection, as far as it lies in the padding; small frames are reflected repeatedly
        period, flip = (n * 2, -x - 1) if mode == "reflect" else (F.greatest(n * 2 - 2, F.lit(1)), -x)
        turns = F.sequence(-(F.ceil(F.lit(before) / period).cast("int") + 1), F.ceil((F.lit(after) + n) / period).cast("int") + 1)
        images = F.array_distinct(F.flatten(F.transform(turns, lambda k: F.array(x + k * period, flip + k * period))))
        at = F.filter(images, lambda p: (p >= -before) & (p < n + after))
    return movie.withColumn(axis, F.explode(at))


def correlations(movie: DataFrame, pairs: dict[str, tuple[tuple, tuple]], mode: str, by: tuple = ()) -> DataFrame:
    """The movie with a column for each pair of odd kernels of one length, (along rows,
    along columns): its correlation with their outer product. All in two passes."""
    out = by_frame(movie, by).withColumns({n: F.col("value") for n in pairs})
    for axis, size, which in (("width", "_w", 0), ("height", "_h", 1)):
        half = len(next(iter(pairs.values()))[which]) // 2
        w = _along(axis, by)

        def total(name: str, kernel: tuple) -> Column:
            shifted = [F.col(name) if i == half else F.lag(name, half - i).over(w) if i < half else F.lead(name, i - half).over(w) for i in range(len(kernel))]
            return sum((k * x for k, x in zip(kernel, shifted) if k), F.lit(0.0))

        out = padded(out, axis, half, half, mode, F.col(size)).withColumns({n: total(n, k[which]) for n, k in pairs.items()}).where((F.col(axis) >= 0) & (F.col(axis) < F.col(size)))
    return out.select(*by, *VOXEL, "value", *pairs)


def separable(movie: DataFrame, rows: tuple, columns: tuple, mode: str, by: tuple = ()) -> DataFrame:
    """Correlation with the outer product of two odd kernels of one length."""
    return correlations(movie, {"_c": (rows, columns)}, mode, by).select(*by, *VOXEL, F.col("_c").alias("value"))


def gaussian_kernel(size: int, sigma: float = 0.0) -> tuple[float, ...]:
    if sigma <= 0 and size in SMALL_GAUSSIANS:
        return SMALL_GAUSSIANS[size]
    s = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * s * s)) for i in range(size)]
    return tuple(x / sum(w) for x in w)


def gaussian(movie: DataFrame, size: int = 5, sigma: float = 0.0, by: tuple = ()) -> DataFrame:
    """Gaussian smoothing; an even size is raised by one; borders as reflect101."""
    kernel = gaussian_kernel(size + (size % 2 == 0), sigma)
    return separable(movie, kernel, kernel, "reflect101", by)


def with_box_mean(movie: DataFrame, size: int, mode: str = "reflect", by: tuple = ()) -> DataFrame:
    """The movie with `mean`, that of size x size pixels around; of an even size, the
    further one lies before."""
    before, after = size // 2, (size - 1) // 2
    out = by_frame(movie, by).withColumn("mean", F.col("value"))
    for axis, n in (("width", "_w"), ("height", "_h")):
        mean = F.avg("mean").over(_along(axis, by).rowsBetween(-before, after))
        out = padded(out, axis, before, after, mode, F.col(n)).withColumn("mean", mean).where((F.col(axis) >= 0) & (F.col(axis) < F.col(n)))
    return out.select(*by, *VOXEL, "value", "mean")


def box_mean(movie: DataFrame, size: int, mode: str = "reflect", by: tuple = ()) -> DataFrame:
    return with_box_mean(movie, size, mode, by).select(*by, *VOXEL, F.col("mean").alias("value"))


def median(movie: DataFrame, size: int = 5, by: tuple = ()) -> DataFrame:
    """Median over an odd square, borders replicated."""
    size += size % 2 == 0
    half = size // 2
    out = by_frame(movie, by)
    out = padded(out, "width", half, half, "replicate", F.col("_w"))
    out = padded(out, "height", half, half, "replicate", F.col("_h"))
    out = out.withColumn("_c", F.collect_list("value").over(_along("height", by).rowsBetween(-half, half))).where((F.col("height") >= 0) & (F.col("height") < F.col("_h")))
    out = out.withColumn("_c", F.flatten(F.collect_list("_c").over(_along("width", by).rowsBetween(-half, half)))).where((F.col("width") >= 0) & (F.col("width") < F.col("_w")))
    return out.select(*by, *VOXEL, F.get(F.array_sort("_c"), F.lit(size * size // 2)).alias("value"))


def disk_widths(radius: int) -> list[int]:
    """Half width of a disk's row at each vertical distance from 0 to radius."""
    return [math.isqrt(radius * radius - d * d) for d in range(radius + 1)]


def ellipse_widths(size: int) -> list[int]:
    """The same of the ellipse inscribed in a size x size square, size being odd."""
    r = size // 2
    return [round(r * math.sqrt(max(r * r - d * d, 0) / (r * r))) if r else 0 for d in range(r + 1)]


def _over_disk(df: DataFrame, names: dict[str, tuple[str, str]], widths: list[int], by: tuple) -> DataFrame:
    """names: output -> (input, "max" or "min") over the disk, pixels outside the frame left out."""
    kinds = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    if "_h" not in df.columns:
        df = by_frame(df, by)
    df = df.where(F.col("height") < F.col("_h"))  # keeps all; a use of _h, so that the plan keeps frames whole
    along, down = _along("width", by), _along("height", by)
    rows, out = {}, {}
    for name, (source, kind) in names.items():
        for w in set(widths):
            rows[f"_{name}_{w}"] = kinds[kind][0](source).over(along.rowsBetween(-w, w))
    df = df.withColumns(rows)
    for name, (_, kind) in names.items():
        terms = [F.col(f"_{name}_{widths[0]}")]
        for d, w in enumerate(widths[1:], 1):
            terms += [F.lag(f"_{name}_{w}", d).over(down), F.lead(f"_{name}_{w}", d).over(down)]
        out[name] = kinds[kind][1](*terms) if len(terms) > 1 else terms[0]  # greatest and least pass over nulls
    return df.withColumns(out).drop(*rows)


def dilate(movie: DataFrame, radius: int, by: tuple = ()) -> DataFrame:
    return _over_disk(movie, {"value": ("value", "max")}, disk_widths(radius), by).select(*by, *VOXEL, "value")


def erode(movie: DataFrame, radius: int, by: tuple = ()) -> DataFrame:
    return _over_disk(movie, {"value": ("value", "min")}, disk_widths(radius), by).select(*by, *VOXEL, "value")


def tophat(movie: DataFrame, radius: int | None = None, by: tuple = (), widths: list[int] | None = None) -> DataFrame:
    """The movie less its opening by a disk."""
    widths = widths or disk_widths(radius)
    low = _over_disk(movie, {"_low": ("value", "min")}, widths, by)
    high = _over_disk(low, {"_open": ("_low", "max")}, widths, by)
    return high.select(*by, *VOXEL, (F.col("value") - F.col("_open")).alias("value"))


def remove_background(movie: DataFrame, method: str = "uniform", window: int = 5, by: tuple = ()) -> DataFrame:
    """Less the mean of a window x window box, or less the opening by a disk of that radius."""
    if method == "tophat":
        return tophat(movie, window, by)
    if method != "uniform":
        raise ValueError(f"unknown background method {method}")
    return with_box_mean(movie, window, by=by).select(*by, *VOXEL, (F.col("value") - F.col("mean")).alias("value"))


def preview_background(movie: DataFrame, method: str = "uniform", size: int = 5, by: tuple = ()) -> DataFrame:
    """What is shown while parameters are chosen: less a box mean with borders as
    reflect101, or less the opening by the ellipse in a size x size square."""
    if method == "tophat":
        return tophat(movie, by=by, widths=ellipse_widths(size + (size % 2 == 0)))
    if method != "uniform":
        raise ValueError(f"unknown background method {method}")
    return with_box_mean(movie, size, "reflect101", by).select(*by, *VOXEL, (F.col("value") - F.col("mean")).alias("value"))


def edge_mask(movie: DataFrame, by: tuple = ()) -> DataFrame:
    """Where the Sobel derivative, in whole grey levels, isn't 0: what contours follow."""
    return sobel(movie, by).withColumn("edge", F.floor("value") > 0)


def denoise(movie: DataFrame, method: str = "gaussian", size: int = 5, by: tuple = ()) -> DataFrame:
    """By frame: gaussian or median as windows, bilateral or anisotropic as numpy kernels."""
    if method == "gaussian":
        return gaussian(movie, size, by=by)
    if method == "median":
        return median(movie, size, by)
    if method in ("bilateral", "anisotropic"):
        from glintframe.operators.frames import on_frames

        return on_frames(movie, method, by, size=size)
    raise ValueError(f"unknown denoising method {method}")


def local_extreme(movie: DataFrame, radius: int, kind: str = "max", diff: float = 0.0, by: tuple = ()) -> DataFrame:
    """Where a pixel is the greatest (or least) of its disk, and the disk's range is
    more than diff: the movie with `extreme`."""
    out = _over_disk(movie, {"_hi": ("value", "max"), "_lo": ("value", "min")}, disk_widths(radius), by)
    top = F.col("_hi") if kind == "max" else F.col("_lo")
    return out.select(*by, *VOXEL, "value", ((F.col("value") == top) & (F.col("_hi") - F.col("_lo") > diff)).alias("extreme"))


def local_max_any(movie: DataFrame, first: int, last: int, diff: float = 0.0, by: tuple = ()) -> DataFrame:
    """As local_extreme, for any radius from first to last - 1."""
    if first >= last:
        raise ValueError("radii must grow")
    names = {f"_{k}{r}": ("value", v) for r in range(first, last) for k, v in (("hi", "max"), ("lo", "min"))}
    out = movie
    for r in range(first, last):
        out = _over_disk(out, {f"_hi{r}": ("value", "max"), f"_lo{r}": ("value", "min")}, disk_widths(r), by)
    hit = F.lit(False)
    for r in range(first, last):
        hit = hit | ((F.col("value") == F.col(f"_hi{r}")) & (F.col(f"_hi{r}") - F.col(f"_lo{r}") > diff))
    return out.withColumn("extreme", hit).drop(*names, "_h", "_w")


def sobel(movie: DataFrame, by: tuple = ()) -> DataFrame:
    """Half the sum of the horizontal and the vertical derivative's sizes."""
    flat, step = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
    both = correlations(movie, {"_dx": (step, flat), "_dy": (flat, step)}, "reflect101", by)
    return both.select(*by, *VOXEL, (0.5 * F.abs("_dx") + 0.5 * F.abs("_dy")).alias("value"))
