"""Footprints A (unit_id, height, width, value; non-zero), traces C (unit_id, frame,
value), background b (height, width, value) and f (frame, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions import kernels
from glintframe.operators import PIXEL, graph, signal, stencil
from glintframe.runtime import written

UNIT = "unit_id"


def init_footprints(movie: DataFrame, seeds: DataFrame, correlation: float = 0.8, window: float = 10.0, freq: float | None = None) -> DataFrame:
    """A: around each seed, the correlation of pixels with the seed's where it exceeds
    a threshold, and 1 at the seed. A seed alone within `window` has no footprint."""
    traces = movie if freq is None else signal.smooth(movie, freq, keys=tuple(PIXEL))
    place = F.shiftleft(F.col("height").cast("long"), 32) + F.col("width")
    rows = signal.arrays(traces, PIXEL).select(place.alias("id"), "trace")
    points = movie.select(place.alias("id"), *PIXEL).distinct()
    near = graph.near_pairs(seeds.select(place.alias("id"), *PIXEL).distinct(), points, window).select("src", "dst")
    corr = graph.edge_correlation(near, rows, points)
    named = corr.join(seeds.select(UNIT if UNIT in seeds.columns else F.col("seed_id").alias(UNIT), place.alias("src")), "src")
    height, width = (lambda c: F.shiftright(c, 32).cast("int").alias("height")), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("width"))
    around = named.where(F.col("corr") > correlation).select(UNIT, height("dst"), width("dst"), F.col("corr").alias("value"))
    own = named.select(UNIT, height("src"), width("src")).distinct().withColumn("value", F.lit(1.0))
    return around.union(own)


def gram(A: DataFrame) -> DataFrame:
    """(u1, u2, value): sums of products of overlapping footprints, each with itself too."""
    left, right = A.select(F.col(UNIT).alias("u1"), *PIXEL, F.col("value").alias("_a")), A.select(F.col(UNIT).alias("u2"), *PIXEL, F.col("value").alias("_b"))
    return left.join(right, PIXEL).groupBy("u1", "u2").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def against(movie: DataFrame, A: DataFrame) -> DataFrame:
    """(unit_id, frame, value): each frame's scalar product with each footprint."""
    return movie.join(A.select(UNIT, *PIXEL, F.col("value").alias("_a")), PIXEL).groupBy(UNIT, "frame").agg(F.sum(F.col("value") * F.col("_a")).alias("value"))


def init_traces(movie: DataFrame, A: DataFrame, iterations: int = 10, frames: int = 500) -> DataFrame:
    """C: ten steps of least squares per frame, from 0 and unconstrained.

    Units whose footprints overlap, over any number of steps, are a group; groups
    don't depend on each other. Each group is solved for `frames` frames at a time:
    its units' products with the frames meet the units' products with each other,
    of overlapping ones alone. Nothing is collected or broadcast.
    """
    pairs = written(gram(A), "gram")
    links = graph.connected(pairs.where("u1 < u2").select(F.col("u1").alias("a"), F.col("u2").alias("b")))
    units_ = A.select(UNIT).distinct().join(links.select(F.col("id").alias(UNIT), "component"), UNIT, "left").select(UNIT, F.coalesce("component", UNIT).alias("label"))
    units_ = written(units_, "groups")
    sums = against(movie, A).join(units_, UNIT).withColumn("block", F.floor(F.col("frame") / frames))
    sums = written(sums.select("label", "block", UNIT, "frame", "value"), "sums")
    inner = pairs.join(units_.select(F.col(UNIT).alias("u1"), "label"), "u1").join(sums.select("label", "block").distinct(), "label").select("label", "block", "u1", "u2", F.col("value").alias("g"))
    inner = inner.toDF(*inner.columns)  # columns of its own, as both sides come from one table

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at = np.unique(left.column(UNIT).to_numpy(), return_inverse=True)
        times, when = np.unique(left.column("frame").to_numpy(), return_inverse=True)
        y = np.zeros((len(ids), len(times)))
        y[at, when] = left.column("value").to_numpy()
        u1, u2, g = (right.column(c).to_numpy() for c in ("u1", "u2", "g"))
        order = np.argsort(u1, kind="stable")
        rows, cols, g = np.searchsorted(ids, u1[order]), np.searchsorted(ids, u2[order]), g[order]
        starts = np.searchsorted(rows, np.arange(len(ids)))  # each unit's product with itself is there
        x = _normal_equations(lambda d: np.add.reduceat(g[:, None] * d[cols], starts, axis=0), y, iterations)
        return pa.table({UNIT: np.repeat(ids, len(times)), "frame": pa.array(np.tile(times, len(ids)), pa.int32()), "value": x.ravel()})

    return sums.groupBy("label", "block").cogroup(inner.groupBy("label", "block")).applyInArrow(solve, f"{UNIT} long, frame int, value double")


def _normal_equations(times, y: np.ndarray, iterations: int) -> np.ndarray:
    """Conjugate gradients on g x = y, a column each; times(d) is g d."""
    x, r = np.zeros_like(y), y.copy()
    d, norm = r.copy(), (r * r).sum(0)
    for _ in range(iterations):
        q = times(d)
        size = (d * q).sum(0)
        step = np.divide(norm, size, out=np.zeros_like(norm), where=size > 1e-300)
        x, r = x + step * d, r - step * q
        new = (r * r).sum(0)
        d, norm = r + np.divide(new, norm, out=np.zeros_like(new), where=norm > 1e-300) * d, new
    return x


def overlaps(A: DataFrame) -> DataFrame:
    """(src, dst, shared, jaccard) of units that share a pixel, src being the smaller."""
    on = A.where("value > 0")
    size = sizes(on)
    a, b = on.select(F.col(UNIT).alias("src"), *PIXEL), on.select(F.col(UNIT).alias("dst"), *PIXEL)
    met = a.join(b, PIXEL).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))
    full = met.join(size.select(F.col(UNIT).alias("src"), F.col("n").alias("_n1")), "src").join(size.select(F.col(UNIT).alias("dst"), F.col("n").alias("_n2")), "dst")
    return full.select("src", "dst", "shared", (F.col("shared") / (F.col("_n1") + F.col("_n2") - F.col("shared"))).alias("jaccard"))


def jaccard_groups(A: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(unit_id, label): units linked by footprints whose Jaccard index exceeds a threshold."""
    nodes = A.select(F.col(UNIT).alias("id")).distinct()
    return graph.labels(nodes, overlaps(A).where(F.col("jaccard") > threshold)).withColumnRenamed("id", UNIT)


def merge_labels(A: DataFrame, C: DataFrame, correlation: float = 0.9, freq: float | None = None) -> DataFrame:
    """(unit_id, label): overlapping units whose traces correlate, over any number of steps."""
    traces = C if freq is None else signal.smooth(C, freq)
    rows = signal.arrays(traces, [UNIT]).withColumnRenamed(UNIT, "id")
    edges = graph.edge_correlation(overlaps(A).select("src", "dst"), rows, centres(A), 64).where(F.col("corr") > correlation)
    return graph.labels(A.select(F.col(UNIT).alias("id")).distinct(), edges).withColumnRenamed("id", UNIT)


def merged(var: DataFrame, labels: DataFrame) -> DataFrame:
    """The mean of a variable over the units of each label, which becomes the unit;
    a footprint's absent pixels count as 0."""
    members = labels.groupBy("label").agg(F.count("*").alias("_n"))
    dims = [c for c in var.columns if c not in (UNIT, "value")]
    sums = var.join(labels, UNIT).groupBy("label", *dims).agg(F.sum("value").alias("_s"))
    return sums.join(F.broadcast(members), "label").select(F.col("label").cast("long").alias(UNIT), *dims, (F.col("_s") / F.col("_n")).alias("value"))


def merge(A: DataFrame, C: DataFrame, correlation: float = 0.9, freq: float | None = None, more: tuple = ()) -> tuple:
    """A and C (and more variables) with units merged that overlap and correlate."""
    labels = written(merge_labels(A, C, correlation, freq), "labels")
    return tuple(merged(v, labels) for v in (A, C, *more))


def reconstruction(A: DataFrame, C: DataFrame) -> DataFrame:
    """The movie that footprints and traces stand for, where it isn't 0: sums of A x C."""
    return A.select(UNIT, *PIXEL, F.col("value").alias("_a")).join(C, UNIT).groupBy("frame", *PIXEL).agg(F.sum(F.col("_a") * F.col("value")).alias("value"))


def update_background(movie: DataFrame, A: DataFrame, C: DataFrame, b: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(b, f): the mean of what A and C leave of the movie, cut at 0, and the frames'
    least-squares factors for it. With b given, f alone is new."""
    model = reconstruction(A, C).withColumnRenamed("value", "_m")
    rest = movie.join(model, ["frame", *PIXEL], "left").select("frame", *PIXEL, F.greatest(F.col("value") - F.coalesce("_m", F.lit(0.0)), F.lit(0.0)).alias("value"))
    b = rest.groupBy(*PIXEL).agg(F.avg("value").alias("value")) if b is None else b
    f = rest.join(b.select(*PIXEL, F.col("value").alias("_b")), PIXEL).groupBy("frame").agg(
        F.coalesce(F.try_divide(F.sum(F.col("_b") * F.col("value")), F.sum(F.col("_b") * F.col("_b"))), F.lit(0.0)).alias("value")
    )
    return b, f


def traces(movie: DataFrame, A: DataFrame, b: DataFrame, C: DataFrame, f: DataFrame) -> DataFrame:
    """YrA: each unit's share of the movie less the background, and less what other
    units put under its footprint, cut at 0. Units with footprints and traces only."""
    norm = A.groupBy(UNIT).agg(F.sum(F.col("value") * F.col("value")).alias("_norm"))
    ya = against(movie, A)
    ba = A.join(b.select(*PIXEL, F.col("value").alias("_b")), PIXEL).groupBy(UNIT).agg(F.sum(F.col("value") * F.col("_b")).alias("_ba"))
    ca = gram(A).select(F.col("u1").alias(UNIT), F.col("u2"), F.col("value").alias("_g")).join(C.select(F.col(UNIT).alias("u2"), "frame", F.col("value").alias("_c")), "u2")
    ca = ca.groupBy(UNIT, "frame").agg(F.sum(F.col("_g") * F.col("_c")).alias("_ca"))
    met = ya.join(C.select(UNIT, "frame", F.col("value").alias("_c")), [UNIT, "frame"]).join(ca, [UNIT, "frame"]).join(norm, UNIT).join(ba, UNIT, "left").join(f.select("frame", F.col("value").alias("_f")), "frame", "left")
    own = (F.col("value") - F.coalesce("_ba", F.lit(0.0)) * F.coalesce("_f", F.lit(0.0)) - F.col("_ca")) / F.col("_norm") + F.col("_c")
    return met.select(UNIT, "frame", F.greatest(own, F.lit(0.0)).alias("value"))


def support(A: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(unit_id, height, width) within `radius` of a unit's footprint. Each pixel
    becomes one interval for each row of a disk; a row's intervals are united before
    they turn into pixels."""
    half = F.array(*[F.struct(F.lit(d * s).alias("dy"), F.lit(w).alias("w")) for d, w in enumerate(stencil.disk_widths(radius)) for s in ((1, -1) if d else (1,))])
    rows = A.where("value > 0").select(UNIT, F.explode(half).alias("k"), *PIXEL).select(
        UNIT, (F.col("height") + F.col("k.dy")).alias("height"), F.greatest(F.col("width") - F.col("k.w"), F.lit(0)).alias("lo"), F.least(F.col("width") + F.col("k.w"), F.lit(width - 1)).alias("hi")
    )
    rows = rows.where((F.col("height") >= 0) & (F.col("height") < height)).distinct()
    w = Window.partitionBy(UNIT, "height").orderBy("lo", "hi")
    new = rows.withColumn("_new", F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int"))
    spans = new.withColumn("_i", F.sum("_new").over(w)).groupBy(UNIT, "height", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.select(UNIT, "height", F.explode(F.sequence("lo", "hi")).alias("width"))


def spatial_single(rows: DataFrame) -> DataFrame:
    """rows(..., trace, x, alpha) with `value`: the non-negative lasso weight of one
    regressor, max(0, cov(x, y) - alpha) / var(x)."""
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size("x")
    out = rows.withColumn("_mx", plus(F.col("x")) / n).withColumn("_my", plus(F.col("trace")) / n)
    cov = plus(F.zip_with("x", "trace", lambda a, b: (a - F.col("_mx")) * (b - F.col("_my")))) / n
    var = plus(F.transform("x", lambda a: (a - F.col("_mx")) * (a - F.col("_mx")))) / n
    return out.withColumn("value", F.coalesce(F.try_divide(F.greatest(cov - F.col("alpha"), F.lit(0.0)), var), F.lit(0.0))).drop("_mx", "_my")


def products(movie: DataFrame, C: DataFrame, where: DataFrame, tile: int = 32, frames: int = 500) -> DataFrame:
    """(unit_id, height, width, cy): sums over frames of trace times pixel, for the
    pixels in where(unit_id, height, width).

    A blocked product: tiles of the picture meet the traces of the units on them,
    `frames` frames at a time, so that the movie is shuffled once, whatever
    number of units a pixel has, and blocks are of one size.
    """
    tiled = lambda df: df.withColumns({"ty": F.floor(F.col("height") / tile), "tx": F.floor(F.col("width") / tile)})
    block = F.floor(F.col("frame") / frames)
    left = tiled(movie.select("frame", *PIXEL, "value")).withColumn("block", block)
    on = tiled(where).select(UNIT, "ty", "tx").distinct()
    right = C.select(UNIT, "frame", "value").join(on, UNIT).withColumn("block", block)
    right = right.toDF(*right.columns)  # columns of its own, as C may come from the movie

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({UNIT: pa.array([], pa.int64()), "height": pa.array([], pa.int32()), "width": pa.array([], pa.int32()), "cy": pa.array([], pa.float64())})
        if not len(a) or not len(b):
            return empty
        times, when = np.unique(np.concatenate((a.column("frame").to_numpy(), b.column("frame").to_numpy())), return_inverse=True)
        at = a.column("height").to_numpy().astype(np.int64) << 32 | a.column("width").to_numpy()
        pixels, px = np.unique(at, return_inverse=True)
        units_, un = np.unique(b.column(UNIT).to_numpy(), return_inverse=True)
        y, x = np.zeros((len(pixels), len(times))), np.zeros((len(units_), len(times)))
        y[px, when[: len(a)]], x[un, when[len(a) :]] = a.column("value").to_numpy(), b.column("value").to_numpy()
        return pa.table({
            UNIT: np.repeat(units_, len(pixels)), "height": np.tile((pixels >> 32).astype(np.int32), len(units_)), "width": np.tile((pixels & 0xFFFFFFFF).astype(np.int32), len(units_)),
            "cy": (x @ y.T).ravel(),
        })

    keys = ("ty", "tx", "block")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, f"{UNIT} long, height int, width int, cy double")
    return parts.join(where.select(UNIT, *PIXEL), [UNIT, *PIXEL], "left_semi").groupBy(UNIT, *PIXEL).agg(F.sum("cy").alias("cy"))


def centres(A: DataFrame) -> DataFrame:
    """(id, height, width): the middle of each unit's pixels."""
    return A.groupBy(F.col(UNIT).alias("id")).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in PIXEL])


def covariances(C: DataFrame, pairs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(u1, u2, cov) of the traces of distinct pairs(u1, u2), u1 <= u2: traces are centred
    once each, and multiplied by parts of the picture (see graph.edge_products)."""
    rows = signal.centred(C, [UNIT]).withColumnRenamed(UNIT, "id")
    dots = graph.edge_products(pairs.select(F.col("u1").alias("src"), F.col("u2").alias("dst")), rows.select("id", "trace"), None if points is None else graph.tiles(points, 64))
    sizes_ = C.groupBy(F.col(UNIT).alias("src")).agg(F.count("*").alias("_n"))
    return dots.join(sizes_, "src").select(F.col("src").alias("u1"), F.col("dst").alias("u2"), (F.col("dot") / F.col("_n")).alias("cov"))


def spatial_weights(movie: DataFrame, C: DataFrame, where: DataFrame, sn: DataFrame, penalty: float = 0.5) -> DataFrame:
    """(unit_id, height, width, value > 0): for each pixel, non-negative lasso weights of
    the units in where(unit_id, height, width), at alpha = penalty * sn.

    All that a pixel's weights depend on are covariances: of its units' traces with
    the pixel's, and with each other. Those come from products of blocks, and
    from the pairs of units that share a pixel; pixels are then solved in batches.
    """
    where = written(where.select(UNIT, *PIXEL).distinct(), "support")
    traces_ = C.groupBy(UNIT).agg(F.avg("value").alias("_mc"), F.count("*").alias("_n"))
    pixel = movie.groupBy(*PIXEL).agg(F.avg("value").alias("_my"))
    got = products(movie, C, where).join(traces_, UNIT).join(pixel, PIXEL)
    got = written(got.select(UNIT, *PIXEL, (F.col("cy") / F.col("_n") - F.col("_mc") * F.col("_my")).alias("want")), "products")
    a, b = got.select(F.col(UNIT).alias("u1"), *PIXEL), got.select(F.col(UNIT).alias("u2"), *PIXEL)
    both = a.join(b, PIXEL)
    cov = covariances(C, both.where("u1 <= u2").select("u1", "u2").distinct(), centres(got))
    cov = cov.union(cov.where("u1 < u2").select(F.col("u2").alias("u1"), F.col("u1").alias("u2"), "cov"))
    gram_ = both.join(cov, ["u1", "u2"]).groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("u1", "u2", "cov"))).alias("gs"))
    want = got.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct(UNIT, "want"))).alias("us"))
    rows = want.join(gram_, PIXEL).join(sn.select(*PIXEL, (F.col("sn") * penalty).alias("alpha")), PIXEL)
    rows = rows.select(*PIXEL, F.col(f"us.{UNIT}").alias("ids"), F.col("us.want").alias("want"), F.col("gs.cov").alias("cov"), "alpha")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("ids").offsets.to_numpy())
            ids, want, cov = (b.column(c).flatten().to_numpy() for c in ("ids", "want", "cov"))
            first, second = np.cumsum(size) - size, np.cumsum(size * size) - size * size
            w = [kernels.positive_lasso_of(cov[k : k + n * n].reshape(n, n), want[i : i + n], al) for i, k, n, al in zip(first, second, size, b.column("alpha").to_numpy())]
            out = [pa.array(ids), *(pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in PIXEL), pa.array(np.concatenate(w) if w else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(out, names=[UNIT, *PIXEL, "value"])

    return rows.mapInArrow(solve, f"{UNIT} long, height int, width int, value double").where("value > 0")


def sizes(A: DataFrame) -> DataFrame:
    """(unit_id, n): pixels of each footprint."""
    return A.where("value > 0").groupBy(UNIT).agg(F.count("*").alias("n"))


def sized(A: DataFrame, low: int | None = 9, high: int | None = None) -> DataFrame:
    """Units with more than low and fewer than high pixels."""
    keep = sizes(A).where((F.col("n") > low) if low else F.lit(True)).where((F.col("n") < high) if high else F.lit(True))
    return A.join(keep.select(UNIT), UNIT, "left_semi")


def normalised(A: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(A over each unit's maximum, those maxima as (unit_id, factor))."""
    top = A.groupBy(UNIT).agg(F.max("value").alias("factor"))
    return A.join(top, UNIT).select(UNIT, *PIXEL, (F.col("value") / F.col("factor")).alias("value")), top


def update_spatial(
    movie: DataFrame, A: DataFrame, C: DataFrame, sn: DataFrame, *, shape: tuple[int, int], radius: int = 5, penalty: float = 0.5, size: tuple[int | None, int | None] | None = (9, None),
    normalize: bool = True, b: DataFrame | None = None, f: DataFrame | None = None,
) -> tuple:
    """(A, factors, b): footprints fitted within `radius` of the old ones, units of
    unfit size left out, each over its maximum (factors: unit_id, factor). With b and
    f, the background is fitted along as a unit of its own."""
    where = support(A, radius, *shape)
    if b is not None:
        where = where.union(b.where("value > 0").select(F.lit(-1).cast("long").alias(UNIT), *PIXEL))
        C = C.select(UNIT, "frame", "value").union(f.select(F.lit(-1).cast("long"), "frame", "value"))
    new = written(spatial_weights(movie, C, where, sn, penalty), "weights")
    back = new.where(f"{UNIT} = -1").select(*PIXEL, "value") if b is not None else None
    new = new.where(f"{UNIT} <> -1")
    new = sized(new, *size) if size else new
    factors = new.groupBy(UNIT).agg(F.lit(1.0).alias("factor"))
    if normalize:
        new, factors = normalised(new)
    return new, factors, back


TEMPORAL = "unit_id long, frame int, c double, s double, b double, c0 double, g array<double>, u double, lam double"


def update_temporal(
    A: DataFrame, YrA: DataFrame, *, freq: float = 0.25, p: int = 1, add_lag: int | str = "p", jaccard: float = 0.1, penalty: float = 1.0, smooth: bool = True,
    median_window: int | None = None, normalize: bool = True, zero: float | None = 1e-8, scale: bool = False, smooth_in_place: bool = True,
    segments: list[int] | None = None, warm: DataFrame | None = None, silent: bool = False,
) -> DataFrame:
    """(unit_id, frame, c, s, b, c0, g, u, lam): deconvolved traces of units with anything
    above 0, groups of overlapping units sharing a normalisation; units without spikes
    are left out, unless `silent` ones are wanted. With scale, c, s, b and c0 are brought to YrA by a least-squares factor.

    Group means are taken first, so that units, however many a group has, are solved
    one by one: the joint problem of a group is a sum over its units, and has the same
    solution. Solutions are exact, and u proves it: see kernels.deconvolve_rows, at
    the penalty lam for s. What is below zero is 0 (None: nothing is). smooth_in_place deconvolves the smoothed trace; segments
    gives each frame's baseline segment; warm, traces that others would begin with,
    isn't needed, as there is one solution, whatever the start.
    """
    alive = YrA.groupBy(UNIT).agg(F.max("value").alias("m")).where("m > 0").select(UNIT)
    rows = signal.arrays(YrA.join(alive, UNIT, "left_semi"), [UNIT])
    if normalize:
        total = F.aggregate("trace", F.lit(0.0), lambda s, v: s + v)
        groups = jaccard_groups(A.join(alive, UNIT, "left_semi"), jaccard)
        means = rows.join(groups, UNIT).groupBy("label").agg(F.avg(total).alias("m"))
        rows = rows.join(groups, UNIT).join(means, "label").select(UNIT, "trace", F.coalesce(F.try_divide(F.size("trace"), "m"), F.lit(1.0)).alias("k"))
    else:
        rows = rows.withColumn("k", F.lit(1.0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trace, k = b.column("trace"), b.column("k").to_numpy()
            flat, ends, units_ = trace.flatten().to_numpy(), np.cumsum(np.diff(trace.offsets.to_numpy())), b.column(UNIT).to_numpy()
            length = np.diff(ends, prepend=0)
            for n in np.unique(length):
                for at in np.array_split(same := np.flatnonzero(length == n), -(-len(same) * int(n) // 2_000_000) or 1):
                    y = np.stack([flat[ends[i] - n : ends[i]] for i in at]) * k[at, None]
                    sn = kernels.noise_fft(y, freq, 1.0)
                    base = kernels.fft_filter(y, freq, "low") if smooth else y
                    g = kernels.ar_coefficients(base, kernels.noise_fft(base, freq, 1.0) if smooth else sn, p, add_lag)
                    y = base if smooth and smooth_in_place else y
                    y = kernels.above_baseline(y, median_window) if median_window else y
                    lam = np.nan_to_num(sn) * penalty
                    *parts, u = kernels.deconvolve_rows(y, g, lam, segments, zero)
                    for j, i in enumerate(at):
                        cols = [pa.array(np.full(n, units_[i])), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(v[j] / k[i]) for v in parts]]
                        yield pa.RecordBatch.from_arrays(
                            [*cols, pa.array([g[j].tolist()] * int(n), pa.list_(pa.float64())), pa.array(u[j]), pa.array(np.full(n, lam[j]))],
                            names=[UNIT, "frame", "c", "s", "b", "c0", "g", "u", "lam"],
                        )

    out = rows.mapInArrow(solve, TEMPORAL)
    spikes = out if silent else out.withColumn("_s", F.sum("s").over(Window.partitionBy(UNIT))).where("_s > 0").drop("_s")
    if not scale:
        return spikes
    k = signal.scale_to(spikes.select(UNIT, "frame", (F.col("c") + F.col("b") + F.col("c0")).alias("value")), YrA)
    return spikes.join(k, UNIT).select(UNIT, "frame", *[(F.col(c) * F.col("scale")).alias(c) for c in ("c", "s", "b", "c0")], "g", "u", "lam")


def trace_of(temporal: DataFrame, column: str) -> DataFrame:
    return temporal.select(UNIT, "frame", F.col(column).alias("value"))
