"""Finding and filtering seeds: (seed_id, height, width, seeds, mask_...)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.operators import PIXEL, graph, project, signal, stencil
from glintframe.runtime import written


def numbered(pixels: DataFrame) -> DataFrame:
    """Seeds get ids from 0 in row-major order; there is one at most per pixel of a frame."""
    return pixels.withColumn("seed_id", (F.row_number().over(Window.orderBy(*PIXEL)) - 1).cast("long"))


def find(movie: DataFrame, n_frames: int, window: int = 500, step: int = 200, max_radius: int = 10, diff: float = 2.0, method: str = "rolling", draws: int = 100, seed: int = 0) -> DataFrame:
    """Pixels that are a local maximum, at some radius from 2 to max_radius - 1, of the
    max projection of some window of frames; `seeds` counts the windows."""
    if method == "rolling":
        shots = project.window_projections(movie, project.rolling_windows(n_frames, window, step))
    else:
        spark = movie.sparkSession
        picks = [(i, f) for i, fs in project.random_windows(n_frames, window, draws, seed) for f in set(fs)]
        shots = movie.join(F.broadcast(spark.createDataFrame(picks, "window int, frame int")), "frame").groupBy("window", *PIXEL).agg(F.max("value").alias("value"))
    tops = stencil.local_max_any(shots.withColumnRenamed("window", "frame"), 2, max_radius, diff).where("extreme")
    votes = graph.region_centres(tops, ("frame",)).groupBy(*PIXEL).agg(F.countDistinct("frame").alias("seeds"))
    return numbered(votes).select("seed_id", *PIXEL, F.col("seeds").cast("int").alias("seeds"))


def find_in_frame(image: DataFrame, max_radius: int = 10, diff: float = 2.0) -> DataFrame:
    """The same in one image(height, width, value), at radii from 1; a max_radius of 1
    or less stands for 100."""
    tops = stencil.local_max_any(image.withColumn("frame", F.lit(0)), 1, max_radius if max_radius > 1 else 100, diff).where("extreme")
    return numbered(graph.region_centres(tops).select(*PIXEL)).select("seed_id", *PIXEL, F.lit(1).alias("seeds"))


def traces_at(movie: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, frame, value) of the seeds' pixels."""
    return movie.join(seeds.select("seed_id", *PIXEL), PIXEL).select("seed_id", "frame", "value")


def _masked(seeds: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """seeds with mask `name`, from kept(seed_id, name); false where that has no row."""
    return seeds.drop(name).join(kept, "seed_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pnr_refine(movie: DataFrame, seeds: DataFrame, freq: float = 0.25, threshold: float | str = 1.5, q: tuple[float, float] = (0.1, 99.9), median_window: int | None = None) -> DataFrame:
    """mask_pnr: peak-to-noise ratio above a threshold ("auto": in the upper one of two
    Gaussian components)."""
    traces = traces_at(movie, seeds)
    if median_window:
        traces = signal.above_baseline(traces, median_window, ("seed_id",))
    ratio = signal.peak_to_noise(traces, freq, q, ("seed_id",))
    if threshold == "auto":
        split = gaussian_split(ratio.select("seed_id", F.col("pnr").alias("value")))
        return _masked(seeds, split.select("seed_id", F.col("upper").alias("mask_pnr")), "mask_pnr")
    return _masked(seeds, ratio.select("seed_id", (F.col("pnr") > threshold).alias("mask_pnr")), "mask_pnr")


def ks_refine(movie: DataFrame, seeds: DataFrame, significance: float = 0.01) -> DataFrame:
    """mask_ks: the trace's values aren't distributed normally."""
    p = signal.normality(traces_at(movie, seeds), ("seed_id",))
    return _masked(seeds, p.select("seed_id", (F.col("p") < significance).alias("mask_ks")), "mask_ks")


def mixture(values: DataFrame, components: int = 2, iterations: int = 100, tol: float = 1e-6) -> list[tuple[float, float, float]]:
    """(weight, mean, variance) of each of a mixture of Gaussian components, fitted to
    values(value) by expectation maximisation.

    It begins with equal weights, means at the middle quantiles of as many equal
    parts, and the variance of all; a millionth of that is added to each variance. It
    ends when the mean log-likelihood rises by less than tol. So the fit depends on
    the values alone. Each step is one aggregation; what the driver holds are the
    components."""
    k = range(components)
    first = values.agg(F.var_pop("value").alias("v"), F.percentile("value", F.array(*[F.lit((i + 0.5) / components) for i in k])).alias("m")).first()
    floor = 1e-6 * first["v"]
    now, was = [(1 / components, first["m"][i], first["v"] + floor) for i in k], None
    for _ in range(iterations):
        logs = [F.lit(math.log(w) - 0.5 * math.log(v)) - (F.col("value") - m) * (F.col("value") - m) / (2 * v) for w, m, v in now]
        top = F.greatest(*logs) if components > 1 else logs[0]
        told = values.select("value", top.alias("_top"), *[x.alias(f"_l{i}") for i, x in enumerate(logs)])
        told = told.select("value", (F.col("_top") + F.log(sum((F.exp(F.col(f"_l{i}") - F.col("_top")) for i in k), F.lit(0.0)))).alias("_all"), *[f"_l{i}" for i in k])
        share = [F.exp(F.col(f"_l{i}") - F.col("_all")) for i in k]
        # about the old means, so that one aggregation gives means and variances
        sums = [F.sum(x) for r, (_, m, _) in zip(share, now) for x in (r, r * (F.col("value") - m), r * (F.col("value") - m) * (F.col("value") - m))]
        got = told.agg(F.count("*"), F.avg("_all"), *sums).first()
        new = []
        for i in k:
            n, one, two = got[2 + 3 * i], got[3 + 3 * i], got[4 + 3 * i]
            n = max(n, 1e-300)
            new.append((max(n / got[0], 1e-12), now[i][1] + one / n, max(two / n - (one / n) ** 2, 0.0) + floor))
        now = new
        if was is not None and got[1] - was < tol:
            break
        was = got[1]
    return now


def gaussian_split(values: DataFrame, components: int = 2, valid: int = 1, iterations: int = 100) -> DataFrame:
    """values(seed_id, value) with `upper`: whether a value belongs to one of the
    `valid` mixture components with the greatest means, and exceeds the least mean.
    Values that aren't finite don't; with fewer distinct ones than components, all do."""
    values = written(values.select("seed_id", F.col("value").cast("double").alias("value")), "mixture")
    finite = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    if len(finite.select("value").distinct().take(components)) < components:  # nothing to tell apart
        return values.select("seed_id", "value", F.lit(True).alias("upper"))
    fit = mixture(finite, components, iterations)
    order = sorted(range(components), key=lambda i: fit[i][1])
    like = F.array(*[F.lit(math.log(w) - 0.5 * math.log(v)) - (F.col("value") - m) * (F.col("value") - m) / (2 * v) for w, m, v in (fit[i] for i in order)])
    rank = F.array_position(like, F.array_max(like))  # by rising means, from 1
    upper = (rank > components - valid) & (F.col("value") > fit[order[0]][1])
    told = finite.select("seed_id", upper.alias("_up"))
    return values.join(told, "seed_id", "left").select("seed_id", "value", F.coalesce("_up", F.lit(False)).alias("upper"))


def gmm_refine(movie: DataFrame, seeds: DataFrame, q: tuple[float, float] = (0.1, 99.9), components: int = 2, valid: int = 1) -> DataFrame:
    """mask_gmm: the trace's range belongs to the upper mixture components."""
    split = gaussian_split(signal.ptp(traces_at(movie, seeds), q, ("seed_id",)).withColumnRenamed("ptp", "value"), components, valid)
    return _masked(seeds, split.select("seed_id", F.col("upper").alias("mask_gmm")), "mask_gmm")


def brightness_threshold(image: DataFrame, multiple: float = 2.0) -> DataFrame:
    """One row: the edge of a histogram of pixels / 10 bins that lies `multiple` times
    as far up as its fullest bin (the lowest one on ties); null beyond the last edge."""
    span = image.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.bround(F.count("*") / 10, 0).cast("int").alias("bins"))
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("step")), F.col("bins") - 1)
    binned = image.crossJoin(F.broadcast(span.withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins")))).select(F.coalesce(place, F.lit(0)).alias("bin"), "lo", "step", "bins")
    fullest = binned.groupBy("bin", "lo", "step", "bins").count().agg(F.max(F.struct("count", -F.col("bin"), "lo", "step", "bins")).alias("t"))
    edge = F.bround(-F.col("t.col2") * multiple, 0).cast("int")
    return fullest.select(F.when(edge <= F.col("t.bins"), F.col("t.lo") + edge * F.col("t.step")).alias("threshold"))


def intensity_refine(image: DataFrame, seeds: DataFrame, multiple: float = 2.0) -> DataFrame:
    """mask_int: the max projection at the seed exceeds brightness_threshold; null if
    there is no such edge."""
    met = seeds.drop("mask_int").join(image.select(*PIXEL, F.col("value").alias("_v")), PIXEL, "left").crossJoin(F.broadcast(brightness_threshold(image, multiple)))
    return met.withColumn("mask_int", F.col("_v") > F.col("threshold")).select(*seeds.drop("mask_int").columns, "mask_int")


def combined(seeds: DataFrame, *masks: str) -> DataFrame:
    """Seeds that all masks keep, numbered anew."""
    kept = seeds
    for m in masks:
        kept = kept.where(F.col(m))
    return numbered(kept.drop("seed_id")).select(*seeds.columns)


def merge(movie: DataFrame, image: DataFrame, seeds: DataFrame, distance: float = 5.0, correlation: float = 0.6, freq: float | None = None) -> DataFrame:
    """mask_mrg: of seeds near each other whose traces correlate, over any number of
    steps, the one that is brightest in the max projection (the first on ties)."""
    points = seeds.select(F.col("seed_id").alias("id"), *PIXEL)
    traces = traces_at(movie, seeds)
    if freq is not None:
        traces = signal.smooth(traces, freq, keys=("seed_id",))
    rows = signal.arrays(traces, ["seed_id"]).withColumnRenamed("seed_id", "id")
    edges = graph.edge_correlation(graph.radius_pairs(points, distance).select("src", "dst"), rows, points).where(F.col("corr") > correlation)
    groups = graph.connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    met = seeds.drop("mask_mrg").join(groups.select(F.col("id").alias("seed_id"), "component"), "seed_id", "left").join(image.select(*PIXEL, F.col("value").alias("_v")), PIXEL, "left")
    best = met.groupBy(F.coalesce("component", "seed_id").alias("_g")).agg(F.max(F.struct("_v", -F.col("seed_id"))).alias("b")).select((-F.col("b.col2")).alias("seed_id"), F.lit(True).alias("mask_mrg"))
    return _masked(seeds, best, "mask_mrg")
