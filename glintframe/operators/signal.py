"""Operators on traces: (unit, frame, value), dense in frame from 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions import kernels


def arrays(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trace: keys and `trace`, its values in order of frames."""
    cells = F.sort_array(F.collect_list(F.struct("frame", "value")))
    return traces.groupBy(*keys).agg(F.transform(cells, lambda c: c["value"]).alias("trace"))


def centred(traces: DataFrame, keys: list[str]) -> DataFrame:
    """As arrays, less each trace's mean; the mean comes from the aggregation that
    gathers the trace, so that it isn't found anew for each of its values."""
    cells = F.sort_array(F.collect_list(F.struct("frame", "value")))
    rows = traces.groupBy(*keys).agg(cells.alias("_cells"), F.avg("value").alias("_mean"))
    return rows.select(*keys, F.transform("_cells", lambda c: c["value"] - F.col("_mean")).alias("trace"))


def long(rows: DataFrame, keys: list[str], column: str = "trace") -> DataFrame:
    return rows.select(*keys, F.posexplode(column).alias("frame", "value"))


def on_traces(rows: DataFrame, fn, out: str, kind: str = "double") -> DataFrame:
    """rows(..., trace) with out = fn(matrix): traces of a batch that have one length
    are the rows of a matrix. fn gives a value for each, or an array ("array<double>")."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trace = b.column("trace")
            flat, length = trace.flatten().to_numpy(zero_copy_only=False), np.diff(trace.offsets.to_numpy())
            ends = np.cumsum(length)
            got: list = [None] * len(length)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                for i, v in zip(at, fn(flat[(ends[at] - n)[:, None] + np.arange(n)].astype(float, copy=False))):
                    got[i] = v if kind.startswith("array") else float(v)
            arrow = pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names if n != out), pa.array(got, arrow)], names=[*(n for n in names if n != out), out])

    schema = rows.drop(out).select("*", F.lit(None).cast(kind).alias(out)).schema
    return rows.mapInArrow(run, schema)


def smooth(traces: DataFrame, freq: float, method: str = "fft", kind: str = "low", keys: tuple = ("unit_id",)) -> DataFrame:
    """Low- or high-pass filtered traces, by the spectrum or a causal Butterworth filter."""
    rows = on_traces(arrays(traces, list(keys)), lambda x: kernels.smooth(x, freq, method, kind), "trace", "array<double>")
    return long(rows, list(keys))


def noise(traces: DataFrame, band: tuple[float, float] = (0.25, 0.5), method: str = "logmexp", estimator: str = "fft", keys: tuple = ("unit_id",)) -> DataFrame:
    """Noise level `sn` of each trace from a band of frequencies."""
    fn = {"fft": kernels.noise_fft, "welch": kernels.noise_welch}[estimator]
    return on_traces(arrays(traces, list(keys)), lambda x: fn(x, *band, method), "sn").drop("trace")


def ptp(traces: DataFrame, q: tuple[float, float] = (0.1, 99.9), keys: tuple = ("unit_id",)) -> DataFrame:
    """Distance of two percentiles (in percent) of each trace, between values linearly."""
    both = F.percentile("value", F.array(F.lit(q[0] / 100), F.lit(q[1] / 100)))
    return traces.groupBy(*keys).agg(both.alias("_q")).select(*keys, (F.col("_q")[1] - F.col("_q")[0]).alias("ptp"))


def percentiles(traces: DataFrame, q: tuple[float, ...], keys: tuple = ("unit_id",)) -> DataFrame:
    """Percentiles (in percent) of each trace, between values linearly, as q25 and so on."""
    at = F.percentile("value", F.array(*[F.lit(x / 100) for x in q]))
    return traces.groupBy(*keys).agg(at.alias("_q")).select(*keys, *[F.col("_q")[i].alias(f"q{x:g}") for i, x in enumerate(q)])


def peak_to_noise(traces: DataFrame, freq: float = 0.25, q: tuple[float, float] = (0.1, 99.9), keys: tuple = ("unit_id",)) -> DataFrame:
    """Range of each trace over the range of its high frequencies; infinite if those have none."""
    return on_traces(arrays(traces, list(keys)), lambda x: kernels.peak_to_noise(x, freq, q), "pnr").drop("trace")


def normality(traces: DataFrame, keys: tuple = ("unit_id",)) -> DataFrame:
    return on_traces(arrays(traces, list(keys)), kernels.normality, "p").drop("trace")


def above_baseline(traces: DataFrame, window: int, keys: tuple = ("unit_id",)) -> DataFrame:
    """What exceeds each trace's running median."""
    return long(on_traces(arrays(traces, list(keys)), lambda x: kernels.above_baseline(x, window), "trace", "array<double>"), list(keys))


def autocovariance(traces: DataFrame, lags: int, keys: tuple = ("unit_id",)) -> DataFrame:
    """(keys, lag, acov): of centred traces, over their full length."""
    w = Window.partitionBy(*keys)
    centred = traces.withColumn("_c", F.col("value") - F.avg("value").over(w))
    ahead = F.array(*[F.coalesce(F.col("_c") * F.lead("_c", k).over(w.orderBy("frame")), F.lit(0.0)) if k else F.col("_c") * F.col("_c") for k in range(lags + 1)])
    sums = centred.withColumn("_p", ahead).groupBy(*keys).agg(*[F.sum(F.col("_p")[k]).alias(f"_s{k}") for k in range(lags + 1)], F.count("*").alias("_n"))
    each = F.posexplode(F.array(*[F.col(f"_s{k}") / F.col("_n") for k in range(lags + 1)])).alias("lag", "acov")
    return sums.select(*keys, each)


def ar1(traces: DataFrame, noise_levels: DataFrame, lags: int = 2, keys: tuple = ("unit_id",)) -> DataFrame:
    """First-order coefficient: the least-squares slope of cov(l + 1) on cov(l), l below
    `lags`, with sn^2 taken off lag 0."""
    cov = autocovariance(traces, lags, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "acov"))).alias("_c"))
    met = cov.join(noise_levels, list(keys)).select(*keys, F.transform("_c", lambda c: F.when(c["lag"] == 0, c["acov"] - F.pow("sn", F.lit(2))).otherwise(c["acov"])).alias("_x"), F.transform("_c", lambda c: c["acov"]).alias("_y"))
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x, y = F.slice("_x", 1, lags), F.slice("_y", 2, lags)
    return met.select(*keys, F.coalesce(F.try_divide(plus(F.zip_with(x, y, lambda a, b: a * b)), plus(F.transform(x, lambda a: a * a))), F.lit(0.0)).alias("g"))


def ar(traces: DataFrame, noise_levels: DataFrame, p: int = 2, add_lag: int | str = "p", keys: tuple = ("unit_id",)) -> DataFrame:
    """(keys, lag, g): coefficients of any order."""
    rows = arrays(traces, list(keys)).join(noise_levels, list(keys)).withColumn("trace", F.concat("trace", F.array("sn")))
    fit = on_traces(rows, lambda x: kernels.ar_coefficients(x[:, :-1], x[:, -1], p, add_lag), "g", "array<double>")
    return fit.select(*keys, F.posexplode("g").alias("lag", "g"))


def longest_rise(traces: DataFrame, keys: tuple = ("unit_id",)) -> DataFrame:
    """Frames of the rising run with the greatest rise, the first one on ties, and
    that rise: (keys, rise_frames, rise); 0 where nothing rises."""
    w = Window.partitionBy(*keys).orderBy("frame")
    up = traces.withColumn("_up", F.coalesce(F.lead("value").over(w) > F.col("value"), F.lit(False)))
    new = (F.col("_up") & ~F.coalesce(F.lag("_up").over(w), F.lit(False))).cast("int")
    runs = up.withColumn("_run", F.sum(new).over(w)).where("_up")
    each = runs.groupBy(*keys, "_run").agg(F.count("*").alias("n"), (F.max_by("value", "frame") - F.min_by("value", "frame")).alias("rise"))
    best = each.groupBy(*keys).agg(F.max(F.struct("rise", -F.col("_run"), "n")).alias("b"))
    return traces.select(*keys).distinct().join(best, list(keys), "left").select(*keys, F.coalesce("b.n", F.lit(0)).cast("long").alias("rise_frames"), F.coalesce("b.rise", F.lit(0.0)).alias("rise"))


def scale_to(a: DataFrame, b: DataFrame, keys: tuple = ("unit_id",)) -> DataFrame:
    """The least-squares factor from traces a to traces b."""
    met = a.select(*keys, "frame", F.col("value").alias("_a")).join(b.select(*keys, "frame", F.col("value").alias("_b")), [*keys, "frame"])
    return met.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sum(F.col("_a") * F.col("_a"))), F.lit(0.0)).alias("scale"))
