"""The whole analysis: from a raw movie to footprints, traces and spikes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import PIXEL, motion, project, seeds, signal, stencil, units
from glintframe.runtime import written

#: Parameters by step, as sources.params.as_dict gives them.
DEFAULTS = {
    "remove_glow": {"factor": 1.0},
    "denoise": {"method": "median", "ksize": 7},
    "remove_background": {"method": "tophat", "wnd": 15},
    "estimate_motion": {"chunk": 3, "upsample": 100},
    "seeds_init": {"wnd_size": 1000, "stp_size": 500, "max_wnd": 15, "diff_thres": 3},
    "pnr_refine": {"noise_freq": 0.06, "thres": 1},
    "ks_refine": {"sig": 0.05},
    "seeds_merge": {"thres_dist": 10, "thres_corr": 0.8, "noise_freq": 0.06},
    "initialize": {"thres_corr": 0.8, "wnd": 10, "noise_freq": 0.06},
    "init_merge": {"thres_corr": 0.8},
    "get_noise": {"noise_range": (0.06, 0.5)},
    "first_spatial": {"dl_wnd": 10, "sparse_penal": 0.01, "size_thres": (25, None)},
    "first_temporal": {"noise_freq": 0.06, "sparse_penal": 1, "p": 1, "add_lag": 20, "jac_thres": 0.2},
    "first_merge": {"thres_corr": 0.8},
    "second_spatial": {"dl_wnd": 10, "sparse_penal": 0.01, "size_thres": (25, None)},
    "second_temporal": {"noise_freq": 0.06, "sparse_penal": 1, "p": 1, "add_lag": 20, "jac_thres": 0.4},
}


def corrected(movie: DataFrame, p: dict) -> DataFrame:
    """De-glowed, denoised, without background, and motion-corrected."""
    if p["remove_glow"].get("factor"):
        movie = project.deglow(movie, p["remove_glow"]["factor"])
    if p["denoise"] is not None:
        movie = stencil.denoise(movie, p["denoise"]["method"], p["denoise"]["ksize"])
    if p["remove_background"] is not None:
        movie = stencil.remove_background(movie, p["remove_background"]["method"], p["remove_background"]["wnd"])
    movie = written(movie, "reference")
    if p["estimate_motion"] is not None:
        movie = motion.apply(movie, motion.estimate(movie, **p["estimate_motion"]))
    return written(movie, "corrected")


def candidates(movie: DataFrame, n_frames: int, p: dict) -> DataFrame:
    """Seeds that pass the noise and distribution tests, near ones merged."""
    s, q = p["seeds_init"], p["seeds_merge"]
    found = written(seeds.find(movie, n_frames, s["wnd_size"], s["stp_size"], s["max_wnd"], s["diff_thres"]), "seeds")
    found = seeds.pnr_refine(movie, found, p["pnr_refine"]["noise_freq"], p["pnr_refine"]["thres"])
    found = written(seeds.combined(seeds.ks_refine(movie, found, p["ks_refine"]["sig"]), "mask_ks", "mask_pnr"), "seeds")
    kept = seeds.merge(movie, project.projection(movie), found, q["thres_dist"], q["thres_corr"], q["noise_freq"])
    return written(seeds.combined(kept, "mask_mrg").select("seed_id", *PIXEL), "seeds")


def alternate(movie: DataFrame, state: dict, sn: DataFrame, spatial: dict, temporal: dict, merge: dict | None, shape: tuple[int, int]) -> dict:
    """One round: footprints, background, traces, and, with merge, units merged."""
    A, factors, _ = units.update_spatial(movie, state["A"], state["C"], sn, shape=shape, radius=spatial["dl_wnd"], penalty=spatial["sparse_penal"], size=spatial["size_thres"])
    A = written(A, "A")
    C = written(state["C"].join(factors, "unit_id").select("unit_id", "frame", (F.col("value") * F.col("factor")).alias("value")), "C")
    b, f = (written(x, "bf") for x in units.update_background(movie, A, C))
    yra = written(units.traces(movie, A, b, C, f), "YrA")
    t = written(units.update_temporal(A, yra, freq=temporal["noise_freq"], p=temporal["p"], add_lag=temporal["add_lag"], jaccard=temporal["jac_thres"], penalty=temporal["sparse_penal"]), "temporal")
    A = A.join(t.select("unit_id").distinct(), "unit_id", "left_semi")
    C, more = units.trace_of(t, "c"), {"S": units.trace_of(t, "s"), "b0": units.trace_of(t, "b"), "c0": units.trace_of(t, "c0")}
    if merge:
        whole = t.select("unit_id", "frame", (F.col("c") + F.col("b") + F.col("c0")).alias("value"))
        A, C, sig = units.merge(A, C, merge["thres_corr"], more=(whole,))
        C = sig
    return {"A": written(A, "A"), "C": written(C, "C"), "b": b, "f": f, "YrA": yra, **more}


def run(movie: DataFrame, params: dict | None = None) -> dict[str, DataFrame]:
    """A, C, S, b0, c0, b, f and motion-corrected Y of a raw movie."""
    p = DEFAULTS | (params or {})
    Y = corrected(movie, p)
    ends = Y.agg(*[F.max(c) + 1 for c in ("frame", *PIXEL)]).first()
    n_frames, shape = ends[0], (ends[1], ends[2])
    at = candidates(Y, n_frames, p)
    init = p["initialize"]
    A = written(units.init_footprints(Y, at, init["thres_corr"], init["wnd"], init["noise_freq"]), "A")
    A, C = units.merge(A, written(units.init_traces(Y, A), "C"), p["init_merge"]["thres_corr"])
    state = {"A": written(A, "A"), "C": written(C, "C")}
    sn = written(signal.noise(Y, p["get_noise"]["noise_range"], keys=tuple(PIXEL)), "sn")
    state = alternate(Y, state, sn, p["first_spatial"], p["first_temporal"], p["first_merge"], shape)
    state = alternate(Y, state, sn, p["second_spatial"], p["second_temporal"], None, shape)
    return state | {"Y": Y}


#: What the planted movie is analysed with.
PLANTED = {
    "remove_glow": {"factor": 0.0}, "denoise": {"method": "gaussian", "ksize": 3}, "remove_background": {"method": "tophat", "wnd": 7}, "estimate_motion": {"chunk": 5, "upsample": 10},
    "seeds_init": {"wnd_size": 40, "stp_size": 20, "max_wnd": 6, "diff_thres": 6}, "pnr_refine": {"noise_freq": 0.25, "thres": 1.5}, "ks_refine": {"sig": 0.05},
    "seeds_merge": {"thres_dist": 5, "thres_corr": 0.7, "noise_freq": 0.25}, "initialize": {"thres_corr": 0.6, "wnd": 6, "noise_freq": 0.25}, "init_merge": {"thres_corr": 0.8},
    "get_noise": {"noise_range": (0.25, 0.5)}, "first_spatial": {"dl_wnd": 2, "sparse_penal": 0.01, "size_thres": (5, None)},
    "first_temporal": {"noise_freq": 0.25, "sparse_penal": 1, "p": 1, "add_lag": 10, "jac_thres": 0.2}, "first_merge": {"thres_corr": 0.8},
    "second_spatial": {"dl_wnd": 2, "sparse_penal": 0.01, "size_thres": (5, None)}, "second_temporal": {"noise_freq": 0.25, "sparse_penal": 1, "p": 1, "add_lag": 10, "jac_thres": 0.4},
}
#: What the movie of line items, small, noisy and at rest, is analysed with.
TABLE = PLANTED | {
    "remove_background": {"method": "tophat", "wnd": 5}, "estimate_motion": None, "seeds_init": {"wnd_size": 30, "stp_size": 10, "max_wnd": 4, "diff_thres": 2},
    "pnr_refine": {"noise_freq": 0.25, "thres": 1.0}, "ks_refine": {"sig": 0.5}, "seeds_merge": {"thres_dist": 3, "thres_corr": 0.3, "noise_freq": 0.25},
    "initialize": {"thres_corr": 0.1, "wnd": 3, "noise_freq": 0.25}, "init_merge": {"thres_corr": 0.8},
    "first_spatial": {"dl_wnd": 1, "sparse_penal": 0.01, "size_thres": (1, None)}, "second_spatial": {"dl_wnd": 1, "sparse_penal": 0.01, "size_thres": (1, None)},
}
CENTRES = ((7, 8), (8, 24), (20, 15), (25, 27), (26, 5))


def planted_truth(frames: int = 120, side: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(movie, traces, shifts): round units at CENTRES, always bright, with decaying
    spikes, a glow, noise, and frames moved by whole pixels."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    spikes = rng.random((len(CENTRES), frames)) < 0.05
    traces = np.zeros((len(CENTRES), frames))
    for t in range(frames):
        traces[:, t] = (traces[:, t - 1] * 0.85 if t else 0) + spikes[:, t] * 60
    blobs = np.array([np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 5) for cy, cx in CENTRES])
    glow = 40 * np.exp(-((y - side / 2) ** 2 + (x - side / 2) ** 2) / 400)
    movie = np.einsum("ut,uhw->thw", traces + 30, blobs) + rng.normal(0, 1.5, (frames, side, side))
    shifts = np.zeros((frames, 2), dtype=int)
    shifts[frames // 3 : frames // 2] = (1, 0)
    return np.array([np.roll(f, s, (0, 1)) for f, s in zip(movie, shifts)]) + glow, traces, shifts


def planted(spark: SparkSession) -> DataFrame:
    """The planted movie in long form, made on the executors from its seed."""

    def make(batches):
        for _ in batches:
            movie = planted_truth()[0]
            t, y, x = np.indices(movie.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (t, y, x, movie)], names=["frame", *PIXEL, "value"])

    return spark.range(1).coalesce(1).mapInArrow(make, "frame int, height int, width int, value double")


def run_parts(movie: DataFrame, size: int = 100, params: dict | None = None, parallel: int = 4) -> dict[str, DataFrame]:
    """The analysis of each part of `size` frames (and the next one's first), after a
    common correction: A and C with a leading column part. `parallel` parts are
    analysed at the same time, so that their small steps share the cluster; units of
    different parts aren't matched."""
    p = DEFAULTS | (params or {})
    Y = corrected(movie, p)
    parts = written(project.split_overlap(Y, size), "parts")
    last, out = parts.agg(F.max("part")).first()[0], {}

    def analysed(k: int) -> dict[str, DataFrame]:
        one = parts.where(F.col("part") == k).select((F.col("frame") - k * size).alias("frame"), *PIXEL, "value")
        got = run(one, p | {"remove_glow": {}, "denoise": None, "remove_background": None, "estimate_motion": None})
        named = {name: got[name].withColumn("part", F.lit(k)) for name in ("A", "C")}
        return named | {"C": named["C"].withColumn("frame", F.col("frame") + k * size)}

    with ThreadPoolExecutor(parallel) as pool:
        for got in pool.map(analysed, range(last + 1)):
            for name, var in got.items():
                out[name] = out[name].unionByName(var) if name in out else var
    return out | {"Y": Y}
