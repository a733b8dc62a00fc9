"""An analysis step by step, each step's parameters kept, with a look at single frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import PIXEL, graph, motion, project, seeds, signal, stencil, units
from glintframe.runtime import written
from glintframe.sources import params as tables


class Session:
    """Holds the current movie `Y`, and, as steps make them, `seeds`, `A`, `C`, `b`, `f`,
    `sn` and `temporal`. Steps are named and parametrised as in parameter tables."""

    def __init__(self, movie: DataFrame) -> None:
        self.state: dict[str, DataFrame] = {"Y": movie}
        self.params: dict[str, dict] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.state[name]

    def step(self, name: str, **p) -> Session:
        """Run a step on what there is; its results take the place of earlier ones."""
        run = getattr(self, f"_{tables.ALIASES.get(name, name)}", None)
        if run is None:
            raise ValueError(f"unknown step {name}")
        self.state |= {k: written(v, k) for k, v in run(**p).items() if v is not None}
        self.params[name] = p
        return self

    def preview(self, name: str, frame: int, **p) -> DataFrame:
        """A frame-local step on one frame of the movie; nothing is kept."""
        one = self["Y"].where(F.col("frame") == frame)
        if name == "denoise":
            return stencil.denoise(one, p.get("method", "gaussian"), p.get("ksize", 5))
        if name in ("remove_background", "background_removal"):
            return stencil.preview_background(one, p.get("method", "uniform"), p.get("wnd", 5))
        if name == "seeds_init":
            return seeds.find_in_frame(one.drop("frame"), p.get("max_wnd", 10), p.get("diff_thres", 2))
        if name == "contours":
            return graph.contours(stencil.edge_mask(one).where("edge"))
        raise ValueError(f"no preview of {name}")

    def save_params(self, path: str) -> None:
        tables.write(self.params, path, self["Y"].sparkSession)

    def run(self, params: dict[str, dict]) -> Session:
        """All steps of a parameter table that this session knows, in its order."""
        for name, p in params.items():
            if hasattr(self, f"_{tables.ALIASES.get(name, name)}"):
                self.step(name, **p)
        return self

    def _remove_glow(self, deglow: bool = True, factor: float = 0.7) -> dict:
        return {"Y": project.deglow(self["Y"], factor)} if deglow else {}

    def _denoise(self, method: str = "gaussian", ksize: int = 5) -> dict:
        return {"Y": stencil.denoise(self["Y"], method, ksize)}

    def _remove_background(self, method: str = "uniform", wnd: int = 5) -> dict:
        return {"Y": stencil.remove_background(self["Y"], method, wnd)}

    def _estimate_motion(self, dim: str = "frame", **p) -> dict:
        return {"Y": motion.apply(self["Y"], motion.estimate(self["Y"], **p))}

    def _seeds_init(self, wnd_size: int = 500, method: str = "rolling", stp_size: int = 200, max_wnd: int = 10, diff_thres: float = 2) -> dict:
        n = self["Y"].agg(F.max("frame") + 1).first()[0]
        return {"seeds": seeds.find(self["Y"], n, wnd_size, stp_size, max_wnd, diff_thres, method)}

    def _pnr_refine(self, noise_freq: float = 0.25, thres: float | str = 1.5) -> dict:
        return {"seeds": seeds.pnr_refine(self["Y"], self["seeds"], noise_freq, thres)}

    def _ks_refine(self, sig: float = 0.01) -> dict:
        return {"seeds": seeds.ks_refine(self["Y"], self["seeds"], sig)}

    def _seeds_merge(self, thres_dist: float = 5, thres_corr: float = 0.6, noise_freq: float | None = None) -> dict:
        s = self["seeds"]
        s = seeds.combined(s, *[m for m in ("mask_pnr", "mask_ks") if m in s.columns])
        kept = seeds.merge(self["Y"], project.projection(self["Y"]), s, thres_dist, thres_corr, noise_freq)
        return {"seeds": seeds.combined(kept, "mask_mrg").select("seed_id", *PIXEL)}

    def _initialize(self, thres_corr: float = 0.8, wnd: float = 10, noise_freq: float | None = None) -> dict:
        A = written(units.init_footprints(self["Y"], self["seeds"], thres_corr, wnd, noise_freq), "A")
        C = written(units.init_traces(self["Y"], A), "C")
        b, f = units.update_background(self["Y"], A, C)
        return {"A": A, "C": C, "b": b, "f": f}

    def _init_merge(self, thres_corr: float = 0.9) -> dict:
        return dict(zip("AC", units.merge(self["A"], self["C"], thres_corr)))

    _first_merge = _init_merge

    def _get_noise(self, noise_range: tuple = (0.06, 0.5), noise_method: str = "logmexp") -> dict:
        return {"sn": signal.noise(self["Y"], noise_range, noise_method, keys=tuple(PIXEL))}

    def _first_spatial(self, dl_wnd: int = 5, sparse_penal: float = 0.5, size_thres: tuple = (9, None)) -> dict:
        ends = self["Y"].agg(F.max("height") + 1, F.max("width") + 1).first()
        A, factors, _ = units.update_spatial(self["Y"], self["A"], self["C"], self["sn"], shape=tuple(ends), radius=dl_wnd, penalty=sparse_penal, size=size_thres)
        A = written(A, "A")
        C = written(self["C"].join(factors, "unit_id").select("unit_id", "frame", (F.col("value") * F.col("factor")).alias("value")), "C")
        b, f = units.update_background(self["Y"], A, C)
        return {"A": A, "C": C, "b": b, "f": f}

    _second_spatial = _first_spatial

    def _first_temporal(self, noise_freq: float = 0.25, sparse_penal: float = 1, p: int = 1, add_lag: int | str = "p", jac_thres: float = 0.1) -> dict:
        yra = written(units.traces(self["Y"], self["A"], self["b"], self["C"], self["f"]), "YrA")
        t = written(units.update_temporal(self["A"], yra, freq=noise_freq, p=p, add_lag=add_lag, jaccard=jac_thres, penalty=sparse_penal), "temporal")
        return {"temporal": t, "C": units.trace_of(t, "c"), "A": self["A"].join(t.select("unit_id").distinct(), "unit_id", "left_semi")}

    _second_temporal = _first_temporal
