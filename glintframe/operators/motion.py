"""Motion of frames, estimated by a tree of chunks, and its correction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions import kernels
from glintframe.operators import PIXEL, VOXEL
from glintframe.operators.frames import map_frames, pictures, to_frames, to_movie
from glintframe.runtime import written

CHUNK = "node long, first array<double>, template array<double>, last array<double>, h int, w int"
MOVES = "node long, child long, coef array<double>, rows int, columns int"


def _moved(im: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return kernels.translate(im, *coef.ravel()) if coef.size == 2 else kernels.warp(im, coef)


def _pair(src: np.ndarray, dst: np.ndarray, upsample: int, mesh: tuple[int, int] | None, steps: int) -> np.ndarray:
    """How src must move to lie on dst."""
    if mesh is None:
        return -kernels.registration(dst, src, upsample).reshape(2, 1, 1)
    return -kernels.elastic_registration(dst, src, mesh, steps)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The lists of a column, as views of its buffer."""
    out = []
    for part in column.chunks:
        ends, values = part.offsets.to_numpy(), part.values.to_numpy()
        out += [values[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], part.is_valid().to_numpy(zero_copy_only=False))]
    return out


def align(stack: list, *, alt_error: float | None, aggregation: str, upsample: int, most: int, round_at: float | None, mesh: tuple[int, int] | None, steps: int, floor: float | None = None) -> tuple[np.ndarray, tuple]:
    """Coefficients that align a chunk, and what stands for it: (first, template, last).

    stack holds (first, template, last) of each child. From the middle good one
    outwards, each child is registered with its neighbour towards the middle, and
    all beyond it move along. A shift that differs from that of the two frames
    next to each other by more than alt_error gives way to it, if that is smaller.
    Children that aren't round enough aren't used as neighbours or in the template.
    """
    n = len(stack)
    view = [t if floor is None else np.where(t > floor, t, 0.0) for _, t, _ in stack]
    good = np.array([round_at is None or kernels.circularity(t, most) > round_at for t in view])
    if not good.any():
        good[:] = True
    at = np.flatnonzero(good)
    middle = at[np.abs(at - n / 2).argmin()]
    first = (2, 1, 1) if mesh is None else (2, mesh[0] + 3, mesh[1] + 3)
    moves = np.zeros((n, *first))
    for i in range(n):
        if i == middle:
            continue
        step = 1 if i < middle else -1
        near = at[at >= i + 1][0] if i < middle else at[at <= i - 1][-1]
        move = _pair(view[i], view[near], upsample, mesh, steps)
        if alt_error and near == i + step and stack[i][0] is not stack[i][1]:
            inner, outer = (stack[i][2], stack[i + 1][0]) if step == 1 else (stack[i][0], stack[i - 1][2])
            other = _pair(inner, outer, upsample, mesh, steps)
            if (np.abs(move - other) > alt_error).any() and np.abs(move).sum() > np.abs(other).sum():
                move = other
        along = slice(i, i + 1) if not good[i] else slice(0, i + 1) if i < middle else slice(i, None)
        moves[along] += move
    moves -= moves.mean((0, *range(2, moves.ndim)), keepdims=True)
    placed = [tuple(_moved(im, moves[i]) for im in stack[i]) for i in at]
    if aggregation not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {aggregation}")
    template = getattr(np.array([p[1] for p in placed]), aggregation)(axis=0)
    return moves, (placed[0][0], template, placed[-1][2])


def estimate(
    movie: DataFrame, *, chunk: int = 3, alt_error: float | None = 5.0, aggregation: str = "mean", upsample: int = 100, most: int = 100, round_at: float | None = None,
    mesh: tuple[int, int] | None = None, steps: int = 100, floor: float | None = None, by: tuple = (),
) -> DataFrame:
    """Motion of a movie: (frame, dy, dx), or with a mesh (frame, coef, rows, columns).

    `chunk` successive frames (later: templates) are aligned at a time, level by
    level, until one is left; a frame's motion is the sum over its levels. Each
    level is one grouped map over images and a table in the shared folder. A movie
    of one frame doesn't move.
    """
    args = dict(alt_error=alt_error, aggregation=aggregation, upsample=upsample, most=most, round_at=round_at, mesh=mesh, steps=steps, floor=floor)
    keys = ", ".join(f"{c} {movie.schema[c].dataType.simpleString()}" for c in by)
    lead = keys + ", " if keys else ""

    def level(table: pa.Table) -> pa.Table:
        table = table.sort_by("child")
        h, w, child = (table.column(c).to_pylist() for c in ("h", "w", "child"))
        first, template, last = (_arrays(table.column(c)) for c in ("first", "template", "last"))
        im = lambda v, i: v[i].reshape(h[i], w[i])
        stack = [(im(template, i),) * 3 if first[i] is None else (im(first, i), im(template, i), im(last, i)) for i in range(len(child))]
        moves, stands = align(stack, **args)
        rest, double = [None] * (len(child) - 1), pa.list_(pa.float64())
        cols = {c: table.column(c) for c in by} | {"node": table.column("node"), "child": table.column("child"), "coef": pa.array([m.ravel() for m in moves], double)}
        cols |= {k: pa.array([v] * len(child), pa.int32()) for k, v in (("rows", moves.shape[2]), ("columns", moves.shape[3]))}
        cols |= {k: pa.array([v.ravel(), *rest], double) for k, v in zip(("first", "template", "last"), stands)}
        cols |= {k: pa.array([v, *rest], pa.int32()) for k, v in zip("hw", stands[1].shape)}
        return pa.table(cols)

    both = f"{lead}{MOVES}, first array<double>, template array<double>, last array<double>, h int, w int"
    frames = to_frames(movie, by)
    none = F.lit(None).cast("array<double>")
    nodes = frames.select(*by, F.col("frame").cast("long").alias("child"), none.alias("first"), F.col("pixels").alias("template"), none.alias("last"), "h", "w")
    levels, count = [], frames.agg(F.max("frame") + 1).first()[0] or 0
    while count > 1 or not levels:
        at = written(nodes.withColumn("node", F.floor(F.col("child") / chunk)).groupBy(*by, "node").applyInArrow(level, both), "motion")
        levels.append(at.select(*by, "node", "child", "coef", "rows", "columns"))
        nodes = at.where("template is not null").select(*by, F.col("node").alias("child"), "first", "template", "last", "h", "w")
        count = -(-count // chunk)
    total = levels[-1].select(*by, "child", "coef", "rows", "columns")
    for below in reversed(levels[:-1]):
        up = total.select(*by, F.col("child").alias("node"), F.col("coef").alias("_up"))
        total = below.join(up, [*by, "node"]).select(*by, "child", F.zip_with("coef", "_up", lambda a, b: a + b).alias("coef"), "rows", "columns")
    frame = F.col("child").cast("int").alias("frame")
    if mesh is not None:
        return total.select(*by, frame, "coef", "rows", "columns")
    return total.select(*by, frame, F.col("coef")[0].alias("dy"), F.col("coef")[1].alias("dx"))


def accumulated(steps: DataFrame, by: tuple = (), block: int = 10_000) -> DataFrame:
    """(by..., frame, dy, dx) of steps from frame to frame: their running sums, less the
    mean over all frames. Sums run within blocks of frames, and over blocks before them."""
    at = steps.withColumn("_b", F.floor(F.col("frame") / block))
    each = at.groupBy(*by, "_b").agg(F.sum("dy").alias("_y"), F.sum("dx").alias("_x"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = each.select(*by, "_b", *[F.coalesce(F.sum(c).over(ahead), F.lit(0.0)).alias(c) for c in ("_y", "_x")])
    own = Window.partitionBy(*by, "_b").orderBy("frame")
    run = at.withColumn("dy", F.sum("dy").over(own)).withColumn("dx", F.sum("dx").over(own)).join(before, [*by, "_b"])
    run = run.select(*by, "frame", (F.col("dy") + F.col("_y")).alias("dy"), (F.col("dx") + F.col("_x")).alias("dx"))
    mean = run.groupBy(*by).agg(F.avg("dy").alias("_y"), F.avg("dx").alias("_x"))
    met = run.join(mean, list(by)) if by else run.crossJoin(F.broadcast(mean))  # one row
    return met.select(*by, "frame", (F.col("dy") - F.col("_y")).alias("dy"), (F.col("dx") - F.col("_x")).alias("dx"))


def mean_image(movie: DataFrame) -> np.ndarray:
    """The mean projection, one image, on the driver."""
    rows = movie.groupBy(*PIXEL).agg(F.avg("value").alias("value")).collect()
    out = np.zeros((max(r.height for r in rows) + 1, max(r.width for r in rows) + 1))
    for y, x, v in rows:
        out[y, x] = v
    return out


def circularities(movie: DataFrame, most: int = 100) -> DataFrame:
    """(frame, circularity): how round the region is in which a frame resembles itself when moved."""

    def run(batches):
        for b in batches:
            out = [kernels.circularity(im, most) for im in pictures(b)]
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array(out, pa.float64())], names=["frame", "circularity"])

    return to_frames(movie).mapInArrow(run, "frame int, circularity double")


def apply_integer(movie: DataFrame, motion: DataFrame, fill: float = 0.0, by: tuple = ()) -> DataFrame:
    """Frames moved by whole pixels (dy, dx): one join by frame, one by place."""
    moved = movie.join(motion, [*by, "frame"]).select(*by, "frame", (F.col("height") + F.col("dy")).cast("int").alias("height"), (F.col("width") + F.col("dx")).cast("int").alias("width"), "value")
    return movie.select(*by, *VOXEL).join(moved, [*by, *VOXEL], "left").select(*by, *VOXEL, F.coalesce("value", F.lit(float(fill))).alias("value"))


def apply(movie: DataFrame, motion: DataFrame, fill: float = 0.0, by: tuple = ()) -> DataFrame:
    """Frames moved by (dy, dx), between pixels linearly, or by a spline field (coef):
    whole frames meet their motion, and are moved as images."""
    elastic = "coef" in motion.columns
    frames = to_frames(movie, by).join(motion, [*by, "frame"])

    def move(im: np.ndarray, r: dict) -> np.ndarray:
        if elastic:
            return kernels.warp(im, np.array(r["coef"]).reshape(2, r["rows"], r["columns"]), fill)
        return kernels.translate(im, r["dy"], r["dx"], fill)

    return to_movie(map_frames(frames, move), by)


def template_motion(movie: DataFrame, template: np.ndarray, most: int = 10, local: bool = False, subpixel: bool = False) -> DataFrame:
    """(frame, dy, dx) by matching each frame with a template."""
    frames = to_frames(movie)

    def run(batches):
        for b in batches:
            out = [kernels.template_shift(im, template, most, local, subpixel) for im in pictures(b)]
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array([float(o[0]) for o in out]), pa.array([float(o[1]) for o in out])], names=["frame", "dy", "dx"])

    return frames.mapInArrow(run, "frame int, dy double, dx double")
