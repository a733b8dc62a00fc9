"""Neighbours, correlations along edges, and groups of a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions import kernels
from glintframe.operators import PIXEL
from glintframe.runtime import connected


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(src, dst, distance) of points(id, height, width) at most `radius` apart, a
    point and itself left out. Points meet by square cells of that size: left ones
    are looked up in their cell and the eight around it, an equi-join."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("height") + i).alias("cy"), (cell("width") + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.select(F.col("id").alias("src"), F.col("height").alias("_ah"), F.col("width").alias("_aw"), around.alias("_c")).select("*", "_c.cy", "_c.cx")
    b = right.select(F.col("id").alias("dst"), F.col("height").alias("_bh"), F.col("width").alias("_bw"), cell("height").alias("cy"), cell("width").alias("cx"))
    square = (F.col("_ah") - F.col("_bh")) ** 2 + (F.col("_aw") - F.col("_bw")) ** 2
    met = a.join(b, ["cy", "cx"]).withColumn("_d", square)
    return met.where((F.col("_d") <= radius * radius) & ((F.col("_ah") != F.col("_bh")) | (F.col("_aw") != F.col("_bw")))).select("src", "dst", F.sqrt("_d").alias("distance"))


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Each unordered pair once, src being the smaller id."""
    return near_pairs(points, points, radius).where("src < dst")


def unit_length(rows: DataFrame) -> DataFrame:
    """rows(..., trace) with each trace centred and of length 1, or all 0 if it doesn't
    vary; done once per trace, so that an edge's correlation is one scalar product."""
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = rows.withColumn("_mean", plus(F.col("trace")) / F.size("trace")).withColumn("trace", F.transform("trace", lambda v: v - F.col("_mean")))
    centred = centred.withColumn("_size", F.sqrt(plus(F.transform("trace", lambda v: v * v))))
    flat = F.col("_size") <= 1e-12 * F.abs("_mean") * F.sqrt(F.size("trace"))
    return centred.withColumn("trace", F.transform("trace", lambda v: F.when(flat | (F.col("_size") == 0), F.lit(0.0)).otherwise(v / F.col("_size")))).drop("_mean", "_size")


def tiles(points: DataFrame, side: int = 24) -> DataFrame:
    """(id, part) of points(id, height, width): square tiles of the picture, so that of
    pixels a part has side * side at most, and most near pairs lie within one."""
    return points.select("id", (F.floor(F.col("height") / side) * (1 << 24) + F.floor(F.col("width") / side)).cast("long").alias("part"))


def members(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(part, id, others): which traces each part of the graph edges(src, dst) needs. An
    edge belongs to the part of its dst, whose row lists the srcs as `others`; nodes
    of other parts on its edges are its halo, with an empty list. A node is there
    once for each part, however many edges it has there. Without parts, every dst is
    one. (Of a hub's edges, let it be src, and each part has a few.)"""
    if parts is None:
        home = edges.select("src", "dst", F.col("dst").alias("part"))
    else:
        home = edges.select("src", "dst").join(parts.select(F.col("id").alias("dst"), "part"), "dst")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("src").alias("other")), F.struct(F.col("src").alias("id"), F.lit(None).cast("long").alias("other")))).alias("e")
    return home.select("part", ends).groupBy("part", "e.id").agg(F.collect_list("e.other").alias("others"))


def edge_products(edges: DataFrame, rows: DataFrame, parts: DataFrame | None = None, frames: int = 1000) -> DataFrame:
    """(src, dst, dot): scalar products of the traces of rows(id, trace), all of one
    length, along distinct edges(src, dst); ids are long numbers.

    The graph goes by parts: a trace moves once to every part that needs it, and
    there, `frames` frames at a time, meets its neighbours in one matrix product.
    What a task holds are one part's traces, with its halo, in these frames.
    """
    k = F.sequence(F.lit(0).cast("long"), F.floor((F.size("trace") - 1) / frames))
    block = F.explode(F.transform(k, lambda i: F.struct(i.alias("block"), F.slice("trace", (i * frames + 1).cast("int"), F.lit(frames)).alias("x")))).alias("b")
    met = members(edges, parts).join(rows.select("id", "trace"), "id").select("part", "id", "others", block).select("part", "id", "others", "b.block", "b.x")

    def multiply(group: pa.Table) -> pa.Table:
        ids, n = group.column("id").to_numpy(), len(group)
        x = np.zeros((n, max(len(v) for v in group.column("x"))))
        for i, v in enumerate(group.column("x")):
            x[i, : len(v)] = v.values.to_numpy()
        others = group.column("others").combine_chunks()
        many = np.diff(others.offsets.to_numpy())
        order = np.argsort(ids, kind="stable")
        at = order[np.searchsorted(ids, others.flatten().to_numpy(), sorter=order)]
        own = np.repeat(np.arange(n), many)
        home = np.flatnonzero(many)
        dots = (x[home] @ x.T)[np.searchsorted(home, own), at]
        return pa.table({"src": ids[at], "dst": ids[own], "dot": dots})

    parts_ = met.groupBy("part", "block").applyInArrow(multiply, "src long, dst long, dot double")
    return parts_.groupBy("src", "dst").agg(F.sum("dot").alias("dot"))


def edge_correlation(edges: DataFrame, rows: DataFrame, points: DataFrame | None = None, side: int = 24) -> DataFrame:
    """Distinct edges(src, dst, ...) with corr, of rows(id, trace); only pairs that are
    edges are looked at. 0 where either trace doesn't vary. With points(id, height,
    width), traces move by tiles of the picture (see edge_products)."""
    got = edge_products(edges, unit_length(rows), None if points is None else tiles(points, side)).withColumnRenamed("dot", "corr")
    return got if edges.columns == ["src", "dst"] else edges.join(got, ["src", "dst"])


def labels(nodes: DataFrame, edges: DataFrame, only_connected: bool = False) -> DataFrame:
    """(id, label): groups of the graph over nodes(id), numbered by their smallest id.
    With only_connected, nodes without an edge are labelled -1, though they count."""
    groups = connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    full = nodes.select("id").distinct().join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNull().alias("alone"))
    number = full.select("component").distinct().withColumn("label", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))  # one row per group
    label = F.when(F.col("alone"), F.lit(-1)).otherwise(F.col("label")) if only_connected else F.col("label")
    return full.join(number, "component").select("id", label.cast("int").alias("label"))


def region_labels(mask: DataFrame, by: tuple = ("frame",), diagonal: bool = False) -> DataFrame:
    """(by..., height, width, label): the regions of each image of mask(by..., height,
    width), touching by sides (or also corners), numbered from 1 in order of their
    first pixels. A region lies in one image, so that one grouped map finds them all."""
    rows = mask.select(*by, *PIXEL)
    schema = rows.select("*", F.lit(1).cast("int").alias("label")).schema

    def run(image: pa.Table) -> pa.Table:
        image = image.sort_by([(c, "ascending") for c in PIXEL])
        found = kernels.label_pixels(image.column("height").to_pylist(), image.column("width").to_pylist(), diagonal)
        return image.append_column("label", pa.array(found, pa.int32()))

    return rows.groupBy(*by).applyInArrow(run, schema)


def contours(mask: DataFrame, by: tuple = ("frame",)) -> DataFrame:
    """(by..., contour, hole, place, height, width): the borders of the regions of each image
    of mask(by..., height, width), outer ones and those of holes, each as its pixels in
    order. Regions also touch by corners; what is beyond an image counts as empty. Contours
    are numbered from 0 in the order in which a scan by rows meets them, see
    kernels.borders; an image is one group, as a border may run all over it."""
    rows = mask.select(*by, *PIXEL)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)

    def run(image: pa.Table) -> pa.Table:
        at = np.stack([image.column(c).to_numpy() for c in PIXEL])
        low = at.min(axis=1)
        cells = np.zeros(at.max(axis=1) - low + 1, dtype=bool)
        cells[tuple(at - low[:, None])] = True
        found = kernels.borders(cells)
        many = [len(p) for _, p in found]
        place = np.array([x for _, p in found for x in p]) + low
        cols = [np.repeat(np.arange(len(found), dtype=np.int32), many), np.repeat([h for h, _ in found], many), np.concatenate([np.arange(n, dtype=np.int32) for n in many]), *place.T.astype(np.int32)]
        own = [pa.array([image.column(c)[0].as_py()] * sum(many), image.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*own, *map(pa.array, cols)], names=[*by, "contour", "hole", "place", *PIXEL])

    return rows.groupBy(*by).applyInArrow(run, f"{kinds}{', ' if by else ''}contour int, hole boolean, place int, height int, width int")


def region_centres(mask: DataFrame, by: tuple = ("frame",)) -> DataFrame:
    """One pixel for each 8-connected region of mask(by..., height, width): whole
    parts of the medians of its rows and columns."""
    half = lambda c: F.floor(F.percentile(c, F.lit(0.5))).cast("int").alias(c)
    return region_labels(mask, by, True).groupBy(*by, "label").agg(half("height"), half("width")).drop("label")
