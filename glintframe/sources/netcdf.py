"""netCDF export: one classic file (64-bit offsets), its slabs written by tasks."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "glint_netcdf"
# Fixed values of the netCDF classic format: tags of lists, and types with their bytes.
DIMENSIONS, VARIABLES, ATTRIBUTES, ABSENT = 10, 11, 12, b"\0" * 8
TYPES = {"i4": (4, ">i4"), "f4": (5, ">f4"), "f8": (6, ">f8")}


def local_path(path: str) -> str:
    """A place in a file system that every node has mounted: slabs are written inside one
    file, which stores of whole objects don't allow."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: netCDF needs a mounted folder that driver and executors share")
    return unquote(url.path) if url.scheme else path


def header(name: str, dims: dict[str, np.ndarray], kind: str, attributes: dict[str, str]) -> tuple[bytes, int]:
    """A file's beginning, coordinates and all, and the offset at which the variable starts, the last one."""
    word = lambda x: struct.pack(">I", x)
    text = lambda x: word(len(x.encode())) + x.encode() + b"\0" * (-len(x.encode()) % 4)
    attrs = (word(ATTRIBUTES) + word(len(attributes)) + b"".join(text(k) + word(2) + text(v) for k, v in attributes.items())) if attributes else ABSENT
    values = {k: np.asarray(v, dtype=">i4" if np.issubdtype(v.dtype, np.integer) and (not len(v) or np.abs(v).max() < 1 << 31) else ">f8") for k, v in dims.items()}
    size = TYPES[kind][0] and np.dtype(TYPES[kind][1]).itemsize
    whole = int(np.prod([len(v) for v in dims.values()])) * size

    def built(first: int) -> tuple[bytes, int]:
        out = b"CDF\x02" + word(0) + word(DIMENSIONS) + word(len(dims)) + b"".join(text(k) + word(len(v)) for k, v in dims.items()) + attrs + word(VARIABLES) + word(len(dims) + 1)
        at = first
        for i, (k, v) in enumerate(values.items()):
            out += text(k) + word(1) + word(i) + ABSENT + word(4 if v.dtype.kind == "i" else 6) + word(-(-v.nbytes // 4) * 4) + struct.pack(">Q", at)
            at += -(-v.nbytes // 4) * 4
        out += text(name) + word(len(dims)) + b"".join(word(i) for i in range(len(dims))) + ABSENT + word(TYPES[kind][0]) + word(min(-(-whole // 4) * 4, 0xFFFFFFFF)) + struct.pack(">Q", at)
        return out, at

    first = len(built(0)[0])
    out, at = built(first)
    return out + b"".join(v.tobytes() + b"\0" * (-v.nbytes % 4) for v in values.values()), at


class NetcdfWriter(DataSourceArrowWriter):
    """Writes rows (_slab, dimensions..., value), a slab's rows in succession, at their place
    in a file that lies beside the one to come. A slab that is written again is the
    same; the commit gives the file its name, a job that fails removes it."""

    def __init__(self, options: dict) -> None:
        self.path, self.begin, self.per = options["target"], int(options["begin"]), int(options["slab"])
        self.kind, self.dims = np.dtype(TYPES[options["type"]][1]), {k: np.array(v) for k, v in json.loads(options["dims"]).items()}

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        shape = [len(v) for v in self.dims.values()]
        step = int(np.prod(shape[1:]))
        now, cells = None, None

        def put(f) -> None:
            if now is not None:
                f.seek(self.begin + now * self.per * step * self.kind.itemsize)
                f.write(cells.tobytes())

        with open(f"{self.path}.part", "r+b") as f:
            for b in batches:
                slab = b.column("_slab").to_numpy()
                for at in np.split(np.arange(len(slab)), np.flatnonzero(np.diff(slab)) + 1) if len(slab) else []:
                    if slab[at[0]] != now:
                        put(f)
                        now = int(slab[at[0]])
                        cells = np.full(min(self.per, shape[0] - now * self.per) * step, np.nan if self.kind.kind == "f" else 0, dtype=self.kind)
                    part = b.take(pa.array(at))
                    part = part.filter(part.column(list(self.dims)[0]).is_valid())
                    place = 0
                    for k, (name, values) in enumerate(self.dims.items()):
                        place = place * shape[k] + np.searchsorted(values, part.column(name).to_numpy())
                    cells[place - now * self.per * step] = part.column("value").to_numpy(zero_copy_only=False)
            put(f)
            f.flush()
            os.fsync(f.fileno())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        os.replace(f"{self.path}.part", self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(f"{self.path}.part"):
            os.remove(f"{self.path}.part")


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(dict(self.options))


def write_netcdf(
    var: DataFrame, path: str, dims: tuple[str, ...] = ("frame", "height", "width"), name: str = "value", kind: str = "f8", attributes: dict[str, str] | None = None, slab: int = 64, overwrite: bool = False,
) -> None:
    """Write var(dims..., value) to one netCDF file: the variable `name` over its dimensions,
    whose sorted values become coordinates. Absent places are NaN; of places told twice
    one counts. kind: f8, f4 or i4.

    The header says where everything lies; tasks then write slabs of so many values of
    the first dimension at their offsets, each slab held as one array. The driver holds the
    dimensions' values, not the variable. Dimensions are numbers; an empty table gives
    a file without values. Until all tasks are done the file has another name; a job that
    fails leaves none."""
    spark, to = var.sparkSession, local_path(path)
    if os.path.exists(to) and not overwrite:
        raise FileExistsError(to)
    values = {}
    for d in dims:
        got = [r[0] for r in var.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).collect()]
        values[d] = np.array(got, dtype=np.float64 if any(isinstance(v, float) for v in got) else np.int64)
    head, begin = header(name, values, kind, attributes or {})
    whole = int(np.prod([len(v) for v in values.values()])) * np.dtype(TYPES[kind][1]).itemsize
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    with open(f"{to}.part", "wb") as f:
        f.write(head)
        f.truncate(begin + -(-whole // 4) * 4)
    spark.dataSource.register(NetcdfSource)
    first = F.array_position(F.lit(values[dims[0]].tolist()).cast(f"array<{var.schema[dims[0]].dataType.simpleString()}>"), F.col(dims[0])) - 1
    rows = var.where(" and ".join(f"`{d}` is not null" for d in dims)).select(F.floor(first / slab).alias("_slab"), *dims, F.col("value").cast("double").alias("value"))
    every = spark.range(-(-len(values[dims[0]]) // slab)).select(F.col("id").alias("_slab"), *[F.lit(None).cast(var.schema[d].dataType).alias(d) for d in dims], F.lit(None).cast("double").alias("value"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    options = {"target": to, "begin": str(begin), "slab": str(slab), "type": kind, "dims": json.dumps({k: v.tolist() for k, v in values.items()})}
    try:
        rows.unionByName(every).repartition(n, "_slab").sortWithinPartitions("_slab").write.format(NAME).options(**options).mode("append").save()
    finally:  # a job may fail before its writers begin
        if os.path.exists(f"{to}.part"):
            os.remove(f"{to}.part")
