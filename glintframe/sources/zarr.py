"""Zarr arrays (version 2) as a Spark data source: spark.read.format("glint_zarr").

Partitions are runs of chunks; filters on dimensions leave out the chunks, and then the
rows, that lie outside, before anything is read.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "glint_zarr"


def _load(path: str, name: str) -> bytes | None:
    """A file of a store; None where there is none."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    try:
        with store.open_input_file(f"{at.rstrip('/')}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def unpacker(compressor: dict | None):
    """bytes -> bytes; zlib, gzip and zstandard are known."""
    name = (compressor or {}).get("id")
    if name is None:
        return bytes
    if name in ("zlib", "gzip"):
        return zlib.decompress if name == "zlib" else gzip.decompress
    if name == "zstd":
        import zstandard

        return lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compressor {name}")


class Array:
    """One array's metadata, and its chunks."""

    def __init__(self, path: str) -> None:
        raw = _load(path, ".zarray")
        if raw is None:
            raise FileNotFoundError(f"no array in {path}")
        meta = json.loads(raw)
        if meta["zarr_format"] != 2 or meta.get("filters"):
            raise ValueError(f"{path}: version {meta['zarr_format']}, or filters")
        self.path, self.shape, self.chunks, self.order = path, tuple(meta["shape"]), tuple(meta["chunks"]), meta.get("order", "C")
        self.kind, self.unpack, self.join = np.dtype(meta["dtype"]), unpacker(meta.get("compressor")), meta.get("dimension_separator", ".")
        fill = meta.get("fill_value")
        self.fill = 0 if fill is None else float(fill.replace("Infinity", "inf")) if isinstance(fill, str) else fill
        self.dims = tuple(json.loads(_load(path, ".zattrs") or b"{}").get("_ARRAY_DIMENSIONS", [f"dim_{k}" for k in range(len(self.shape))]))

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """A chunk, of full size; one that isn't stored is of fill values."""
        raw = _load(self.path, self.join.join(map(str, at)) or "0")
        if raw is None:
            return np.full(self.chunks, self.fill, dtype=self.kind)
        return np.frombuffer(self.unpack(raw), dtype=self.kind).reshape(self.chunks, order=self.order)

    def whole(self) -> np.ndarray:
        """A small array, as a coordinate is, at once."""
        out = np.empty(self.shape, dtype=self.kind)
        for at in product(*(range(-(-n // c)) for n, c in zip(self.shape, self.chunks))):
            place = tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, self.chunks))
            out[place] = self.chunk(at)[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(at, self.chunks, self.shape))]
        return out


@dataclass
class Chunks(InputPartition):
    """Some chunks of the grid."""

    at: list

    def __init__(self, at: list) -> None:
        super().__init__(None)
        self.at = at


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.array = options, Array(options["path"])
        self.coords = coordinates(self.array)
        self.keep = [np.ones(n, dtype=bool) for n in self.array.shape]

    def pushFilters(self, filters: list) -> Iterator:
        """Takes over comparisons of dimensions with numbers."""
        ops = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            k = self.array.dims.index(name) if name in self.array.dims else None
            value = getattr(f, "value", None)
            if k is not None and type(f) in ops and isinstance(value, (int, float)) and not isinstance(value, bool):
                self.keep[k] &= ops[type(f)](self.coords[k], value)
            elif k is not None and isinstance(f, In) and all(v is None or isinstance(v, (int, float)) for v in value):
                self.keep[k] &= np.isin(self.coords[k], [v for v in value if v is not None])
            else:
                yield f

    def partitions(self) -> list[Chunks]:
        per = int(self.options.get("chunks_a_task", 16))
        wanted = [np.unique(np.flatnonzero(keep) // c).tolist() for keep, c in zip(self.keep, self.array.chunks)]
        grid = list(product(*wanted))
        return [Chunks(grid[k : k + per]) for k in range(0, len(grid), per)] or [Chunks([])]

    def read(self, part: Chunks) -> Iterator[pa.RecordBatch]:
        a = self.array
        for at in part.at:
            own = [np.flatnonzero(keep[k * c : min((k + 1) * c, n)]) for keep, k, c, n in zip(self.keep, at, a.chunks, a.shape)]
            cells = a.chunk(at)[np.ix_(*own)] if own else a.chunk(at)
            axes = np.meshgrid(*(v[k * c + o] for v, k, c, o in zip(self.coords, at, a.chunks, own)), indexing="ij")
            cols = [*(x.ravel() for x in axes), cells.astype(np.float64).ravel()]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*a.dims, "value"])
            for k in range(0, whole.num_rows, 100_000):
                yield whole.slice(k, 100_000)


def coordinates(a: Array) -> list[np.ndarray]:
    """Each dimension's coordinate, from the array beside that has its name, or its places."""
    out = []
    for name, n in zip(a.dims, a.shape):
        beside = f"{a.path.rstrip('/').rsplit('/', 1)[0]}/{name}"
        values = Array(beside).whole() if _load(beside, ".zarray") is not None else None
        if values is None or values.shape != (n,) or values.dtype.kind not in "iuf":
            values = np.arange(n)
        whole = values.dtype.kind in "iu"
        out.append(values.astype(np.int32 if whole and (not n or np.abs(values.astype(np.int64)).max() < 1 << 31) else np.int64 if whole else np.float64))
    return out


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        a = Array(self.options["path"])
        kinds = {"int32": "int", "int64": "long", "float64": "double"}
        return ", ".join(f"`{d}` {kinds[str(v.dtype)]}" for d, v in zip(a.dims, coordinates(a))) + (", " if a.dims else "") + "value double"

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(dict(self.options))


def read_zarr(spark: SparkSession, path: str, chunks_a_task: int = 16) -> DataFrame:
    """(dimensions..., value) of the array in a folder: dimensions by the names that the store
    tells (_ARRAY_DIMENSIONS; else dim_0 and so on), with the values of arrays of these
    names beside it, or places from 0. Chunks that aren't stored have the fill value."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(ZarrSource)
    return spark.read.format(NAME).option("chunks_a_task", str(chunks_a_task)).load(path)
