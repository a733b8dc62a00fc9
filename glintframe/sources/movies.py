"""Movies as a Spark data source: spark.read.format("glint_movie"), and the same to write.

Reading plans partitions from files' headers: each is a range of frames of a file.
Filters on frame, height and width are taken over: frames outside are never read, nor
are the rows of pixels outside, where a file's frames are plain grey bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from glintframe.operators import VOXEL
from glintframe.sources import codecs
from glintframe.sources.video import AviFrames, RawFrames, TiffPages, _open

NAME = "glint_movie"
SCHEMA = "frame int, height int, width int, value double"
ENDINGS = {"raw": "raw", "avi": "avi", "tif": "tif", "tiff": "tif"}


def layout_of(options: dict):
    """The layout that options name, or that the files' ending does."""
    kind = options.get("layout") or ENDINGS.get(options["path"].rsplit(".", 1)[-1].lower(), "")
    if kind == "raw":
        return RawFrames(int(options["height"]), int(options["width"]))
    if kind in ("avi", "tif"):
        return AviFrames() if kind == "avi" else TiffPages()
    raise ValueError("option layout: raw (with height and width), avi or tif")


def files_of(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files that match, by the last number in their names."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else []
    name = re.compile(re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + r"\Z")
    number = lambda f: int((re.findall(r"\d+", f.base_name) or ["0"])[-1])
    kept = sorted((f for f in found if f.is_file and f.base_name[0] not in "._" and name.match(f.base_name)), key=lambda f: (number(f), f.path))
    if not kept:
        raise FileNotFoundError(f"no file like {glob} in {path}")
    return [(head + f.path, f.size) for f in kept]


@dataclass
class Frames(InputPartition):
    """Successive frames of one file: (frame, ranges of bytes, h, w, note) each."""

    path: str
    frames: list

    def __init__(self, path: str, frames: list) -> None:
        super().__init__(None)
        self.path, self.frames = path, frames

    def bytes(self) -> int:
        return sum(n for _, ranges, *_ in self.frames for n in ranges[1::2])


class MovieReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.layout = options, layout_of(options)
        self.low = dict.fromkeys(VOXEL, 0)
        self.high = dict.fromkeys(VOXEL, 1 << 31)  # the first one outside
        self.only: set | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Takes over comparisons of frame, height and width with whole numbers."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            whole = isinstance(getattr(f, "value", None), int)
            if name == "frame" and isinstance(f, In) and all(isinstance(v, int) or v is None for v in f.value):
                self.only = {v for v in f.value if v is not None} & (self.only if self.only is not None else {v for v in f.value if v is not None})
            elif name not in VOXEL or not whole:
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high[name], f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo):
                self.low[name], self.high[name] = max(self.low[name], f.value), min(self.high[name], f.value + 1)
            else:
                yield f

    def partitions(self) -> list[Frames]:
        files = files_of(self.options["path"], self.options.get("glob", "*"))

        def spans(file: tuple[str, int]) -> list:
            path, length = file
            with _open(path) as f:
                return list(self.layout.spans(path, lambda at, size: f.read_at(size, at), length))

        with ThreadPoolExecutor(16) as pool:
            known = list(pool.map(spans, files))
        out, first, per = [], 0, int(self.options.get("frames_a_task", 256))
        for (path, _), frames in zip(files, known):
            kept = [(n, *self._rows(*x)) for n, x in enumerate(frames, first) if self.low["frame"] <= n < self.high["frame"] and (self.only is None or n in self.only)]
            out += [Frames(path, kept[k : k + per]) for k in range(0, len(kept), per)]
            first += len(frames)
        return out or [Frames("", [])]

    def _rows(self, ranges: list[int], h: int, w: int, note: str) -> tuple:
        """Of plain grey bytes, only the rows that are wanted."""
        top = 0
        if isinstance(self.layout, RawFrames):
            top, end = min(self.low["height"], h), min(self.high["height"], h)
            at, size = ranges
            ranges, h = [at + top * w, max(min(size, end * w) - top * w, 0)], max(end - top, 0)
        return ranges, h, w, note, top

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        if not part.frames:
            return
        with _open(part.path) as f:
            for n, ranges, h, w, note, top in part.frames:
                raw = b"".join(f.read_at(size, at) for at, size in zip(ranges[::2], ranges[1::2]))
                im = self.layout.picture(raw, h, w, note, ranges[1::2])
                y0, x0 = max(self.low["height"] - top, 0), self.low["width"]
                im = im[y0 : max(self.high["height"] - top, 0), x0 : self.high["width"]]
                y, x = np.indices(im.shape, dtype=np.int32)
                cols = [np.full(im.size, n, dtype=np.int32), (y + (top + y0)).ravel(), (x + x0).ravel(), im.astype(np.float64).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=VOXEL + ["value"])


def avi_file(pictures: list[np.ndarray], fps: float) -> bytes:
    """Grey bytes, top row first (Y800), with an index."""
    h, w = pictures[0].shape
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    avih = struct.pack("<14I", round(1e6 / fps), h * w * round(fps), 0, 0x10, len(pictures), 0, 1, h * w, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"Y800", 0, 0, 0, 0, 1000, round(1000 * fps), 0, len(pictures), h * w, 0xFFFFFFFF, h * w, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"Y800", h * w, 0, 0, 0, 0)
    index, movi, at = b"", [b"movi"], 4
    for im in pictures:
        body = chunk(b"00db", im.tobytes())
        index += struct.pack("<4sIII", b"00db", 0x10, at, h * w)
        movi.append(body)
        at += len(body)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", index))


def tif_file(pictures: list[np.ndarray]) -> bytes:
    """Pages of 16 bits, deflated, as differences along rows."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for im in pictures:
        h, w = im.shape
        rows = np.diff(im.astype("<u2"), axis=1, prepend=np.uint16(0)).astype("<u2")
        data = zlib.compress(rows.tobytes(), 6)
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, codecs.DEFLATE), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (317, 3, 2)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Written(WriterCommitMessage):
    names: list


class MovieWriter(DataSourceArrowWriter):
    """One file for each frames_a_file frames. Tasks write under names of their own in
    <path>/_parts; the commit moves what the tasks that count have written, and a
    job that fails leaves no file."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.kind = options.get("layout", "avi")
        if self.kind not in ("avi", "tif", "raw"):
            raise ValueError("option layout: raw, avi or tif")

    def _store(self):
        from pyarrow import fs

        path = self.options["path"].rstrip("/")
        return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        store.create_dir(f"{root}/_parts", recursive=True)
        per, names = int(self.options.get("frames_a_file", 256)), []
        kind = np.dtype("<u2") if self.kind == "tif" else np.dtype("u1")
        pictures, cells, now = [], [], None  # of this file; of this frame; the frame

        def close_frame() -> None:
            if now is not None:
                y, x, v = (np.concatenate(c) for c in zip(*cells))
                im = np.zeros((y.max() + 1, x.max() + 1), dtype=kind)
                im[y, x] = np.clip(np.rint(v), 0, np.iinfo(kind).max)
                pictures.append(im)
                cells.clear()

        def close_file() -> None:
            if pictures:
                if len({im.shape for im in pictures}) > 1:
                    raise ValueError("frames of different sizes")
                name = f"{uuid.uuid4().hex}.{self.kind}"
                body = avi_file(pictures, float(self.options.get("fps", 30))) if self.kind == "avi" else tif_file(pictures) if self.kind == "tif" else b"".join(im.tobytes() for im in pictures)
                with store.open_output_stream(f"{root}/_parts/{name}", compression=None) as f:
                    f.write(body)
                names.append((name, now // per))
                pictures.clear()

        for b in batches:
            frame, y, x, v = (b.column(c).to_numpy() for c in ("frame", "height", "width", "value"))
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(frame)) + 1) if len(frame) else []:
                n = int(frame[at[0]])
                if n != now:
                    close_frame()
                    if now is not None and n // per != now // per:
                        close_file()
                    now = n
                cells.append((y[at], x[at], v[at]))
        close_frame()
        close_file()
        return Written(names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = self._store()
        ready = [x for m in messages if m for x in m.names]
        if len({k for _, k in ready}) < len(ready):
            self.abort(messages)
            raise ValueError("a file's frames came from several tasks: deal them by file, as write_movie does")
        there = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(root)
        for f in there:
            store.delete_file(f.path)
        for name, k in ready:
            store.move(f"{root}/_parts/{name}", f"{root}/movie{k:06d}.{self.kind}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(f"{root}/_parts").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_parts")


class MovieSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MovieReader:
        return MovieReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MovieWriter:
        return MovieWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(MovieSource)


def read_movie(spark: SparkSession, path: str, **options) -> DataFrame:
    """(frame, height, width, value) of a file, or of a folder's files in natural order.
    Options: layout (raw, avi, tif; else by the file's ending), height and width (of
    raw frames), glob, frames_a_task. Grey values; colour AVI becomes its luma."""
    register(spark)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_movie(movie: DataFrame, path: str, layout: str = "avi", overwrite: bool = False, frames_a_file: int = 256, fps: float = 30.0) -> None:
    """Write a movie's frames, counted from 0 and without gaps, to files of frames_a_file
    frames: grey bytes (raw, avi) or 16-bit pages (tif); values are rounded and cut to
    what these hold. A file's frames are dealt to one task, which holds one file's
    pictures at a time."""
    spark = movie.sparkSession
    register(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = movie.select(*[F.col(c).cast("int").alias(c) for c in VOXEL], F.col("value").cast("double").alias("value")).repartition(n, F.floor(F.col("frame") / frames_a_file)).sortWithinPartitions(*VOXEL)
    dealt.write.format(NAME).options(layout=layout, frames_a_file=str(frames_a_file), fps=str(fps)).mode("overwrite" if overwrite else "append").save(path)
