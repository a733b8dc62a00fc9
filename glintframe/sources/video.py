"""Frames from files of raw grey video, grey TIFF pages, plain or Motion-JPEG AVI, or decoded frames.

A layout tells where a file's frames lie, from headers alone, and makes a picture of
a frame's bytes: so frames, and not files, are dealt to tasks, whatever a file's size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.functions.expr import file_number
from glintframe.operators import project
from glintframe.runtime import written
from glintframe.sources import codecs

FRAMES = "path string, n int, h int, w int, pixels array<double>"
SPANS = "path string, n int, ranges array<long>, h int, w int, note string"
Read = Callable[[int, int], bytes]  # (offset, size) -> bytes


class RawFrames:
    """Files that are frames of h x w grey bytes, one after the other; what is left of
    a broken last frame is 0."""

    def __init__(self, h: int, w: int) -> None:
        self.h, self.w = h, w

    def spans(self, path: str, read: Read, length: int) -> Iterator[tuple[list[int], int, int, str]]:
        size = self.h * self.w
        for at in range(0, length, size):
            yield [at, min(size, length - at)], self.h, self.w, ""

    def picture(self, raw: bytes, h: int, w: int, note: str, sizes: list[int]) -> np.ndarray:
        return np.frombuffer(raw.ljust(h * w, b"\0"), dtype=np.uint8).reshape(h, w)


class TiffPages:
    """Pages of a grey TIFF of 8 or 16 bits, in strips or tiles, plain or compressed by
    LZW, PackBits or deflate, with or without differences along rows."""

    def spans(self, path: str, read: Read, length: int) -> Iterator[tuple[list[int], int, int, str]]:
        order = {b"II": "<", b"MM": ">"}[read(0, 2)]
        at = struct.unpack(order + "I", read(4, 4))[0]
        sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
        while at:
            count = struct.unpack(order + "H", read(at, 2))[0]
            entries = read(at + 2, 12 * count + 4)
            tags: dict[int, tuple] = {}
            for k in range(count):
                tag, kind, n, _ = struct.unpack_from(order + "HHII", entries, 12 * k)
                if kind not in sizes:
                    continue
                code, size = sizes[kind]
                raw = entries[12 * k + 8 : 12 * k + 8 + n * size]
                if n * size > 4:
                    raw = read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], n * size)
                tags[tag] = struct.unpack_from(f"{order}{n}{code}", raw)
            bits = tags.get(258, (8,))[0]
            if tags.get(277, (1,))[0] != 1 or bits not in (8, 16):
                raise ValueError(f"{path}: pages that aren't grey, of 8 or 16 bits")
            h, w = tags[257][0], tags[256][0]
            at_, many = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
            bh, bw = (tags[323][0], tags[322][0]) if 324 in tags else (min(tags.get(278, (h,))[0], h), w)
            note = f"{order}{ {8: 'u1', 16: 'u2'}[bits]} {tags.get(259, (1,))[0]} {tags.get(317, (1,))[0]} {bh} {bw} {int(324 in tags)}"
            yield [x for pair in zip(at_, many) for x in pair], h, w, note
            at = struct.unpack_from(order + "I", entries, 12 * count)[0]

    def picture(self, raw: bytes, h: int, w: int, note: str, sizes: list[int]) -> np.ndarray:
        """sizes: the bytes of each strip or tile."""
        kind, scheme, predictor, bh, bw, tiled = note.split()
        bh, bw = int(bh), int(bw)
        out, across, at = np.zeros((h, w), dtype=np.dtype(kind).newbyteorder("=")), -(-w // bw), 0
        for k, size in enumerate(sizes):
            y, x = k // across * bh, k % across * bw
            rows = bh if tiled == "1" else min(bh, h - y)
            im = codecs.block(raw[at : at + size], int(scheme), predictor == "2", rows, bw, kind)
            out[y : y + bh, x : x + bw] = im[: h - y, : w - x]
            at += size
        return out


class AviFrames:
    """Frames of an AVI of 8-bit grey or 24-bit colour pictures, or Motion-JPEG ones;
    colour becomes grey by its luma. Frames are found by the file's index, where it
    has one. Other codecs need a decoder of one's own for load()."""

    def spans(self, path: str, read: Read, length: int) -> Iterator[tuple[list[int], int, int, str]]:
        head = read(0, 12)
        if head[:4] != b"RIFF" or head[8:12] != b"AVI ":
            raise ValueError(f"{path}: not an AVI file")
        at, shape, movi = 12, None, 0
        while at + 8 <= length:
            name, size = struct.unpack("<4sI", read(at, 8))
            if name == b"LIST":
                if read(at + 8, 4) == b"movi":
                    movi = at + 8
                    end = at + 8 + size + size % 2
                    found = self._index(read, movi, end, length) if shape else None
                    if found is not None:
                        yield from ([[a, n], *shape] for a, n in found)
                        return
                at += 12
                continue
            if name == b"strf" and shape is None and size >= 40:
                _, w, h, _, bits, codec = struct.unpack("<IiiHH4s", read(at + 8, 20))
                jpeg = codec.upper() in (b"MJPG", b"JPEG")
                if not jpeg and (codec not in (b"\0\0\0\0", b"Y800", b"GREY", b"Y8  ") or bits not in (8, 24)):
                    raise ValueError(f"{path}: codec {codec!r} with {bits} bits")
                shape = (abs(h), w, "jpeg" if jpeg else f"{bits // 8}{'u' if h > 0 and codec == bytes(4) else 'd'}")
            elif shape and name[2:] in (b"db", b"dc"):
                yield [at + 8, size], *shape
            at += 8 + size + size % 2

    def _index(self, read: Read, movi: int, at: int, length: int) -> list[tuple[int, int]] | None:
        """(offset, bytes) of the frames that an index after the frames tells, in one
        read; None without one, or if it doesn't fit."""
        if at + 8 > length:
            return None
        name, size = struct.unpack("<4sI", read(at, 8))
        if name != b"idx1" or at + 8 + size > length:
            return None
        rows = np.frombuffer(read(at + 8, size - size % 16), dtype=[("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")])
        rows = rows[[n[2:] in (b"db", b"dc") for n in rows["name"]]]
        if not len(rows):
            return None
        for base in (movi, 0):  # offsets count from the list, or from the file's start
            first, size = struct.unpack("<4sI", read(base + int(rows["at"][0]), 8))
            if (first, size) == (rows["name"][0], rows["n"][0]):
                return [(base + int(a) + 8, int(n)) for a, n in zip(rows["at"], rows["n"])]
        return None

    def picture(self, raw: bytes, h: int, w: int, note: str, sizes: list[int]) -> np.ndarray:
        if note == "jpeg":
            return codecs.jpeg_grey(raw)
        planes = int(note[0])
        line = -(-w * planes // 4) * 4 if len(raw) >= -(-w * planes // 4) * 4 * h else w * planes
        im = np.frombuffer(raw, dtype=np.uint8, count=line * h).reshape(h, line)[:, : w * planes]
        if planes == 3:
            im = np.around(im.reshape(h, w, 3) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
        return im[::-1] if note[1] == "u" else im


raw_decoder, tiff_pages, avi_frames = RawFrames, TiffPages(), AviFrames()


def _row(path: str, n: int, im: np.ndarray, flip: bool) -> pa.RecordBatch:
    im = im[::-1] if flip else im
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([n], pa.int32()), pa.array([im.shape[0]], pa.int32()), pa.array([im.shape[1]], pa.int32()), pa.array([im.astype(float).ravel()], pa.list_(pa.float64()))],
        names=["path", "n", "h", "w", "pixels"],
    )


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at.replace("%20", " "))


def _laid_out(files: DataFrame, layout, flip: bool, frames: int) -> tuple[DataFrame, DataFrame]:
    """(path, n, ...) of all frames, from headers alone, and the frames themselves,
    `frames` successive ones to a task, read by their byte ranges."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                with _open(path) as f:
                    rows = [(path, n, *x) for n, x in enumerate(layout.spans(path, lambda at, size: f.read_at(size, at), length))]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for b in batches:
            for path, n, ranges, h, w, note in zip(*(b.column(i).to_pylist() for i in range(6))):
                if path != now:
                    if f:
                        f.close()
                    now, f = path, _open(path)
                raw = b"".join(f.read_at(size, at) for at, size in zip(ranges[::2], ranges[1::2]))
                yield _row(path, n, layout.picture(raw, h, w, note, ranges[1::2]), flip)
        if f:
            f.close()

    spans = written(files.select("path", "length").mapInArrow(scan, SPANS), "spans")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spans.repartition(tasks, "path", F.floor(F.col("n") / frames)).sortWithinPartitions("path", "n")
    return spans.select("path", "n"), dealt.mapInArrow(read, FRAMES)


def load(
    spark: SparkSession, folder: str, decode, *, glob: str = "*", pattern: str = ".*", flip: bool = False,
    stride: int | None = None, mean: int | None = None, post: Callable[[DataFrame], DataFrame] | None = None, frames_a_task: int = 256,
) -> DataFrame:
    """A long movie of all files in a folder whose names match, in natural order (by
    the last number in the name), frames counted on from file to file. flip turns
    frames upside down; stride keeps every so-many-th frame, and mean averages so many.

    decode is a layout (RawFrames, TiffPages, AviFrames), by which frames_a_task frames
    are read at a time, or a function of a file's path and content that gives its
    frames: then files, of 2 GB at most, are dealt to tasks, and decoded once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    if not files.select("path").take(1):
        raise FileNotFoundError(f"no file like {glob} and {pattern} in {folder}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                for n, im in enumerate(decode(path, data.as_py())):
                    yield _row(path, n, im, flip)

    if hasattr(decode, "spans"):
        known, frames = _laid_out(files, decode, flip, frames_a_task)
    else:
        known = frames = written(files.select("path", "content").mapInArrow(run, FRAMES), "frames")
    lengths = known.groupBy("path").agg((F.max("n") + 1).alias("_n"))  # one row per file
    before = F.coalesce(F.sum("_n").over(Window.orderBy(file_number(F.col("path")), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = frames.join(F.broadcast(lengths.select("path", before.alias("_before"))), "path").select((F.col("_before") + F.col("n")).cast("int").alias("frame"), "h", "w", "pixels")
    placed = placed.where(F.col("frame") % stride == 0) if stride else placed
    at = placed.select("frame", "w", F.posexplode("pixels").alias("i", "value"))
    movie = at.select("frame", F.floor(F.col("i") / F.col("w")).cast("int").alias("height"), (F.col("i") % F.col("w")).cast("int").alias("width"), "value")
    movie = project.coarsen(movie, frame=mean) if mean else movie
    return post(movie) if post else movie


def clips(movie: DataFrame, times: DataFrame, fps: float) -> DataFrame:
    """(clip, frame, height, width, value) of the clips(clip, start, end) in seconds: a
    clip's frames are listed from its ends, so that they meet the movie by frame."""
    first, last = F.ceil(F.col("start") * fps).cast("int"), F.ceil(F.col("end") * fps).cast("int") - 1
    listed = times.where(last >= first).select("clip", F.explode(F.sequence(first, last)).alias("frame"))
    return movie.join(listed, "frame").select("clip", "frame", "height", "width", "value")
