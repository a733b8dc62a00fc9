"""Token ids in seekable files: independent zstandard frames, a table of documents and
a trailing seek table with a checksum for each frame."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, drop_written, give_back, scratch, written
from glintframe.llm.packing import Ids

# Fixed values of the zstandard seekable format (its public description): a skippable frame's magic number
# for the seek table, the magic number that ends a file, and the descriptor's bit for checksums.
SEEK_FRAME, SEEK_END, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: A skippable frame of our own holds the table of documents, so that any zstandard reader still reads the ids.
DOCUMENTS_FRAME, DOCUMENTS_MAGIC = 0x184D2A50, b"tokdocs1"
#: One document: has an id (else it is null), its id, its frames, its ids.
DOCUMENT = np.dtype([("named", "<u1"), ("doc_id", "<i8"), ("frames", "<u4"), ("ids", "<u8")])
#: One frame: bytes in the file, bytes of ids, the low half of their 64-bit XXH64.
FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
FILES = "part int, file string, docs long, ids long, bytes long"


class Frames:
    """Packs documents' ids, at `width` bytes each, into frames of frame_ids ids at most."""

    def __init__(self, width: int = 2, frame_ids: int = 1 << 18, level: int = 3) -> None:
        import zstandard

        self.kind, self.frame_ids = np.dtype(f"<u{width}"), frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """A document's frames, one at least, and their rows of the seek table."""
        import xxhash

        packed, table = [], []
        for at in range(0, max(len(ids), 1), self.frame_ids):
            plain = ids[at : at + self.frame_ids].astype(self.kind).tobytes()
            packed.append(self.packer.compress(plain))
            table.append(struct.pack("<III", len(packed[-1]), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        return b"".join(packed), b"".join(table)


class Writer:
    """Writes packed documents to a binary stream, in the order in which they come."""

    def __init__(self, out, width: int = 2) -> None:
        self.out, self.width = out, width
        self.documents, self.frames, self.ids, self.bytes = bytearray(), bytearray(), 0, 0

    def add(self, doc_id: int | None, n_ids: int, packed: bytes, table: bytes) -> None:
        self._put(packed)
        self.frames += table
        self.documents += struct.pack("<BqIQ", doc_id is not None, doc_id or 0, len(table) // FRAME.itemsize, n_ids)
        self.ids += n_ids

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def close(self) -> None:
        """The two tables, each in frames that other readers skip."""
        head = DOCUMENTS_MAGIC + struct.pack("<IQ", self.width, len(self.documents) // DOCUMENT.itemsize)
        body = head + bytes(self.documents)
        body += struct.pack("<QQ", len(self.documents), zlib.crc32(body))
        self._put(struct.pack("<II", DOCUMENTS_FRAME, len(body)) + body)
        table = bytes(self.frames) + struct.pack("<IBI", len(self.frames) // FRAME.itemsize, WITH_CHECKSUMS, SEEK_END)
        self._put(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()


class Reader:
    """Reads single documents of a file: its two tables, and then no more than the
    frames of those asked for. Damage of any kind raises ValueError."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        if size < 17:
            raise ValueError("no seek table")
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEK_END or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = size - 9 - count * FRAME.itemsize
        if table - 8 < 0 or struct.unpack("<II", file.read_at(8, table - 8)) != (SEEK_FRAME, size - table):
            raise ValueError("the seek table has another length")
        self.frames = np.frombuffer(file.read_at(count * FRAME.itemsize, table), dtype=FRAME)
        end = table - 8
        length, crc = struct.unpack("<QQ", file.read_at(16, end - 16)) if end >= 16 else (0, 0)
        start = end - 16 - length
        self.starts = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        if start - 28 != self.starts[-1]:
            raise ValueError("frames and tables don't fill the file")
        raw = file.read_at(length + 28, start - 28)
        mark, body, magic, width, docs = struct.unpack("<II8sIQ", raw[:28])
        if mark != DOCUMENTS_FRAME or body != end - start + 20 or magic != DOCUMENTS_MAGIC or docs * DOCUMENT.itemsize != length or zlib.crc32(raw[8:]) != crc:
            raise ValueError("damaged table of documents")
        self.kind, self.documents = np.dtype(f"<u{width}"), np.frombuffer(raw[28:], dtype=DOCUMENT)
        self.first = np.concatenate(([0], np.cumsum(self.documents["frames"], dtype=np.int64)))
        self.before = np.concatenate(([0], np.cumsum(self.documents["ids"], dtype=np.int64)))
        self.unpacked = 0

    def doc_id(self, k: int) -> int | None:
        return int(self.documents["doc_id"][k]) if self.documents["named"][k] else None

    def read(self, places, run_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of the documents at rising places; those that lie side by side
        are fetched together, up to run_bytes at a time."""
        import zstandard
        import xxhash

        unpacker, todo = zstandard.ZstdDecompressor(), []

        def fetch() -> Iterator[tuple[int, np.ndarray]]:
            start = self.starts[self.first[todo[0]]]
            raw = memoryview(self.file.read_at(int(self.starts[self.first[todo[-1] + 1]] - start), int(start)))
            for k in todo:
                got = []
                for f in range(self.first[k], self.first[k + 1]):
                    at = self.starts[f] - start
                    try:
                        plain = unpacker.decompress(raw[at : at + self.frames["packed"][f]], max_output_size=int(self.frames["plain"][f]))
                    except zstandard.ZstdError as e:
                        raise ValueError(f"damaged frame {f}") from e
                    if len(plain) != self.frames["plain"][f] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames["checksum"][f]:
                        raise ValueError(f"frame {f} doesn't match its checksum")
                    self.unpacked += len(plain)
                    got.append(np.frombuffer(plain, dtype=self.kind))
                ids = got[0] if len(got) == 1 else np.concatenate(got)
                if len(ids) != self.documents["ids"][k]:
                    raise ValueError(f"document {k} has another length")
                yield k, ids

        for k in places:
            if todo and (k != todo[-1] + 1 or self.starts[self.first[k + 1]] - self.starts[self.first[todo[0]]] > run_bytes):
                yield from fetch()
                todo = []
            todo.append(int(k))
        if todo:
            yield from fetch()


PACKED = "doc_id long, uid long, n_ids long, packed binary, frames binary"


def _encode(args: tuple, end: int, width: int, frame_ids: int):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = pack = None
        for b in batches:
            ids_of, pack = ids_of or Ids(*args), pack or Frames(width, frame_ids)
            n, packed, frames = [], [], []
            for text in b.column(1):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end))
                if width < 4 and int(ids.max()) >> 8 * width:
                    raise ValueError(f"ids of {width} bytes don't hold {ids.max()}")
                one = pack(ids)
                n.append(len(ids))
                packed.append(one[0])
                frames.append(one[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(frames, pa.binary())], names=names)

    return run


def _write(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, part, docs = None, 0, 0
        for b in batches:
            for doc, where, n, packed, frames in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("n_ids").to_pylist(), b.column("packed"), b.column("frames")):
                if to is None:
                    store, at = fs.FileSystem.from_uri(folder)
                    store.create_dir(at)
                    part, name = where, f"tokens-{where:06d}-{uuid.uuid4().hex}.zst"
                    to = Writer(store.open_output_stream(f"{at}/{name}", compression=None), width)
                to.add(doc, n, packed.as_py(), frames.as_py())
                docs += 1
        if to:
            to.close()
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, name, docs, to.ids, to.bytes), kinds)], names=[c.split()[0] for c in FILES.split(", ")])

    return run


def write_tokens(
    df: DataFrame, folder: str, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", *, end: int = 2, width: int = 2, frame_ids: int = 1 << 18, partitions: int | None = None,
) -> DataFrame:
    """Write every text's ids, with the id `end` after them, to files in `folder` by rising
    id; returns the files (FILES), their ids' place in the whole being that of `part`.

    Texts are encoded and packed once; the packed documents, which are a fraction of
    the texts, are then dealt by ranges of ids, sorted, and each range becomes a
    file. A document starts a frame of its own and has one frame, or as many as it
    takes at frame_ids ids each. width: bytes of an id, 2 where the vocabulary
    allows, else 4. Each task writes a file of its own name, and the returned table
    names it only if the task ended well.

    A null text counts as empty and has one id. Null document ids come first; rows
    that repeat an id are told apart by their place in the table, so that one id's
    rows may lie in several files. Other columns aren't read. An empty table gives
    no file.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    packed = written(texts.mapInArrow(give_back(_encode(tokenizer, end, width, frame_ids)), PACKED), "packed")
    laid = packed.repartitionByRange(n, "doc_id", "uid").sortWithinPartitions("doc_id", "uid").withColumn("part", F.spark_partition_id())
    files = written(laid.mapInArrow(give_back(_write(folder, width)), FILES), "token-files")
    drop_written(packed)
    return files


def _read(folder: str, docs: int, ids: bool):
    """Rows (file, before, slice, wanted) -> documents; wanted null: all of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    src = Reader(f)
                    places = range(row["slice"] * docs, min((row["slice"] + 1) * docs, len(src.documents)))
                    if row["wanted"] is not None:
                        own = src.documents[places.start : places.stop]
                        places = places.start + np.flatnonzero(own["named"].astype(bool) & np.isin(own["doc_id"], row["wanted"]))
                    held: list[tuple] = []
                    size = 0
                    for k, got in src.read(places):
                        plain = got.astype("<u4").tobytes()
                        held.append((src.doc_id(k), int(src.before[k]) + row["before"], len(got), zlib.crc32(plain), plain if ids else None))
                        size += len(plain) if ids else 64
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    return run


def read_tokens(files: DataFrame, folder: str, wanted: DataFrame | None = None, *, docs: int = 4096, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, as little-endian unsigned 32-bit
    numbers, if asked for) of the documents in the files, or of those in wanted(doc_id).

    start is the number of ids of all documents before it. Work is dealt in slices of
    `docs` documents of a file; a task reads the file's tables and the frames of its
    documents, side by side ones at once, and holds every frame against its
    checksum. With wanted, a task gets the ids that lie within its file's range, and
    reads their frames alone. Files' totals, one row each, are read by the driver.
    """
    spark = files.sparkSession
    before, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append((r.part, r.file, before, r.docs))
        before += r.ids
    all_ = spark.createDataFrame(rows, "part int, file string, before long, docs long")
    todo = all_.select("file", "before", F.explode(F.sequence(F.lit(0), F.floor((F.col("docs") - 1) / docs))).alias("slice"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if wanted is None:
        todo = todo.select("*", F.lit(None).cast("array<long>").alias("wanted"))
    else:
        todo = _ranges(todo, all_, folder, docs, wanted)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    got = todo.repartition(n, "file", "slice").mapInArrow(give_back(_read(folder, docs, ids)), out)
    return got if ids else got.drop("ids")


def _ranges(todo: DataFrame, files: DataFrame, folder: str, docs: int, wanted: DataFrame) -> DataFrame:
    """todo with the wanted ids of each slice, as found in the files' tables of
    documents; slices without any drop out."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    own = Reader(f).documents
                at = np.flatnonzero(own["named"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at // docs, pa.int64()), pa.array(own["doc_id"][at], pa.int64())], names=["file", "slice", "doc_id"]
                )

    there = files.select("file").repartition("file").mapInArrow(listed, "file string, slice long, doc_id long")
    mine = there.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").groupBy("file", "slice").agg(F.collect_set("doc_id").alias("wanted"))
    return todo.join(mine, ["file", "slice"])


def token_folder(spark) -> str:
    """A new folder for token files, under the cluster's shared folder."""
    return scratch(spark, "tokens")
