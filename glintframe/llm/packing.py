"""Token counts, cuts, and hierarchical best-fit packing into sequences."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, counted, give_back, written

#: Texts of these characters only are split alike by both tokenizer libraries.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧]*")
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Ids:
    """Token ids of texts as tokenizers gives them with add_special_tokens=False.

    path: the vocabulary's .json. Where ranks (a .tiktoken file of the same
    vocabulary) is given, texts of PLAIN characters without a special token's
    string go through tiktoken, which finds the same ids four times as fast; all
    other texts go through tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens") or []]
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    @cached_property
    def slow(self):
        """Loaded when the first text needs it: it takes a worker's memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _cut(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc) of the pieces: all of `size`, but the first one may be shorter."""
    first = len(ids) % size or min(size, len(ids))
    for start in (0, *range(first, len(ids), size)):
        part = ids[start : start + (size if start else first)]
        yield start, len(part), zlib.crc32(part.tobytes())


def _pieces(args: tuple, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = None
        for b in batches:
            ids_of = ids_of or Ids(*args)
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end))
                rows += [(doc, k, *x) for k, x in enumerate(_cut(ids, size))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(df: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each text's ids, then the id
    `end`, cut where longer than size; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(give_back(_pieces(tokenizer, size, end)), PIECES)


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset) of each item, and each bin's fill.

    Bins wait in lists by free room; bit r of `free` says that list r isn't empty,
    so that the fullest bin with room for an item is the lowest bit from its
    length on.
    """
    at, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                free &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        at[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            waiting[room - n].append(b)
            free |= 1 << (room - n)
    return at, offset, fill


def _packer(size: int, level: int, full: int):
    """Packs one group's items; a bin's number holds its level, group and place."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("item", "ascending")])
        bucket = rows.column("bucket")[0].as_py()
        at, offset, fill = best_fit(rows.column("length").to_pylist(), size)
        at = np.array(at, dtype=np.int64)
        bins = (np.int64(level) << 58) + (np.int64(bucket) << 24) + at
        room = np.array(fill, dtype=np.int64)[at]
        cols = [rows.column("item").combine_chunks(), pa.array(bins), pa.array(offset, pa.int64()), pa.array(room), pa.array(room < full), pa.array(np.full(len(at), bucket, dtype=np.int64))]
        return pa.Table.from_arrays(cols, names=["item", "bin", "offset", "fill", "open", "bucket"])

    return run


def pack(
    df: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", *,
    size: int = 2048, end: int = 0, full: int = 2016, bucket_items: int = 40_000, gain: float = 0.02,
) -> DataFrame:
    """Every text's pieces with the sequence each is in and its offset there:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokens are found once; afterwards only lengths move. Pieces of full length are
    sequences. The others are dealt at random into buckets of about bucket_items
    and packed there by best fit decreasing. Bins filled to at least `full` tokens
    are done; the rest meet as items of a further best-fit round, in as many buckets
    of bucket_items as they take, dealt anew. The tree ends with a round of one bucket, or
    with one that leaves more than a share 1 - gain of its items underfull: what is
    left then, like pieces of more than half a sequence, can't be put together, and
    another round would only move it. So no bucket is larger than others, whatever
    the lengths.

    Null ids stay null, null and empty texts are one piece of one token, repeated
    rows are packed one by one. An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    cut = written(pieces(df, tokenizer, id_col, text_col, size, end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") >= size)
    items = cut.where(F.col("length") < size)
    n = items.count()
    schema = "item long, bin long, offset long, fill long, open boolean, bucket long"
    now, levels = items.select("item", F.col("length").cast("long").alias("length")), []
    while True:
        level, buckets = len(levels) + 1, max(1, -(-n // bucket_items))
        dealt = now.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets)))
        at = written(dealt.groupBy("bucket").applyInArrow(_packer(size, level, 0 if buckets == 1 else full), schema), "bins", rows=n)
        levels.append(at)
        if buckets == 1:
            break
        before = n
        now, seen = counted(at.where("open").groupBy("bin").agg(F.max("fill").alias("length")).select(F.col("bin").alias("item"), "length"), "underfull", n)
        n = seen["rows"]
        if n > (1 - gain) * before or not n:
            break
    where = levels[-1].select("item", "bin", "offset")
    for at in reversed(levels[:-1]):  # an item is where its bin is now, or where it was put
        up = where.select(F.col("item").alias("bin"), F.col("bin").alias("higher"), F.col("offset").alias("before"))
        where = at.join(up, "bin", "left").select("item", F.coalesce("higher", "bin").alias("bin"), (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = items.join(where, "item").select(*cols, F.col("bin").alias("sequence_id"), "offset")
    return placed.union(whole.select(*cols, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
