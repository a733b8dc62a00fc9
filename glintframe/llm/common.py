"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.runtime import connected, counted, drop_written, scratch, shared_dir, written

__all__ = [
    "BLOCK_BITS", "SPACE", "SPACE_CHARS", "bit_blocks", "bounded_batches", "connected", "counted", "drop_written", "give_back", "is_set", "key_filter", "maybe_in", "scratch", "shared_dir",
    "written",
]

#: Bits in one row of a filter, as the bitmap_* functions lay them out.
BLOCK_BITS = 32768

#: Characters that separate words, as a Java/Python regex class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a literal string.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let batches of rows for Python hold 4 MB of long texts at most, and not 64 MB,
    which an executor's memory may not have room for: set for the session, unless
    it has a value of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which Spark keeps for later tasks, returns the
    memory that it has freed to the system (where its C library can)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return task


def bit_blocks(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Blocks of a filter for so many rows: a power of two of max_bits' blocks at most."""
    return max(1, min(max_bits, 1 << max(0, rows * bits_per_row - 1).bit_length()) // BLOCK_BITS)


def is_set(bits: Column, place: Column) -> Column:
    """Whether the bit at `place` of a block's bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def key_filter(keys: DataFrame, key: str, rows: int, *, bits_per_row: int = 16, max_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """A Bloom filter of keys(key), hashes of 64 bits: rows (_block, _one, _two) of
    bitmaps, and the number of blocks. It has bits_per_row bits for each of `rows`
    keys, max_bits (32 MB) at most, so that it can be broadcast whatever the input.
    Bitmaps are built within tasks before they shuffle."""
    blocks = bit_blocks(rows, bits_per_row, max_bits)
    one, two = _two_places(F.col(key))
    bits = keys.groupBy(F.pmod(key, F.lit(blocks)).alias("_block")).agg(F.bitmap_construct_agg(one).alias("_one"), F.bitmap_construct_agg(two).alias("_two"))
    return bits, blocks


def maybe_in(df: DataFrame, key: str, bits: DataFrame, blocks: int, name: str) -> DataFrame:
    """df with the boolean `name`: false only where its hash isn't among the filter's keys."""
    one, two = _two_places(F.col(key))
    out = df.withColumn("_block", F.pmod(key, F.lit(blocks))).join(F.broadcast(bits), "_block", "left")
    return out.withColumn(name, F.coalesce(is_set(F.col("_one"), one) & is_set(F.col("_two"), two), F.lit(False))).drop("_block", "_one", "_two")


def _two_places(key: Column) -> tuple[Column, Column]:
    g = F.xxhash64(key)
    return F.pmod(g, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(g, 24), F.lit(BLOCK_BITS))
