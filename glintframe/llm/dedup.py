"""Exact deduplication with two passes over a Bloom filter of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import BLOCK_BITS, bit_blocks, counted, is_set, written


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _slot(digest: Column, blocks: int) -> Column:
    """The filter's slot of a digest, over all blocks."""
    return F.pmod(F.xxhash64(digest), F.lit(blocks * BLOCK_BITS))


def repeat_filter(digests: DataFrame, rows: int, *, bits_per_row: int = 32, max_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """First pass over digests(sha): which slots of the filter two or more rows fall
    into, as bitmaps (block, bits), and the number of blocks.

    A counting Bloom filter with one slot per digest. Its counters are kept sparse:
    what shuffles is a (slot, count) of two numbers for each slot that a task has met,
    summed up within the task, which is less than dense bitmaps of every task once
    there are more than a few tasks. What is sent to the second pass is one bit per
    slot, max_bits (32 MB) at most, whatever the input. Where more than max_bits /
    bits_per_row rows come, more rows are passed on to the exact comparison, and the
    result is the same.
    """
    blocks = bit_blocks(rows, bits_per_row, max_bits)
    hit = digests.groupBy(_slot(F.col("sha"), blocks).alias("slot")).agg(F.count("*").alias("n")).where("n > 1")
    bits = hit.groupBy(F.floor(F.col("slot") / BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % BLOCK_BITS).alias("bits"))
    return bits, blocks


def maybe_repeated(df: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """Second pass: df(sha, ...) with `maybe`, false only where no other row has
    this digest."""
    slot = _slot(F.col("sha"), blocks)
    out = df.withColumn("_block", F.floor(slot / BLOCK_BITS)).join(F.broadcast(bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left")
    return out.withColumn("maybe", F.coalesce(is_set(F.col("_bits"), slot % BLOCK_BITS), F.lit(False))).drop("_block", "_bits")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_args) -> DataFrame:
    """One row per row of df: its id as doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 is, with no change made to them; null
    counts as empty. Of equal texts the row with the largest id stays (a null id
    is the smallest; of rows that repeat id and text, one stays). Columns beyond
    these two aren't read. An empty table gives an empty table.

    One scan of the texts writes their digests; all later steps read those. Rows
    whose digest can't be repeated pass straight through; only the others
    shuffle, and are counted within tasks before.
    """
    rows, seen = counted(
        df.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("uid")), "digests"
    )
    bits, blocks = repeat_filter(rows, seen["rows"], **filter_args)
    tested = maybe_repeated(rows, written(bits, "filter"), blocks)
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    some = tested.where("maybe")
    # written, so that the join below has both sides from plain exchanges and a hot digest's rows can be split
    groups = written(some.groupBy("sha").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size")), "groups", rows=seen["rows"])
    found = some.join(groups, "sha").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), hexed
    )
    return alone.union(found)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_args) -> DataFrame:
    """The rows of df that stay, all columns as they are: of rows with equal
    texts (see exact_groups) one with the largest id. Rows that the filter clears
    aren't shuffled; of the others each task first keeps its best row per text.
    """
    cols = df.columns
    named = [f"c{i}" for i in range(len(cols))]
    packed = df.toDF(*named)
    key, text = named[cols.index(id_col)], named[cols.index(text_col)]
    packed = packed.withColumn("sha", _digest(F.col(text)))
    rows, seen = counted(packed.select("sha"), "digests")
    bits, blocks = repeat_filter(rows, seen["rows"], **filter_args)
    tested = maybe_repeated(packed, written(bits, "filter"), blocks)
    whole = F.struct(*named)
    best = tested.where("maybe").groupBy("sha").agg(F.max_by(whole, F.struct(F.col(key), F.xxhash64(*named))).alias("r")).select("r.*")
    return tested.where("not maybe").select(*named).union(best.select(*named)).toDF(*cols)
