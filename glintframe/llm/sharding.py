"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm.common import bounded_batches, written


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within the partition, the bytes and rows before each row; two numbers are
    all that is kept between batches."""
    start, row = 0, 0
    for b in batches:
        size = b.column("size").to_numpy()
        ends = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(ends - size + start), pa.array(np.arange(row, row + len(size), dtype=np.int64))],
            names=[*b.schema.names, "start", "row"],
        )
        if len(size):
            start, row = start + int(ends[-1]), row + len(size)


ORDER = ["doc_id", "text_crc32", "size", "uid"]


def _narrow(id_col: str, text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("uid")]


def _placed(rows: DataFrame, shards: int, n: int, many: int | None = None) -> DataFrame:
    """rows(doc_id, size, text_crc32, uid, ...) with shard and slot instead of uid: sorted
    by ranges, summed up within each, and cut by the ranges' totals."""
    spark = rows.sparkSession
    laid = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).drop("uid").withColumn("part", F.spark_partition_id())
    more = [c for c in laid.columns if c != "part"]
    schema = T.StructType([*laid.schema.fields, T.StructField("start", T.LongType()), T.StructField("row", T.LongType())])
    local = written(laid.mapInArrow(_running, schema), "laid", rows=many)
    sums = sorted(local.groupBy("part").agg(F.sum("size"), F.count("*")).collect())  # one row per partition
    total, count, before = 0, 0, []
    for part, size, rows_in in sums:
        before.append((part, total, count))
        total, count = total + size, count + rows_in
    if not before:
        return local.select(*more, F.lit(0).alias("shard"), F.col("row").alias("slot"))
    offsets = spark.createDataFrame(before, "part int, bytes_before long, rows_before long")
    # exact also where bytes * shards would overflow: target boundaries are computed here
    bounds = F.array(*[F.lit(-(-total * k // shards)) for k in range(1, shards)]) if shards > 1 else F.array().cast("array<bigint>")
    placed = local.join(F.broadcast(offsets), "part").select(*more, (F.col("bytes_before") + F.col("start")).alias("at"), (F.col("rows_before") + F.col("row")).alias("row"))
    placed = placed.withColumn("shard", F.size(F.filter(bounds, lambda b: b <= F.col("at"))))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(*more, "shard", (F.col("row") - F.col("first")).alias("slot"))


def byte_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, shard, slot.

    Rows are laid out by id (ties by checksum and size, then as read; null ids
    first). A row goes to the shard in which its first byte falls when all bytes
    are cut at equal targets, so that shards are contiguous and differ from the
    target by less than one row's size each; slot counts from 0 within a shard.
    Null texts have size 1 and the checksum of an empty text. Further columns
    aren't read. An empty table gives an empty table.

    Only (id, size, checksum) are sorted. Each range partition sums up its own
    rows in one pass; the totals, one row per partition, are summed globally and
    sent back. No window runs over the table.
    """
    bounded_batches(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(df.select(*_narrow(id_col, text_col)), shards, n, df.count()).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write df's rows, all of them and all columns, to path/shard=k in slot order, and
    return what byte_shards does; columns named shard and slot are replaced.

    The rows themselves are laid out, once, and carry their place from then on:
    nothing is matched by id, so that null ids and rows that repeat an id, or
    everything, are written like others. An empty table writes an empty folder.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    coded = [f"c{i}" for i in range(len(kept))]
    n = partitions or max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = _placed(df.select(*_narrow(id_col, text_col), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, coded)]), shards, n)
    out = placed.select(*[F.col(k).alias(c) for c, k in zip(kept, coded)], "slot", "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
