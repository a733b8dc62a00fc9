"""Tables in the cluster's shared folder, and groups of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and the
    master is local, a temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glintframe-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table in the shared folder."""
    return f"{shared_dir(spark)}/glintframe/{name}-{uuid.uuid4().hex}"


#: Rows in a file of a table of narrow rows, where it has more than a few files a core.
ROWS_A_FILE = 500_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there: the
    lineage ends here, and a lost executor costs no more than a re-read.

    rows, for narrow rows that come from a shuffle, is how many there are at most:
    as many tiny files cost more time, and processes on local disks, than the rows
    in them, these go into three files per core, or one per ROWS_A_FILE rows where
    that is more, so that tasks don't grow with the table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(3 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files behind a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def counted(df: DataFrame, name: str, rows: int | None = None, *more) -> tuple[DataFrame, dict]:
    """written(df, name, rows), and what was observed while writing: `rows`, the
    number of rows, and further named aggregates, without a job of their own."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), name, rows)
    return out, seen.get


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Groups of the undirected graph edges(a, b), as (id, component), the
    component being the smallest id reachable; ids without an edge don't occur.

    Alternating large-star and small-star rounds; every round aggregates its
    neighbourhoods map-side first and is one job, written to the shared folder,
    whose rows and checksum tell whether it changed anything. A hub costs no more
    than its degree in rows, in any round. Null ids and loops are ignored; an empty
    table gives an empty table. Rounds grow with the logarithm of the longest
    chain; a graph that takes more than max_rounds raises.
    """
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    first = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, was = counted(first, "edges", None, mark)
    for _ in range(max_rounds if was["rows"] else 0):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the neighbours below a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        nxt, now = counted(small.select("e.a", "e.b").where("a <> b").distinct(), "edges", was["rows"], mark)
        drop_written(cur)
        cur = nxt
        if now == was:
            break
        was = now
    else:
        if was["rows"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        cur.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    )
