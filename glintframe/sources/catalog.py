"""A dataset: a folder with one Parquet table per variable, as it comes or in a layout."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.expr import path_part
from glintframe.operators.project import merge


#: What a layout keeps together (its buckets), and the order within these.
LAYOUTS = {"frames": (("frame",), ("frame", "height", "width")), "pixels": (("height", "width"), ("height", "width", "frame"))}


def save(
    var: DataFrame, folder: str, name: str, meta: dict[str, int] | None = None, overwrite: bool = False, layout: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Write a variable to folder/name and read it back. meta gives names to parts of
    the folder's path, counted from its end (session=-1: the folder itself); they
    become partition columns.

    layout "frames" keeps each frame's pixels in one bucket, sorted, "pixels" each
    pixel's frames: operators by frame (stencils, projections of frames) or by pixel
    (glow, noise, traces, seeds' joins) then read them where they are, without an
    exchange. What works the other way exchanges as usual; a movie that is used both
    ways is stored twice. buckets is by default the session's number of shuffle
    partitions; each is one file, so choose it by the movie's size. The layout is told
    in the table's folder, and load() finds it in any session.
    """
    parts, path = folder.rstrip("/").split("/"), _path(folder, name)
    named = var.withColumns({k: F.lit(parts[i]) for k, i in (meta or {}).items()})
    spark, mode = var.sparkSession, "overwrite" if overwrite else "errorifexists"
    if layout is None:
        out = named.write.mode(mode)
        (out.partitionBy(*meta) if meta else out).parquet(path)
        return load(spark, folder, name)
    keys, order = LAYOUTS[layout]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if mode == "errorifexists" and _exists(spark, path):
        raise FileExistsError(path)
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    out = named.repartition(n, *keys).write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*order).option("path", path)
    (out.partitionBy(*meta) if meta else out).saveAsTable(_table(path))
    spark.createDataFrame([(json.dumps({"keys": keys, "order": order, "buckets": n, "meta": list(meta or ())}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    return load(spark, folder, name)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A variable; one that was saved in a layout comes as a bucketed table."""
    path = _path(folder, name)
    if not _exists(spark, f"{path}/_layout"):
        return spark.read.parquet(path)
    told = json.loads(spark.read.text(f"{path}/_layout").first()[0])
    if not spark.catalog.tableExists(_table(path)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        parts = f"PARTITIONED BY ({', '.join(told['meta'])})" if told["meta"] else ""
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_table(path)} ({columns}) USING parquet {parts} CLUSTERED BY ({', '.join(told['keys'])}) SORTED BY ({', '.join(told['order'])}) INTO {told['buckets']} BUCKETS LOCATION '{where}'"
        )
        if parts:
            spark.sql(f"ALTER TABLE {_table(path)} RECOVER PARTITIONS")
    return spark.table(_table(path))


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _table(path: str) -> str:
    """The session's name for a table in a layout."""
    return f"glintframe_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def open_all(spark: SparkSession, folder: str, post=None) -> dict[str, DataFrame]:
    """All variables of a dataset, each passed through post if given."""
    return {n: (post or (lambda d: d))(load(spark, folder, n)) for n in names(spark, folder)}


def open_merged(spark: SparkSession, folder: str, on: list[str], variables: list[str]) -> DataFrame:
    """Variables in one table over shared dimensions; conflicts fail."""
    return reduce(lambda a, b: merge(a, b, on), (load(spark, folder, v).withColumnRenamed("value", v) for v in variables))


def open_many(spark: SparkSession, root: str, name: str, index: dict[str, int], pattern: str = ".*", sub_dirs: list[str] | None = None, exclude: bool = True) -> DataFrame:
    """One variable of all datasets below root whose folder matches a pattern and, with
    exclude, has none of sub_dirs in its path (without: has one), told apart by parts
    of the path (counted from the dataset's folder)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root).withColumn("_path", F.input_file_name())
    folder = F.regexp_extract("_path", f"^(.*)/{name}/[^/]*$", 1)
    rows = rows.withColumn("_folder", folder).where((F.col("_folder") != "") & F.col("_folder").rlike(pattern))
    for d in sub_dirs or []:
        rows = rows.where(~F.col("_folder").contains(f"/{d}")) if exclude else rows
    if sub_dirs and not exclude:
        rows = rows.where(reduce(lambda a, b: a | b, (F.col("_folder").contains(f"/{d}") for d in sub_dirs)))
    return rows.withColumns({k: path_part(F.col("_folder"), -i) for k, i in index.items()}).drop("_path", "_folder")


def update_meta(spark: SparkSession, folder: str, name: str, meta: dict[str, int]) -> DataFrame:
    """Rewrite a variable with new path-derived columns."""
    from glintframe.runtime import written

    old = written(load(spark, folder, name).drop(*meta), "meta")  # the folder is read before it is overwritten
    return save(old, folder, name, meta, overwrite=True)
