"""The driver's tables as movies, traces and footprints, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import PIXEL

#: Height and width of the movie made of line items.
SIDE = 16


class Inputs:
    """Movies E (embeddings) and L (line items), traces T (events), footprints A and
    traces C of the embeddings' labels."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def E(self) -> DataFrame:
        at = self.table("embeddings").select(F.col("vec_id").cast("int").alias("frame"), F.posexplode("embedding").alias("i", "v"))
        return at.select("frame", F.floor(F.col("i") / 8).cast("int").alias("height"), (F.col("i") % 8).cast("int").alias("width"), F.col("v").cast("double").alias("value"))

    @cached_property
    def L(self) -> DataFrame:
        month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
        cells = self.table("lineitem").groupBy(month.alias("frame"), (F.col("l_suppkey") % SIDE).cast("int").alias("height"), (F.col("l_partkey") % SIDE).cast("int").alias("width")).agg(F.sum("l_quantity").alias("v"))
        frames = cells.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("frame"))
        side = F.sequence(F.lit(0), F.lit(SIDE - 1))
        grid = frames.select("frame", F.explode(side).alias("height")).select("*", F.explode(side).alias("width"))
        return grid.join(cells, ["frame", *PIXEL], "left").select("frame", *PIXEL, F.coalesce("v", F.lit(0.0)).alias("value"))

    @cached_property
    def T(self) -> DataFrame:
        day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        sums = self.table("events").groupBy(F.col("user_id").alias("unit_id"), day.alias("frame")).agg(F.sum("value").alias("v"))
        last = sums.agg(F.max("frame").alias("last"))
        grid = sums.select("unit_id").distinct().crossJoin(F.broadcast(last)).select("unit_id", F.explode(F.sequence(F.lit(0), "last")).alias("frame"))
        return grid.join(sums, ["unit_id", "frame"], "left").select("unit_id", "frame", F.coalesce("v", F.lit(0.0)).alias("value"))

    @cached_property
    def A(self) -> DataFrame:
        at = self.table("embeddings").select(F.col("label").cast("long").alias("unit_id"), F.posexplode("embedding").alias("i", "v"))
        mean = at.groupBy("unit_id", "i").agg(F.avg(F.col("v").cast("double")).alias("value")).where("value > 0")
        return mean.select("unit_id", F.floor(F.col("i") / 8).cast("int").alias("height"), (F.col("i") % 8).cast("int").alias("width"), "value")

    @cached_property
    def C(self) -> DataFrame:
        norm = self.A.groupBy("unit_id").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
        dot = self.E.join(self.A.withColumnRenamed("value", "a"), PIXEL).groupBy("unit_id", "frame").agg(F.sum(F.col("value") * F.col("a")).alias("d"))
        return dot.join(F.broadcast(norm), "unit_id").select("unit_id", "frame", (F.col("d") / F.col("n")).alias("value"))

    @cached_property
    def bright(self) -> DataFrame:
        """Pixels of L whose greatest value exceeds the mean of these: (seed_id, height, width)."""
        top = self.L.groupBy(*PIXEL).agg(F.max("value").alias("v"))
        return top.crossJoin(F.broadcast(top.agg(F.avg("v").alias("m")))).where("v > m").select((F.col("height") * SIDE + F.col("width")).cast("long").alias("seed_id"), *PIXEL)


#: The same as common table expressions.
CTE = {
    "E": "E AS (SELECT vec_id::INT AS frame, ((i-1)//8)::INT AS height, ((i-1)%8)::INT AS width, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i))",
    "L": f"""Lc AS (SELECT ((year(l_shipdate)-1995)*12 + month(l_shipdate) - 1)::INT AS frame, (l_suppkey % {SIDE})::INT AS height, (l_partkey % {SIDE})::INT AS width, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
        L AS (SELECT f::INT AS frame, h::INT AS height, w::INT AS width, coalesce(v, 0.0) AS value
              FROM (SELECT unnest(range((SELECT min(frame) FROM Lc), (SELECT max(frame) + 1 FROM Lc))) AS f), range({SIDE}) a(h), range({SIDE}) b(w)
              LEFT JOIN Lc ON frame = f AND height = h AND width = w)""",
    "T": """Tc AS (SELECT user_id AS unit_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame, sum(value) AS v FROM events GROUP BY ALL),
        T AS (SELECT u.unit_id, f::INT AS frame, coalesce(v, 0.0) AS value FROM (SELECT DISTINCT unit_id FROM Tc) u, (SELECT unnest(range((SELECT max(frame) + 1 FROM Tc))) AS f)
              LEFT JOIN Tc ON Tc.unit_id = u.unit_id AND Tc.frame = f)""",
    "A": "A AS (SELECT label::BIGINT AS unit_id, ((i-1)//8)::INT AS height, ((i-1)%8)::INT AS width, avg(embedding[i]::DOUBLE) AS value FROM embeddings, range(1, 65) t(i) GROUP BY ALL HAVING avg(embedding[i]::DOUBLE) > 0)",
    "C": """C AS (SELECT d.unit_id, frame, d / n AS value FROM (SELECT unit_id, frame, sum(E.value * A.value) AS d FROM E JOIN A USING (height, width) GROUP BY ALL) d
              JOIN (SELECT unit_id, sum(value * value) AS n FROM A GROUP BY ALL) n ON n.unit_id = d.unit_id)""",
    "bright": f"""bright AS (SELECT (height * {SIDE} + width)::BIGINT AS seed_id, height, width FROM (SELECT height, width, max(value) AS v FROM L GROUP BY ALL)
              WHERE v > (SELECT avg(v) FROM (SELECT max(value) AS v FROM L GROUP BY height, width)))""",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query over the named inputs: sql("E A", "SELECT ...")."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n        ".join(CTE[n] for n in names.split()) + "\n        " + body
