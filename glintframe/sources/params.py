"""Parameter tables: a row per step, with up to five names and values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names that steps and parameters go by.
ALIASES = {"background_removal": "remove_background", "dif_thres": "diff_thres", "deglow": "remove_glow"}
COLUMNS = ["function", *[f"{k}{i}" for i in range(1, 6) for k in "pv"]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(function, name, value): names that are empty or "Nan" are left out."""
    return unpivot(spark.read.option("header", True).csv(path))


def unpivot(table: DataFrame) -> DataFrame:
    pairs = ", ".join(f"p{i}, v{i}" for i in range(1, 6))
    rows = table.selectExpr("trim(function) AS function", f"stack(5, {pairs}) AS (name, value)")
    return rows.where("name is not null and trim(name) <> '' and lower(trim(name)) <> 'nan'").select("function", F.trim("name").alias("name"), F.trim("value").alias("value"))


def kind(value: str = "value"):
    """What a value's text is: int, float, bool, none, tuple or string."""
    v = F.col(value)
    return (
        F.when(v.rlike(r"^\d+$"), "int").when(v.rlike(r"^\d*\.\d+$|^\d+\.\d*$"), "float").when(F.upper(v).isin("TRUE", "FALSE"), "bool")
        .when(v.isNull() | (F.lower(v) == "none"), "none").when(v.rlike(r"^\(.*\)$"), "tuple").otherwise("string")
    )


def parsed(value: str | None):
    """The Python value: number, truth value, None, tuple or the string itself."""
    text = (value or "").strip()
    if not text or text.lower() == "none":
        return None
    if text.startswith("(") and text.endswith(")"):
        return tuple(parsed(x) for x in text[1:-1].split(",") if x.strip())
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if re.fullmatch(r"\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"\d*\.\d+|\d+\.\d*", text) else text


def as_dict(params: DataFrame) -> dict[str, dict]:
    """Parameters by step, aliases resolved; the table is small."""
    out: dict[str, dict] = {}
    for r in params.collect():
        out.setdefault(ALIASES.get(r["function"], r["function"]), {})[ALIASES.get(r["name"], r["name"])] = parsed(r["value"])
    return out


def write(params: dict[str, dict], path: str, spark: SparkSession) -> None:
    """The same table back, a row per step."""
    rows = []
    for step, values in params.items():
        flat = [x for k, v in values.items() for x in (k, str(v).upper() if isinstance(v, bool) else str(v))]
        rows.append((step, *(flat + [None] * 10)[:10]))
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
