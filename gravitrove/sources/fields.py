"""Readers of coefficient files; each yields rows (path, n, m, trig, value) or the header's scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))


def _number(x):
    return F.regexp_replace(x, "[dD]", "e").cast("double")


def _long(rows: DataFrame, max_degree: int | None) -> DataFrame:
    found = rows.select("path", F.get("w", F.lit(1)).cast("int").alias("n"), F.get("w", F.lit(2)).cast("int").alias("m"), F.explode(F.array(F.struct(F.lit(0).alias("trig"), _number(F.get("w", F.lit(3))).alias("value")), F.struct(F.lit(1).alias("trig"), _number(F.get("w", F.lit(4))).alias("value")))).alias("c"))
    found = found.select("path", "n", "m", "c.trig", "c.value").where("not (m = 0 and trig = 1)")
    return found if max_degree is None else found.where(F.col("n") <= max_degree)


def read_gfc(spark: SparkSession, path: str, max_degree: int | None = None) -> DataFrame:
    """Coefficients of ICGEM files, compressed ones too."""
    return _long(_lines(spark, path).where(F.get("w", F.lit(0)) == "gfc"), max_degree)


def gfc_header(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, radius, gm) a file."""
    def scalar(name):
        return F.max(F.when(F.get("w", F.lit(0)) == name, _number(F.get("w", F.lit(1)))))

    return _lines(spark, path).groupBy("path").agg(scalar("radius").alias("radius"), scalar("earth_gravity_constant").alias("gm"))


def read_grcof2(spark: SparkSession, path: str, max_degree: int | None = None) -> DataFrame:
    """Coefficients of monthly solution files with GRCOF2 rows."""
    return _long(_lines(spark, path).where(F.get("w", F.lit(0)) == "GRCOF2"), max_degree)
