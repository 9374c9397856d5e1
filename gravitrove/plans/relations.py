"""The engine's relations, derived from the star-schema tables: coefficient fields, points, grids, series, basins, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly fields (epoch, n, m, trig, value), degrees 0 to 8; trig 0 is cosine, 1 sine."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("epoch"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 81).cast("int").alias("idx"),
        "l_extendedprice",
    )
    # The odd factor keeps means of prices in whole cents off the halves, where two engines may round apart.
    means = lines.groupBy("epoch", "idx").agg((F.avg("l_extendedprice") * 1.0471975512e-9).alias("value"))
    return unpacked(means, "idx").select("epoch", "n", "m", "trig", "value")


def unpacked(df: DataFrame, index: str) -> DataFrame:
    """Adds n, m and trig to rows with a degree-wise index: n * n + (0, or 2 m - 1 for cosine, 2 m for sine)."""
    n = F.floor(F.sqrt(index)).cast("int")
    rest = F.col(index) - n * n
    trig = F.when(rest == 0, 0).otherwise((rest + 1) % 2)
    return df.withColumns({"n": n, "m": F.floor((rest + 1) / 2).cast("int"), "trig": trig.cast("int")})


def packed_index(n: str = "n", m: str = "m", trig: str = "trig"):
    return F.col(n) * F.col(n) + F.when(F.col(m) == 0, 0).otherwise(2 * F.col(m) - 1 + F.col(trig))


def points(spark: SparkSession, sf_dir: str, name: str = "supplier") -> DataFrame:
    """Scattered points: the suppliers, or the customers, spread over the sphere by their keys."""
    prefix = {"supplier": "s_supp", "customer": "c_cust"}[name]
    key = F.col(f"{prefix}key")
    return table(spark, sf_dir, name).select(
        key.cast("long").alias("point_id"),
        F.radians((key * 1.3750776405e2) % 360 - 180).alias("lon"),
        F.asin(2.0 * ((key * 6.180339887e-1) % 1) - 1.0).alias("lat"),
        F.col(f"{prefix[:2]}acctbal").alias("value"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.time import mjd

    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", mjd("ts").alias("mjd"), "value")


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rectangles, 54 by 60 degrees, as closed rings of vertices (basin_id, ring, seq, lon, lat)."""
    corners = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)], "seq int, dx int, dy int")
    lon = F.radians(-171.0 + 72.0 * F.col("r_regionkey") + 54.0 * F.col("dx"))
    ring = table(spark, sf_dir, "region").crossJoin(F.broadcast(corners))  # four corners a basin
    return ring.select(F.col("r_regionkey").alias("basin_id"), F.lit(0).alias("ring"), "seq", lon.alias("lon"), F.radians(-30.0 + 60.0 * F.col("dy")).alias("lat"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in coordinate form (i, j, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "e")).select("i", "j", F.col("e").cast("double").alias("v"))


def love_numbers(spark: SparkSession, max_degree: int = 8) -> DataFrame:
    """Synthetic load Love numbers (n, h, l, k), for queries only."""
    n = F.col("n")
    return spark.range(max_degree + 1).select(F.col("id").cast("int").alias("n")).select("n", F.when(n == 0, 0.0).otherwise(-1.0 / (n + 1)).alias("h"), F.when(n == 0, 0.0).otherwise(0.05 / (n + 1)).alias("l"), F.when(n < 2, 0.0).otherwise(-0.6 / (n + 1)).alias("k"))
