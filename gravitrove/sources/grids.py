"""Grids as Parquet: a point set keeps its columns and types, whoever reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINT_COLUMNS = ("lon", "lat")


def save_grid(grid: DataFrame, path: str) -> None:
    """Writes the rows of a grid; an existing path is refused."""
    if missing := [c for c in POINT_COLUMNS if c not in grid.columns]:
        raise ValueError(f"a grid needs the columns {missing}")
    grid.write.mode("errorifexists").parquet(path)


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    grid = spark.read.parquet(path)
    if missing := [c for c in POINT_COLUMNS if c not in grid.columns]:
        raise ValueError(f"no grid: {path} lacks {missing}")
    return grid
