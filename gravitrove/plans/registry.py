"""Where the modules of this folder enter their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Enters the function under its name; sql is what DuckDB runs for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})
