"""Coefficient fields: rows (epoch, n, m, trig, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels

KEYS = ["n", "m", "trig"]


def band(field: DataFrame, min_degree: int = 0, max_degree: int | None = None, min_order: int = 0, max_order: int | None = None, step_degree: int = 1, step_order: int = 1) -> DataFrame:
    keep = (F.col("n") >= min_degree) & (F.col("m") >= min_order) & ((F.col("n") - min_degree) % step_degree == 0) & ((F.col("m") - min_order) % step_order == 0)
    for name, most in (("n", max_degree), ("m", max_order)):
        keep = keep if most is None else keep & (F.col(name) <= most)
    return field.where(keep)


def truncate(field: DataFrame, max_degree: int) -> DataFrame:
    return field.where(F.col("n") <= max_degree)


def scale(field: DataFrame, factor: float) -> DataFrame:
    return field.withColumn("value", F.col("value") * factor)


def combine(left: DataFrame, right: DataFrame, sign: int = 1, r_ratio: float = 1.0, gm_ratio: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """left + sign * right, right rescaled to the left radius and GM; missing coefficients are 0. keys: further keys, like epoch."""
    on = [*keys, *KEYS]
    factor = sign * gm_ratio * F.pow(F.lit(r_ratio), F.col("n").cast("double"))
    both = left.select(*on, "value").unionByName(right.select(*on, (F.col("value") * factor).alias("value")))
    return both.groupBy(*on).agg(F.sum("value").alias("value"))


def upsert(field: DataFrame, added: DataFrame, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Rows of added replace those of field with the same key; sine coefficients of order 0 are ignored."""
    new = added.where("not (m = 0 and trig = 1)")
    return field.join(new.select(*keys, *KEYS), [*keys, *KEYS], "left_anti").unionByName(new)


def degree_amplitudes(field: DataFrame, max_order: int | None = None, scale_: float = 1.0) -> DataFrame:
    used = field if max_order is None else field.where(F.col("m") <= max_order)
    return used.groupBy("epoch", "n").agg((F.sqrt(F.sum(F.col("value") * F.col("value"))) * scale_).alias("amplitude"))


def coefficient_amplitudes(field: DataFrame) -> DataFrame:
    c, s = (F.coalesce(F.max(F.when(F.col("trig") == t, F.col("value"))), F.lit(0.0)) for t in (0, 1))
    return field.groupBy("epoch", "n", "m").agg(F.sqrt(c * c + s * s).alias("amplitude"), c.alias("_c"), s.alias("_s")).select("epoch", "n", "m", "amplitude", F.when(F.col("m") == 0, 0.0).otherwise(F.atan2("_s", "_c")).alias("phase"))


def gaussian_filter(field: DataFrame, radius: float, max_degree: int) -> DataFrame:
    """Degrees 2 and up by the weights of the radius (km)."""
    weights = F.broadcast(kernels.gauss(field.sparkSession, radius, max_degree))
    return field.join(weights, "n", "left").withColumn("value", F.when(F.col("n") < 2, F.col("value")).otherwise(F.col("value") * F.coalesce("w", F.lit(0.0)))).drop("w")


def butterworth_filter(field: DataFrame, order: int, cutoff: float) -> DataFrame:
    return field.withColumn("value", F.col("value") * kernels.butterworth(F.col("n"), order, cutoff))


def matrix_filter(field: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows (i_n, i_m, i_trig, n, m, trig, v) of a matrix applied to each epoch's coefficients."""
    product = field.join(matrix, KEYS)
    return product.groupBy("epoch", F.col("i_n").alias("n"), F.col("i_m").alias("m"), F.col("i_trig").alias("trig")).agg(F.sum(F.col("v") * F.col("value")).alias("value"))


def ordered(field: DataFrame, sequence: str) -> DataFrame:
    """Adds idx, the position in one of the usual orderings within an epoch (band-limited, so a group is a field)."""
    from pyspark.sql import Window as W

    by = {"degree": ["n", "m", "trig"], "order_alternating": ["m", "n", "trig"], "order": ["m", "trig", "n"]}
    if sequence == "flat":
        row = F.when(F.col("trig") == 0, F.col("n")).otherwise(F.col("m") - 1)
        column = F.when(F.col("trig") == 0, F.col("m")).otherwise(F.col("n"))
        key = [row, column]
    elif sequence in by:
        key = by[sequence]
    else:
        raise ValueError(f"no sequence {sequence}")
    return field.withColumn("idx", F.row_number().over(W.partitionBy("epoch").orderBy(*key)) - 1)


def packed_index(min_degree: int = 0) -> Column:
    """Position of (n, m, trig) in the degree-wise vector that starts at a degree."""
    return F.col("n") * F.col("n") + F.when(F.col("m") == 0, 0).otherwise(2 * F.col("m") - 1 + F.col("trig")) - min_degree * min_degree


def all_coefficients(spark: SparkSession, max_degree: int, min_degree: int = 0) -> DataFrame:
    """Rows (n, m, trig) of every coefficient of the degrees."""
    rows = spark.range(min_degree, max_degree + 1).select(F.col("id").cast("int").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("m"))
    return rows.select("n", "m", F.explode(F.when(F.col("m") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("trig"))


def raveled(field: DataFrame, min_degree: int, max_degree: int) -> DataFrame:
    """Rows (epoch, idx, value) of the degree-wise vectors, 0 where a field lacks a coefficient."""
    wanted = all_coefficients(field.sparkSession, max_degree, min_degree)
    keys = field.select("epoch").distinct().crossJoin(F.broadcast(wanted))  # (max_degree + 1)^2 rows
    full = keys.join(field.select("epoch", *KEYS, "value"), ["epoch", *KEYS], "left")
    return full.select("epoch", packed_index(min_degree).alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value"))


def unraveled(vectors: DataFrame, min_degree: int = 0) -> DataFrame:
    """Fields of degree-wise vectors (epoch, idx, value)."""
    at = F.col("idx") + min_degree * min_degree
    n = F.floor(F.sqrt(at)).cast("int")
    rest = at - n * n
    return vectors.select("epoch", n.alias("n"), F.floor((rest + 1) / 2).cast("int").alias("m"), F.when(rest == 0, 0).otherwise((rest + 1) % 2).cast("int").alias("trig"), "value")


def reorder_indices(field: DataFrame, source: str, target: str) -> DataFrame:
    """Rows (epoch, source_idx, target_idx) of the coefficients in two orderings."""
    a = ordered(field, source).select("epoch", *KEYS, F.col("idx").alias("source_idx"))
    b = ordered(field, target).select("epoch", *KEYS, F.col("idx").alias("target_idx"))
    return a.join(b, ["epoch", *KEYS]).select("epoch", "source_idx", "target_idx")


def combine_series(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """left + sign * right at equal epochs; an epoch that only one side has makes the query fail."""
    sides = left.select("epoch").distinct().withColumn("_l", F.lit(1)).join(right.select("epoch").distinct().withColumn("_r", F.lit(1)), "epoch", "full")
    bad = sides.agg(F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("_bad"))
    total = combine(left, right, sign, keys=("epoch",)).crossJoin(F.broadcast(bad))  # one row
    value = F.when(F.col("_bad") > 0, F.raise_error(F.lit("the series have different epochs")).cast("double")).otherwise(F.col("value"))
    return total.withColumn("value", value).drop("_bad")


def power_law(variances: DataFrame) -> DataFrame:
    """One row (factor, power) of factor^2 n^-power fitted to squared rows (n, value) in logarithms."""
    x, y = F.log(F.col("n")), 2 * F.log("value")
    fit = variances.where("n > 0 and value > 0").agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return fit.select(F.exp(F.col("_a") / 2).alias("factor"), (-F.col("_b")).alias("power"))


def coefficient_triangle(field: DataFrame, max_degree: int, min_degree: int = 2, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """One row a degree, columns s{N} ... s1, c0 ... c{N} from the sine of the highest order to its cosine; null where none is.

    Degrees below min_degree keep their rows, without values.
    """
    order = F.concat(F.when(F.col("trig") == 1, "s").otherwise("c"), F.col("m").cast("string"))
    names = [f"s{m}" for m in range(max_degree, 0, -1)] + [f"c{m}" for m in range(max_degree + 1)]
    shown = F.when(F.col("n") >= min_degree, F.col("value"))
    return field.where(F.col("n") <= max_degree).select(*keys, "n", order.alias("order"), shown.alias("value")).groupBy(*keys, "n").pivot("order", names).agg(F.first("value"))
