"""Time series: binning, interpolation, trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored


def bin_to_centres(series: DataFrame, by: list[str], start: float, step: float, count: int, reduce: Column) -> DataFrame:
    """Each row goes to the nearest of count equally spaced centres, halfway to the later one; reduce is the aggregate."""
    k = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor((F.col("mjd") - start) / step + 0.5)))
    return series.groupBy(*by, (F.lit(start) + k * step).alias("centre")).agg(reduce)


def interpolate(series: DataFrame, epochs: DataFrame, by: str) -> DataFrame:
    """Piecewise linear values at epochs (by, moment), by an as-of union: no row meets more than its neighbours.

    Epochs outside the first and last value of their series get no row; of values at the same time the mean counts.
    """
    known = series.groupBy(by, F.col("mjd").alias("t")).agg(F.avg("value").alias("v"))
    both = known.withColumn("kind", F.lit(0)).unionByName(epochs.select(by, F.col("moment").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")).distinct())
    point = F.when(F.col("kind") == 0, F.struct("t", "v"))
    before = W.partitionBy(by).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(by).orderBy(F.col("t").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumns({"a": F.last(point, ignorenulls=True).over(before), "b": F.last(point, ignorenulls=True).over(after)}).where("kind = 1 and a is not null and b is not null")
    share = F.when(F.col("b.t") == F.col("a.t"), 0.0).otherwise((F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return near.select(by, F.col("t").alias("moment"), ((1 - share) * F.col("a.v") + share * F.col("b.v")).alias("value"))


def trend(series: DataFrame, by: list[str], reference: float) -> DataFrame:
    """Least-squares constant and slope (a day) since the reference, from sums that combine on the map side."""
    t, v = F.col("mjd") - reference, F.col("value")
    s = series.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"), F.sum(v).alias("v"), F.sum(t * v).alias("tv"))
    det = F.col("n") * F.col("tt") - F.col("t") * F.col("t")
    slope = (F.col("n") * F.col("tv") - F.col("t") * F.col("v")) / det
    return s.select(*by, ((F.col("v") - slope * F.col("t")) / F.col("n")).alias("constant"), slope.alias("slope"))


def detrend(series: DataFrame, by: list[str], reference: float) -> DataFrame:
    """The series minus its trend."""
    fitted = trend(series, by, reference)
    return series.join(fitted, by).withColumn("value", F.col("value") - F.col("constant") - F.col("slope") * (F.col("mjd") - reference)).drop("constant", "slope")


def segments(series: DataFrame, by: str, gap: float) -> DataFrame:
    """Adds segment: a number that grows after each gap longer than `gap` days."""
    order = W.partitionBy(by).orderBy("mjd", "event_id")
    jump = F.coalesce(F.col("mjd") - F.lag("mjd").over(order) > gap, F.lit(False)).cast("int")
    return series.withColumn("_jump", jump).withColumn("segment", F.sum("_jump").over(order)).drop("_jump")


def polynomial(degree: int, reference: float = 0.0) -> dict[str, Column]:
    """Columns t0, t1, ... of powers of the days since the reference."""
    return {f"t{k}": F.pow(F.col("mjd") - reference, F.lit(float(k))) for k in range(degree + 1)}


def oscillation(period: float, reference: float = 0.0) -> dict[str, Column]:
    """Cosine and sine of a period in days."""
    angle = 2 * math.pi / period * (F.col("mjd") - reference)
    return {f"cos{period:g}": F.cos(angle), f"sin{period:g}": F.sin(angle)}


def fit(series: DataFrame, by: list[str], basis: dict[str, Column]) -> DataFrame:
    """Least-squares factors of the basis, one row a series with a column for each.

    Normal equations are sums that combine on the map side; a row of them is solved by the pseudo-inverse, as the
    basis can be degenerate for a short series.
    """
    names = list(basis)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = series.where(F.col("value").isNotNull()).select(*by, "value", *[c.alias(f"_{k}") for k, c in enumerate(basis.values())])
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in pairs]).alias("_n"), F.array(*[F.sum(F.col(f"_{i}") * F.col("value")) for i in range(len(names))]).alias("_r"))

    def solve(batches):
        upper = tuple(np.array(pairs).T)
        for batch in batches:
            matrix = np.zeros((len(batch), len(names), len(names)))
            for k, row in enumerate(batch["_n"]):
                matrix[k][upper] = row
            full = matrix + np.transpose(np.triu(matrix, 1), (0, 2, 1))
            x = np.einsum("kij,kj->ki", np.linalg.pinv(full, hermitian=True), np.array([*batch["_r"]]).reshape(len(batch), -1))
            yield batch[by].assign(**{n: x[:, i] for i, n in enumerate(names)})

    schema = sums.select(*by).schema
    for n in names:
        schema = schema.add(n, "double")
    return sums.mapInPandas(solve, schema)


def reduce_by(series: DataFrame, by: list[str], basis: dict[str, Column]) -> DataFrame:
    """The series minus its fit of the basis."""
    factors = fit(series, by, basis)
    fitted = sum((F.col(f"_f.{n}") * c for n, c in basis.items()), F.lit(0.0))
    joined = series.join(factors.select(*by, F.struct(*basis).alias("_f")), by)
    return joined.withColumn("value", F.col("value") - fitted).drop("_f")


def evaluate_trend(field: DataFrame, moments: list[float], reference: float, scale: float = 365.25) -> DataFrame:
    """A field of rates (a unit of scale days) at each moment: rows of the field for every mjd."""
    at = field.withColumn("mjd", F.explode(F.array(*map(F.lit, moments))))
    return at.withColumn("value", F.col("value") * (F.col("mjd") - reference) / scale)


def evaluate_oscillation(cosine: DataFrame, sine: DataFrame, moments: list[float], period: float, reference: float, keys: tuple[str, ...] = ("n", "m", "trig")) -> DataFrame:
    """Fields of cosine and sine amplitudes at each moment; a missing coefficient is 0."""
    both = cosine.select(*keys, F.col("value").alias("c")).join(sine.select(*keys, F.col("value").alias("s")), [*keys], "full")
    at = both.withColumn("mjd", F.explode(F.array(*map(F.lit, moments))))
    angle = 2 * math.pi * (F.col("mjd") - reference) / period
    zero = F.lit(0.0)
    return at.select(*keys, "mjd", (F.coalesce("c", zero) * F.cos(angle) + F.coalesce("s", zero) * F.sin(angle)).alias("value"))


def total(*constituents: DataFrame, keys: tuple[str, ...] = ("n", "m", "trig", "mjd")) -> DataFrame:
    """Sum of constituents at the same moments."""
    rows = constituents[0].select(*keys, "value")
    for c in constituents[1:]:
        rows = rows.unionByName(c.select(*keys, "value"))
    return rows.groupBy(*keys).agg(F.sum("value").alias("value"))


def packed(field: DataFrame, by: str = "epoch", index: str = "idx") -> DataFrame:
    """One array of values a field, in the order of an index; a field is bounded by its degree."""
    pairs = F.array_sort(F.collect_list(F.struct(index, "value")))
    return field.groupBy(by).agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def spectrum(series: DataFrame, by: list[str], step: float, length: int = 256, window: str = "boxcar") -> DataFrame:
    """Power of each series at the frequencies of segments of equal length, by least squares: rows (frequency, psd).

    Segments of fewer than three values are left out; a frequency's cosine and sine are fitted over all segments at once.
    """
    if window not in ("boxcar", "hann"):
        raise ValueError(f"no window {window}")
    order = W.partitionBy(*by).orderBy("mjd")
    rows = series.withColumn("_row", F.row_number().over(order) - 1).withColumn("_segment", F.floor(F.col("_row") / length))
    rows = rows.withColumn("_size", F.count("*").over(W.partitionBy(*by, "_segment"))).where("_size >= 3")
    taper = F.lit(1.0) if window == "boxcar" else 0.5 - 0.5 * F.cos(2 * math.pi * (F.col("_row") % length) / F.col("_size"))
    waves = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    single = (F.col("_k") == 0) if length % 2 else F.col("_k").isin(0, length // 2)
    angle = 2 * math.pi / (length * step) * F.col("_k") * F.col("mjd")
    cosine = F.when(F.col("_k") == 0, 1.0).when(single, F.when(F.col("_row") % length % 2 == 1, -1.0).otherwise(1.0)).otherwise(F.cos(angle))
    waves = waves.select(*by, "_k", single.alias("_one"), (taper * taper).alias("w"), "value", cosine.alias("c"), F.when(single, 0.0).otherwise(F.sin(angle)).alias("s"))
    c, s, w, v = (F.col(x) for x in ("c", "s", "w", "value"))
    terms = {"cc": c * c, "cs": c * s, "ss": s * s, "wcc": w * c * c, "wcs": w * c * s, "wss": w * s * s, "wcv": w * c * v, "wsv": w * s * v}
    sums = waves.groupBy(*by, "_k", "_one").agg(*[F.sum(t).alias(n) for n, t in terms.items()])
    det = F.expr("wcc * wss - wcs * wcs")
    sums = sums.withColumns({"x": F.when(F.col("_one"), F.expr("wcv / wcc")).otherwise(F.expr("wss * wcv - wcs * wsv") / det), "y": F.when(F.col("_one"), 0.0).otherwise(F.expr("wcc * wsv - wcs * wcv") / det)})
    return sums.select(*by, (F.col("_k") / (length * step)).alias("frequency"), (F.expr("x * x * cc + 2 * x * y * cs + y * y * ss") / step * math.sqrt(2)).alias("psd"))


def value_runs(series: DataFrame, by: list[str], step: float, length: int) -> DataFrame:
    """Rows (by, segment, values): runs of at most `length` values whose gaps are no longer than one and a half steps."""
    line = W.partitionBy(*by).orderBy("mjd")
    opened = series.withColumn("_gap", F.coalesce((F.col("mjd") - F.lag("mjd").over(line) > 1.5 * step).cast("int"), F.lit(0)))
    runs = opened.withColumn("_run", F.sum("_gap").over(line))
    placed = runs.withColumn("_place", F.row_number().over(W.partitionBy(*by, "_run").orderBy("mjd")) - 1)
    cut = placed.withColumn("_part", F.floor(F.col("_place") / length))
    held = F.array_sort(F.collect_list(F.struct("_place", F.col("value").cast("double").alias("value"))))
    return cut.groupBy(*by, "_run", "_part").agg(F.transform(held, lambda x: x["value"]).alias("values")).select(*by, F.struct("_run", "_part").alias("segment"), "values")


def component_spectrum(series: DataFrame, by: list[str], step: float, length: int = 256, variance: float = 1.0, iterations: int = 5) -> DataFrame:
    """Power of each series by variance components of the lines of a cosine transform: rows (by, frequency, psd).

    The covariance of two values k steps apart is the transform of the components. In every iteration each segment
    is weighed by the inverse of its Toeplitz matrix, and adds, for each lag, the products of its weighed residuals and the
    sums of the inverse's diagonals; their transforms give a factor for each component. An iteration is one pass over the
    segments, and what the driver holds is `length` components a series. Segments of one value count for nothing.
    """
    held = stored(value_runs(series, by, step, length).where(F.size("values") > 1))
    n = held.agg(F.max(F.size("values"))).first()[0]
    schema = held.select(*by).schema.add("frequency", "double").add("psd", "double")
    if n is None:
        return held.sparkSession.createDataFrame([], schema)
    i, j = np.indices((n, n))
    transform = 2 * np.cos(np.pi * i * j / (n - 1)) / np.sqrt(2 * (n - 1))
    transform[:, [0, -1]] /= 2
    start = transform[:, 0] * variance
    components = {tuple(r): start.copy() for r in held.select(*by).distinct().collect()}  # a row a series
    for _ in range(iterations):
        lags = {k: transform @ v for k, v in components.items()}

        def run(batches):
            sums, inverses = {}, {}
            for batch in batches:
                for *key, values in batch[[*by, "values"]].itertuples(index=False):
                    key, m = tuple(key), len(values)
                    if (key, m) not in inverses:
                        inverse = np.linalg.inv(lags[key][np.abs(np.subtract.outer(np.arange(m), np.arange(m)))])
                        inverses[key, m] = inverse, np.array([inverse.trace(k) for k in range(m)])
                    inverse, traces = inverses[key, m]
                    e = inverse @ values
                    found = sums.setdefault(key, np.zeros((2, n)))
                    found[0, :m] += np.correlate(e, e, "full")[m - 1 :]
                    found[1, :m] += traces
            for key, (squares, redundancy) in sums.items():
                yield pd.DataFrame({**dict(zip(by, key)), "lag": np.arange(n), "squares": squares, "redundancy": redundancy})

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.select(*by).schema)
        rows = held.mapInPandas(run, f"{kinds}, lag int, squares double, redundancy double").groupBy(*by, "lag").agg(F.sum("squares"), F.sum("redundancy")).collect()
        totals = {k: np.zeros((2, n)) for k in components}
        for r in rows:
            totals[tuple(r[: len(by)])][:, r["lag"]] = np.array(r[len(by) + 1 :]) * (1 if r["lag"] == 0 else 2)
        components = {k: v * (totals[k][0] @ transform) / (totals[k][1] @ transform) for k, v in components.items()}
    frequency = np.linspace(0, 0.5 / step, n)
    rows = [(*k, float(f), float(p * step * np.sqrt(2 * (n - 1)))) for k, v in components.items() for f, p in zip(frequency, v)]
    return held.sparkSession.createDataFrame(rows, schema)


def bins_with_gaps(series: DataFrame, by: list[str], start: float, step: float, count: int, no_data: float = float("nan")) -> DataFrame:
    """Means about every centre; empty ones get no_data."""
    means = bin_to_centres(series, by, start, step, count, F.avg("value").alias("mean"))
    centres = series.select(*by).distinct().withColumn("centre", F.explode(F.array(*[F.lit(float(start + k * step)) for k in range(count)])))
    return centres.join(means, [*by, "centre"], "left").withColumn("mean", F.coalesce("mean", F.lit(no_data)))


def evaluate_at(series: DataFrame, moment: float, by: str) -> DataFrame:
    """Every series at one moment, rows (by, moment, value): interpolate() at that epoch."""
    return interpolate(series, series.select(by).distinct().withColumn("moment", F.lit(float(moment))), by)
