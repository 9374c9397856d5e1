"""Per-degree transfer functions as columns and tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gravitational constant and density of sea water of the water-height kernel.
GRAVITY, RHO = 6.673e-11, 1025.0


def water_height(n: Column, load_love: Column, r: float = 6378136.3, rho: float = RHO) -> Column:
    return 4 * math.pi * GRAVITY * rho * r * (1 + load_love) / (2 * n + 1)


def surface_density(n: Column, load_love: Column, r: float = 6378136.3) -> Column:
    return water_height(n, load_love, r, 1.0)


def gravity_anomaly(n: Column, r: float = 6378136.3) -> Column:
    return F.when(n == 1, 0.0).otherwise(r / (n - 1))


def upward(n: Column, r: Column | float, base: float = 6378136.3) -> Column:
    return F.pow(base / (r if isinstance(r, Column) else F.lit(r)), n + 1)


def inverse(k: Column) -> Column:
    """1 / k, and 0 where k is as good as 0."""
    return F.when(F.abs(k) <= 1e-8, 0.0).otherwise(1 / k)


def gauss_weights(radius: float, max_degree: int) -> list[float]:
    """Weights of degrees 0 to max_degree for a radius in kilometres; 0 after the first below 1e-7."""
    if radius < 0:
        raise ValueError("the radius of a Gaussian filter can't be negative")
    if radius == 0:
        return [1.0] * (max_degree + 1)
    b = math.log(2) / (1 - math.cos(radius / 6378.1366))
    w = [1.0, (1 + math.exp(-2 * b)) / (1 - math.exp(-2 * b)) - 1 / b]
    while len(w) <= max_degree and (len(w) < 3 or w[-1] >= 1e-7):
        n = len(w)
        w.append(-(2 * n - 1) / b * w[-1] + w[-2])
    return (w + [0.0] * max_degree)[: max_degree + 1]


def gauss(spark: SparkSession, radius: float, max_degree: int) -> DataFrame:
    """One row (n, w) a degree: small enough to broadcast."""
    return spark.createDataFrame(list(enumerate(gauss_weights(radius, max_degree))), "n int, w double")


def butterworth(n: Column, order: int, cutoff: float) -> Column:
    return F.pow(1 + F.pow(n / F.lit(float(cutoff)), F.lit(2.0 * order)), F.lit(-0.5))


def kaula(n: Column, factor: float = 1e-10, power: float = 4.0) -> Column:
    return factor * F.pow(n.cast("double"), F.lit(-power))


#: The names of kernels, and the formulas by degree n, radius r, normal gravity g and load Love numbers k and h.
NAMES = {
    "ewh": "water_height", "water_height": "water_height", "obp": "ocean_bottom_pressure", "ocean_bottom_pressure": "ocean_bottom_pressure",
    "potential": "potential", "geoid": "geoid_height", "geoid_height": "geoid_height", "surface_density": "surface_density",
    "anomaly": "gravity_anomaly", "gravity_anomaly": "gravity_anomaly", "deformation": "vertical_deformation",
    "vertical_deformation": "vertical_deformation", "vertical_derformation": "vertical_deformation", "uplift": "uplift",
}


def kernel(name: str):
    """The kernel's factor as a function of the columns (n, r, g, k, h)."""
    load = 4 * math.pi * GRAVITY
    formulas = {
        "water_height": lambda n, r, g, k, h: load * RHO * r * (1 + k) / (2 * n + 1),
        "ocean_bottom_pressure": lambda n, r, g, k, h: load * r / g * (1 + k) / (2 * n + 1),
        "potential": lambda n, r, g, k, h: F.lit(1.0),
        "geoid_height": lambda n, r, g, k, h: g,
        "surface_density": lambda n, r, g, k, h: load * r * (1 + k) / (2 * n + 1),
        "gravity_anomaly": lambda n, r, g, k, h: F.when(n == 1, 0.0).otherwise(r / (n - 1)),
        "vertical_deformation": lambda n, r, g, k, h: g * (1 + k) / F.when(h != 0, h),
        "uplift": lambda n, r, g, k, h: 2 * g / (2 * n + 1),
    }
    if name.lower() not in NAMES:
        raise ValueError(f"no kernel {name}")
    formula = formulas[NAMES[name.lower()]]
    return lambda n, r=F.lit(6378136.3), g=F.lit(None), k=F.lit(0.0), h=F.lit(None): formula(n, r, g, k, h)


def in_frame(love: DataFrame, frame: str) -> DataFrame:
    """Love numbers (n, h, l, k) of the centre of the solid Earth (CE), moved to the centre of mass (CM) or of figure (CF)."""
    frame = frame.upper()
    if frame not in ("CE", "CM", "CF"):
        raise ValueError(f"no frame {frame}")
    if frame == "CE":
        return love
    h, l, k = F.col("h"), F.col("l"), F.col("k")  # noqa: E741
    shift = k * 0 + 1.0 if frame == "CM" else (h + 2 * l) / 3
    first = {"CM": {"h": h - shift, "l": l - shift, "k": k - shift}, "CF": {"h": (h - l) * 2 / 3, "l": (l - h) / 3, "k": -shift}}[frame]
    return love.withColumns({c: F.when(F.col("n") == 1, v).otherwise(F.col(c)) for c, v in first.items()})
