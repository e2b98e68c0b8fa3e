"""Column expressions of field imagery: guarded arithmetic, calibration and vegetation indices. Missing is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands (nm) where water vapour absorbs.
WATER = ((1340.0, 1440.0), (1800.0, 1950.0))
#: What stands for no measurement in raw cubes.
IGNORED = (-1.0, 15000.0)
EPS = 1e-6


def denan(c: Column) -> Column:
    """NaN to null: Spark orders NaN above all numbers, and aggregates pass it on."""
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_div(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b, or null where b is nearly 0."""
    return F.when(F.abs(b) >= eps, a / b)


def guarded_corr(a: str, b: str, least: int = 10) -> Column:
    """Pearson correlation as an aggregate; null for constant columns and for no more than ``least`` pairs."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.when(both, 1)) > least, F.covar_pop(x, y) / F.when(spread > 0, spread))


def reflectance(dn: Column, scale: float = 10000.0, low: float = 0.0, high: float = 1.2, ignored: tuple[float, ...] = IGNORED) -> Column:
    """Digital number to reflectance; null for ignored values and outside [low, high]."""
    value = dn / F.lit(scale)
    return F.when(~dn.isin(*ignored) & value.between(low, high), value)


def in_windows(wl: Column, windows=WATER, inclusive: bool = False) -> Column:
    """Whether a wavelength lies in one of the windows, without their ends unless ``inclusive``."""
    hit = F.lit(False)
    for low, high in windows:
        hit = hit | (wl.between(low, high) if inclusive else (wl > low) & (wl < high))
    return hit


def band(refl: Column, index: int) -> Column:
    """The value of a band by its index from 0."""
    return F.element_at(refl, index + 1)


def ndvi(red: Column, nir: Column) -> Column:
    return (nir - red) / (nir + red + F.lit(EPS))


def normalised(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), guarded; the red-edge index and the photochemical index have this form."""
    return safe_div(a - b, a + b)


def ci_green(nir: Column, green: Column) -> Column:
    return safe_div(nir, green) - 1


def ratio_eps(a: Column, b: Column) -> Column:
    """a / (b + a small constant), without a guard."""
    return a / (b + F.lit(EPS))


def psri(red: Column, blue: Column, edge: Column) -> Column:
    return safe_div(red - blue, edge)


def red_edge_bonus(wl: Column, low: float = 680.0, peak: float = 715.0, high: float = 750.0, most: float = 0.2) -> Column:
    """A triangle over the red edge, ``most`` at its peak."""
    rise, fall = (wl - low) / (peak - low), (high - wl) / (high - peak)
    return F.when(wl.between(low, high), most * F.least(rise, fall)).otherwise(0.0)


def above(value: Column, threshold: float) -> Column:
    """value > threshold, false where there is no value."""
    return F.coalesce(value > threshold, F.lit(False))


def portable_hash(c: Column, seed: int = 42) -> Column:
    """An arithmetic hash in [0, 2**32) that any SQL engine can repeat."""
    return F.pmod((c.cast("long") + seed) * F.lit(2654435761), F.lit(4294967296))
