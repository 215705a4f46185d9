"""Display transfer curves, colour arithmetic and trilogy levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the transfer curves and the default trilogy knobs.
LOG_SOFTENING = 1000.0
ASINH_SOFTENING = 0.1
DEFAULT_K = LOG_SOFTENING
NOISELUM = 0.15
SATPERCENT = 0.001
NOISESIG = 1.0
NOISESIG0 = 2.0
MAX_BANDS = 12
MAX_SATURATION = 4.0

MODES = ("linear", "log", "sqrt", "asinh", "trilogy")


def trilogy_curve(x: Column, k: Column) -> Column:
    """log(kx + 1) / log(k + 1); k <= 0 is the identity."""
    return F.when(k > 0, F.ln(k * x + 1) / F.ln(k + 1)).otherwise(x)


def stretch(x: Column, mode: str, k: Column | float = DEFAULT_K) -> Column:
    """Transfer curve on a value already in [0, 1]."""
    if mode == "linear":
        return x
    if mode == "log":
        return F.ln(x * LOG_SOFTENING + 1) / F.ln(F.lit(LOG_SOFTENING + 1))
    if mode == "sqrt":
        return F.sqrt(x)
    if mode == "asinh":
        return F.asinh(x / ASINH_SOFTENING) / F.asinh(F.lit(1 / ASINH_SOFTENING))
    if mode == "trilogy":
        return trilogy_curve(x, k if isinstance(k, Column) else F.lit(k))
    raise ValueError(f"unknown stretch mode {mode!r}")


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def normalise(v: Column, lo: Column, hi: Column) -> Column:
    """Position of v in [lo, hi], clamped; hi = lo gives 0 below, 1 above and NaN on it."""
    span = hi - lo
    degenerate = F.when(v > lo, 1.0).when(v < lo, 0.0).otherwise(F.lit(float("nan")))
    return F.when(span == 0, degenerate).otherwise(clamp01((v - lo) / F.when(span != 0, span)))


def scale_value(v: Column, lo: Column, hi: Column, mode: str, k: Column | float = DEFAULT_K) -> Column:
    return stretch(normalise(v.cast("double"), lo, hi), mode, k)


def solve_k(norm1: Column, noiselum: Column) -> Column:
    """Softening k with trilogy_curve(norm1, k) = noiselum: doubling, then 64 halvings."""

    def curve(k: Column) -> Column:
        return F.ln(k * norm1 + 1) / F.ln(k + 1)

    top = F.aggregate(
        F.sequence(F.lit(0), F.lit(100)),
        F.lit(1.0),
        lambda hi, _: F.when((curve(hi) < noiselum) & (hi <= 1e30), hi * 2).otherwise(hi),
    )
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(F.lit(0.0).alias("lo"), top.alias("hi")),
        lambda s, _: F.when(
            curve((s["lo"] + s["hi"]) / 2) < noiselum,
            F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
        lambda s: (s["lo"] + s["hi"]) / 2,
    )
    return (
        F.when(norm1.isNull() | ~((norm1 > 0) & (norm1 < 1)), F.lit(DEFAULT_K))
        .when(noiselum <= norm1, F.lit(0.0))
        .when(noiselum >= 1, F.lit(1e30))
        .when(top > 1e30, top)
        .otherwise(halved)
    )


def saturation_value(tail: Column, satpercent: Column) -> Column:
    """Bright-tail level for a percentage of clipped pixels, linear in log10(satpercent).

    ``tail``: struct p99, p99_9, p99_99, p99_999 (1, 0.1, 0.01, 0.001 percent).
    """
    steps = -F.log10(F.least(F.lit(1.0), F.greatest(F.lit(0.001), satpercent)))
    names = ("p99", "p99_9", "p99_99", "p99_999")

    def piece(i: int) -> Column:
        return tail[names[i]] + (steps - i) * (tail[names[i + 1]] - tail[names[i]])

    return F.when(steps <= 1, piece(0)).when(steps <= 2, piece(1)).otherwise(piece(2))


def trilogy_levels(
    mean: Column,
    sigma: Column,
    tail: Column,
    noiselum: float = NOISELUM,
    satpercent: float = SATPERCENT,
    noisesig: float = NOISESIG,
    noisesig0: float = NOISESIG0,
) -> Column:
    """struct(x0, x1, x2, k): black point, noise level, saturation level, softening."""
    x0 = mean - sigma * noisesig0
    x1 = mean + sigma * noisesig
    sat = saturation_value(tail, F.lit(satpercent))
    x2 = F.when(sat > x0, sat).otherwise(x0 + F.greatest(sigma, F.lit(1e-30)))
    norm1 = F.least(F.lit(0.999), F.greatest(F.lit(0.0), (x1 - x0) / (x2 - x0)))
    return F.struct(
        x0.alias("x0"), x1.alias("x1"), x2.alias("x2"), solve_k(norm1, F.lit(noiselum)).alias("k")
    )


def luminance_levels(mean_sat: Column, mean_noise: Column, noiselum: float = NOISELUM) -> Column:
    """struct(lsat, k) of the shared luminance, from mean(x2 - x0) and mean(x1 - x0)."""
    lsat = F.when(mean_sat > 0, mean_sat).otherwise(F.greatest(mean_noise, F.lit(1e-30)))
    norm1 = F.least(F.lit(0.999), F.greatest(F.lit(0.0), mean_noise / lsat))
    return F.struct(lsat.alias("lsat"), solve_k(norm1, F.lit(noiselum)).alias("k"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b); h in degrees, any angle."""

    def channel(offset: float) -> Column:
        # Distance along the hue circle gives each channel the same tent-shaped ramp.
        turn = F.pmod(F.lit(offset) + h / 60.0, F.lit(6.0))
        ramp = F.greatest(F.lit(0.0), F.least(turn, F.lit(4.0) - turn, F.lit(1.0)))
        return v - v * s * ramp

    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def saturate(r: Column, g: Column, b: Column, saturation: float) -> tuple[Column, Column, Column]:
    """Scale each channel's distance from the channel mean, clamped; 1 changes nothing."""
    saturation = min(MAX_SATURATION, max(0.0, saturation))
    if saturation == 1.0:
        return r, g, b
    lum = (r + g + b) / 3
    return tuple(clamp01(lum + (c - lum) * saturation) for c in (r, g, b))


def lut_index(x: Column, size: int = 256) -> Column:
    """Row of a lookup table for a value in [0, 1]; both ends are pinned."""
    return F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(x * size))).cast("int")
