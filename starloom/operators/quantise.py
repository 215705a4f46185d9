"""Dither-quantised tiles: integers plus a per-tile scale, both ways."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from starloom import kernels

# Dither methods by their header word; any other word means none.
NO_DITHER = -1
DITHER_METHODS = {"SUBTRACTIVE_DITHER_1": 1, "SUBTRACTIVE_DITHER_2": 2}
QUANTISE_LEVEL = 8
BLANK = -2147483648


def dither_method(zquantiz: Column) -> Column:
    out = F.lit(NO_DITHER)
    for name, code in DITHER_METHODS.items():
        out = F.when(zquantiz == name, code).otherwise(out)
    return out


def _without(df: DataFrame, *names: str) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in names])


def dequantise(tiles: DataFrame) -> DataFrame:
    """``q`` -> ``pixels``; needs zscale, zzero, zblank, dither_method, zdither0, tile_index."""
    kept = _without(tiles, "q")
    body = partial(kernels.dequantise, table=kernels.dither_table(), keep=kept.fieldNames())
    return tiles.mapInPandas(body, StructType(kept.fields + []).add("pixels", ArrayType(FloatType())))


def quantise(tiles: DataFrame) -> DataFrame:
    """``pixels`` -> ``q`` with the same parameters as :func:`dequantise`."""
    kept = _without(tiles, "pixels")
    body = partial(kernels.quantise, table=kernels.dither_table(), keep=kept.fieldNames(), blank=BLANK)
    return tiles.mapInPandas(body, StructType(kept.fields + []).add("q", ArrayType(IntegerType())))


def quantise_parameters(sigma: Column, level: int = QUANTISE_LEVEL) -> Column:
    """Step of sigma / level, with a floor for noiseless tiles."""
    return F.greatest(F.coalesce(sigma, F.lit(0.0)), F.lit(1e-6)) / level
