"""Level, tile and supertile arithmetic; pixel-grid identity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

TILE_SIZE = 256
SUPERTILE_BLOCKS = 48
#: Objects above this size are not cached at the edge.
OBJECT_SIZE_CAP = 512 * 1024 * 1024

# Quanta of the advisory grid hash and the rounding of the grid signature.
CRPIX_QUANTUM = 1e-3
CRVAL_QUANTUM = 1e-7
CD_QUANTUM = 1e-11
SIGNATURE_CRVAL_DIGITS = 9
SIGNATURE_SCALE_DIGITS = 15
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def _div(a: Column, b: Column | int) -> Column:
    """Floor division for non-negative and negative operands alike."""
    return F.floor(a / b).cast("long")


def n_downsample_levels(h: Column, w: Column, tile_size: int = TILE_SIZE) -> Column:
    """Smallest n >= 0 with max(h, w) <= tile_size * 2**n, counted in integers."""
    longest = F.greatest(h, w).cast("long")
    # Powers of two up to 2**40 are exact, so no logarithm can land beside an integer.
    steps = F.sequence(F.lit(0), F.lit(40))
    return F.array_min(
        F.filter(steps, lambda n: F.lit(tile_size) * F.pow(F.lit(2.0), n) >= longest)
    ).cast("int")


def level_dim(native: Column, z: Column) -> Column:
    """Native extent reduced by 2**z; the part of a block that does not fill is trimmed."""
    return F.floor(native / F.pow(F.lit(2.0), z)).cast("int")


def tile_count(extent: Column, tile_size: int = TILE_SIZE) -> Column:
    return F.ceil(extent / tile_size).cast("int")


def indices(n: Column, step: int = 1) -> Column:
    """0, step, 2 * step .. below n. A level thinner than one pixel has no tiles: NULL, so that explode drops the row."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))


def tile_extent(extent: Column, t: Column, tile_size: int = TILE_SIZE) -> Column:
    """Width (or height) of tile ``t``: full size, or what is left at the high edge."""
    return F.least(F.lit(tile_size), extent - t * tile_size).cast("int")


def tile_bounds(h: Column, w: Column, tx: Column, ty: Column, tile_size: int = TILE_SIZE) -> Column:
    """Half-open pixel rectangle of a tile."""
    return F.struct(
        (tx * tile_size).alias("x0"),
        (ty * tile_size).alias("y0"),
        F.least((tx + 1) * tile_size, w).alias("x1"),
        F.least((ty + 1) * tile_size, h).alias("y1"),
    )


def tile_world_rect(h: Column, w: Column, z: Column, tx: Column, ty: Column, tile_size: int = TILE_SIZE) -> Column:
    """A tile's rectangle in native pixels."""
    f = F.pow(F.lit(2.0), z)
    b = tile_bounds(h, w, tx, ty, tile_size)
    return F.struct(*[(b[k] * f).alias(k) for k in ("x0", "y0", "x1", "y1")])


def pixel_to_tile(px: Column, py: Column, h: Column, w: Column, tile_size: int = TILE_SIZE) -> Column:
    """Tile of a level pixel as a struct, NULL outside the grid."""
    inside = (px >= 0) & (py >= 0) & (px < w) & (py < h)
    return F.when(
        inside,
        F.struct(_div(px, tile_size).alias("tile_x"), _div(py, tile_size).alias("tile_y")),
    )


def world_to_tile_index(x: Column, y: Column, z: Column, h: Column, w: Column, tile_size: int = TILE_SIZE) -> Column:
    """Tile and row-major offset holding native position (x, y) at level z; NULL outside.

    The row stride is the width of that very tile, so narrow edge tiles index right.
    """
    f = F.pow(F.lit(2.0), z)
    lx, ly = F.floor(x / f), F.floor(y / f)
    tx, ty = _div(lx, tile_size), _div(ly, tile_size)
    col, row = lx - tx * tile_size, ly - ty * tile_size
    inside = (lx >= 0) & (ly >= 0) & (lx < w) & (ly < h)
    return F.when(
        inside,
        F.struct(
            tx.alias("tile_x"),
            ty.alias("tile_y"),
            (row * tile_extent(w, tx, tile_size) + col).cast("int").alias("index"),
        ),
    )


def supertile_origin(t: Column, blocks: int = SUPERTILE_BLOCKS) -> Column:
    return (_div(t, blocks) * blocks).cast("int")


def cd_matrix(hdr: Column) -> Column:
    """CD matrix of a header struct: the CD cards if any is present, else CDELT * PC.

    ``hdr`` is a struct with nullable doubles cd1_1.. cd2_2, cdelt1/2, pc1_1.. pc2_2.
    Non-finite cards count as absent.
    """

    def card(name: str, default: float) -> Column:
        v = hdr[name]
        return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), F.lit(default))

    def present(name: str) -> Column:
        v = hdr[name]
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    has_cd = present("cd1_1") | present("cd1_2") | present("cd2_1") | present("cd2_2")
    out = []
    for i in (1, 2):
        for j in (1, 2):
            cd = card(f"cd{i}_{j}", 0.0)
            pc = card(f"pc{i}_{j}", 1.0 if i == j else 0.0)
            out.append(F.when(has_cd, cd).otherwise(card(f"cdelt{i}", 1.0) * pc).alias(f"cd{i}{j}"))
    return F.struct(*out)


def level_crpix(crpix: Column, factor: Column) -> Column:
    """Reference pixel after block-averaging by ``factor`` (keeps block centres in place)."""
    return crpix / factor + (factor - 1) / (factor * 2.0)


def supertile_crpix(crpix: Column, t0: Column, tile_size: int = TILE_SIZE) -> Column:
    return crpix - t0 * tile_size


def pixel_scale_mean(cd11: Column, cd12: Column, cd21: Column, cd22: Column) -> Column:
    """Arcsec per pixel: mean length of the two columns of the CD matrix."""
    return (F.sqrt(cd11 * cd11 + cd21 * cd21) + F.sqrt(cd12 * cd12 + cd22 * cd22)) / 2.0 * 3600.0


def pixel_scale_area(cd11: Column, cd12: Column, cd21: Column, cd22: Column) -> Column:
    """Arcsec per pixel: square root of the pixel's area."""
    return F.sqrt(F.abs(cd11 * cd22 - cd12 * cd21)) * 3600.0


def grid_signature(ctype1, ctype2, crval1, crval2, cd11, cd12, cd21, cd22) -> Column:
    """What exposures must share to be placed on one grid (all but CRPIX)."""

    def rounded(v: Column, digits: int) -> Column:
        # + 0.0 folds -0.0, so equal grids spell equal.
        return (F.bround(v, digits) + 0.0).cast("string")

    parts = [ctype1, ctype2]
    parts += [rounded(v, SIGNATURE_CRVAL_DIGITS) for v in (crval1, crval2)]
    parts += [rounded(v, SIGNATURE_SCALE_DIGITS) for v in (cd11, cd12, cd21, cd22)]
    return F.concat_ws("|", *parts)


def fnv1a_hex(text: Column, charset: str = "UTF-8") -> Column:
    """32-bit FNV-1a over bytes (UTF-8) or 16-bit code units (UTF-16BE) as 8 hex digits."""
    kind, codec = {"UTF-8": ("u1", "utf-8"), "UTF-16BE": (">u2", "utf-16-be")}[charset]

    def fold(texts: pd.Series) -> pd.Series:
        """All texts of a batch together, one unit at a time; the longest come first, so that those not yet at their end lead."""
        given = texts.dropna()
        coded = [t.encode(codec) for t in given]
        sizes = np.array([len(c) for c in coded], np.int64) // np.dtype(kind).itemsize
        units = np.frombuffer(b"".join(coded), kind).astype(np.uint64)
        order = np.argsort(-sizes, kind="stable")
        starts, longest = (np.cumsum(sizes) - sizes)[order], -sizes[order]
        h = np.full(len(order), FNV_OFFSET, np.uint64)
        for i in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(longest, -i))
            h[:n] = ((h[:n] ^ units[starts[:n] + i]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        out = pd.Series([f"{v:08x}" for v in h.tolist()], index=given.index[order], dtype=object)
        return out.reindex(texts.index)

    return F.pandas_udf(fold, "string")(text)


def grid_hash_text(ctype1, ctype2, h, w, crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22) -> Column:
    """Canonical text of a grid: shape as is, coordinates as whole numbers of their quantum."""

    def q(v: Column, quantum: float) -> Column:
        return F.rint(F.coalesce(v, F.lit(0.0)) / F.lit(quantum)).cast("long").cast("string")

    return F.concat_ws(
        "|",
        F.trim(F.coalesce(ctype1, F.lit(""))),
        F.trim(F.coalesce(ctype2, F.lit(""))),
        h.cast("string"),
        w.cast("string"),
        q(crpix1, CRPIX_QUANTUM),
        q(crpix2, CRPIX_QUANTUM),
        q(crval1, CRVAL_QUANTUM),
        q(crval2, CRVAL_QUANTUM),
        *[q(v, CD_QUANTUM) for v in (cd11, cd12, cd21, cd22)],
    )


def grid_hash(*parts) -> Column:
    return fnv1a_hex(grid_hash_text(*parts))


def tile_key(z: Column, tx: Column, ty: Column) -> Column:
    return F.concat_ws("/", z, tx, ty)


def blob_key(fingerprint: Column, z: Column, tx: Column, ty: Column) -> Column:
    return F.concat_ws("/", fingerprint, z, tx, ty)
