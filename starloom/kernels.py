"""The few array bodies that run in Python, on Arrow batches, one tile or one bounded sample at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

# Fixed values of the public dither sequence: table length, generator, scaling and zero marker.
N_RANDOM = 10000
LCG_A = 16807
LCG_M = 2147483647
DITHER_SCALE = 500
ZERO_VALUE = -2147483646


def halve_tiles(batches, tile_size: int, max_level: int, with_totals: bool):
    """Tiles in, one block-averaged patch per coarser level out.

    A tile of 2**K pixels a side holds whole blocks for the next K levels, so a single
    visit to a tile serves all of them; sums and counts of the K-th level are kept to
    carry on from there.
    """
    depth = int(np.log2(tile_size))
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if with_totals:
                total = np.asarray(r.sums, dtype=np.float64).reshape(r.h, r.w)
                count = np.asarray(r.counts, dtype=np.int64).reshape(r.h, r.w)
            else:
                px = np.asarray(r.pixels, dtype=np.float64).reshape(r.h, r.w)
                good = np.isfinite(px)
                total, count = np.where(good, px, 0.0), good.astype(np.int64)
            for k in range(1, depth + 1):
                z = r.z + k
                if z > min(max_level, r.top_z):
                    break
                h, w = total.shape[0] // 2, total.shape[1] // 2
                if h == 0 or w == 0:
                    break
                total = total[: 2 * h, : 2 * w].reshape(h, 2, w, 2).sum(axis=(1, 3))
                count = count[: 2 * h, : 2 * w].reshape(h, 2, w, 2).sum(axis=(1, 3))
                side = tile_size >> k
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(count > 0, total / count, np.nan).astype(np.float32)
                last = k == depth
                rows.append(
                    (
                        r.band, z, r.tile_x >> k, r.tile_y >> k, r.img_h, r.img_w, r.top_z,
                        (r.tile_y & ((1 << k) - 1)) * side, (r.tile_x & ((1 << k) - 1)) * side, h, w,
                        mean.ravel(), total.ravel() if last else None, count.ravel() if last else None,
                    )
                )
        yield pd.DataFrame(rows, columns=PATCH_COLUMNS)


PATCH_COLUMNS = [
    "band", "z", "tile_x", "tile_y", "img_h", "img_w", "top_z", "oy", "ox", "ph", "pw", "pixels", "sums", "counts",
]
PATCH_SCHEMA = (
    "band string, z int, tile_x int, tile_y int, img_h int, img_w int, top_z int, "
    "oy int, ox int, ph int, pw int, pixels array<float>, sums array<double>, counts array<bigint>"
)


def assemble_tiles(batches, tile_size: int):
    """Patches of one tile, gathered as an array, placed side by side; gaps stay NaN."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            lh, lw = r.img_h >> r.z, r.img_w >> r.z
            h = min(tile_size, lh - r.tile_y * tile_size)
            w = min(tile_size, lw - r.tile_x * tile_size)
            px = np.full((h, w), np.nan, dtype=np.float32)
            carry = r.patches[0]["sums"] is not None
            total = np.zeros((h, w)) if carry else None
            count = np.zeros((h, w), dtype=np.int64) if carry else None
            for p in r.patches:
                at = np.s_[p["oy"] : p["oy"] + p["ph"], p["ox"] : p["ox"] + p["pw"]]
                shape = (p["ph"], p["pw"])
                px[at] = np.asarray(p["pixels"], dtype=np.float32).reshape(shape)
                if carry:
                    total[at] = np.asarray(p["sums"]).reshape(shape)
                    count[at] = np.asarray(p["counts"]).reshape(shape)
            rows.append(
                (
                    r.band, r.z, r.tile_x, r.tile_y, w, h, r.img_h, r.img_w, r.top_z, px.ravel(),
                    total.ravel() if carry else None, count.ravel() if carry else None,
                )
            )
        yield pd.DataFrame(rows, columns=CARRY_COLUMNS)


CARRY_COLUMNS = [
    "band", "z", "tile_x", "tile_y", "w", "h", "img_h", "img_w", "top_z", "pixels", "sums", "counts",
]
CARRY_SCHEMA = (
    "band string, z int, tile_x int, tile_y int, w int, h int, img_h int, img_w int, top_z int, "
    "pixels array<float>, sums array<double>, counts array<bigint>"
)


def dither_table() -> np.ndarray:
    """float32 table of the multiplicative congruential generator, seed 1."""
    out = np.empty(N_RANDOM, dtype=np.float64)
    seed = 1
    for i in range(N_RANDOM):
        seed = (LCG_A * seed) % LCG_M
        out[i] = seed / LCG_M
    return out.astype(np.float32)


def dither_values(table: np.ndarray, tile_index: int, seed: int, n: int) -> np.ndarray:
    """The n dither offsets of one tile: runs to the end of the table, each run's start
    drawn from the next table entry."""
    at = (tile_index + seed - 1) % N_RANDOM
    runs, have = [], 0
    while have < n:
        start = int(np.float32(table[at] * np.float32(DITHER_SCALE)))
        run = table[start : start + n - have]
        runs.append(run)
        have += len(run)
        at = (at + 1) % N_RANDOM
    return np.concatenate(runs) if runs else np.empty(0, dtype=np.float32)


def dequantise(batches, table: np.ndarray, keep: list[str]):
    """q, zscale, zzero, zblank, method, seed, tile_index -> pixels."""
    for pdf in batches:
        pixels = []
        for q, zs, zz, zb, method, seed, index in zip(
            pdf.q, pdf.zscale, pdf.zzero, pdf.zblank, pdf.dither_method, pdf.zdither0, pdf.tile_index
        ):
            q = np.asarray(q, dtype=np.int64)
            offset = 0.0
            if method in (1, 2):
                offset = 0.5 - dither_values(table, int(index), int(seed), len(q)).astype(np.float64)
            v = (q + offset) * zs + zz
            if method == 2:
                v[q == ZERO_VALUE] = 0.0
            if zb is not None and not np.isnan(zb):
                v[q == int(zb)] = np.nan
            pixels.append(v.astype(np.float32))
        out = pdf[keep].copy()
        out["pixels"] = pixels
        yield out


def quantise(batches, table: np.ndarray, keep: list[str], blank: int):
    """pixels, zscale, zzero, method, seed, tile_index -> q, the inverse of :func:`dequantise`."""
    for pdf in batches:
        codes = []
        for px, zs, zz, method, seed, index in zip(
            pdf.pixels, pdf.zscale, pdf.zzero, pdf.dither_method, pdf.zdither0, pdf.tile_index
        ):
            v = np.asarray(px, dtype=np.float64)
            good = np.isfinite(v)
            offset = 0.0
            if method in (1, 2):
                offset = dither_values(table, int(index), int(seed), len(v)).astype(np.float64) - 0.5
            step = zs if zs else 1.0
            q = np.rint(np.where(good, (v - zz) / step + offset, 0.0)).astype(np.int64)
            if method == 2:
                q[good & (v == 0.0)] = ZERO_VALUE
            q[~good] = blank
            codes.append(q.astype(np.int32))
        out = pdf[keep].copy()
        out["q"] = codes
        yield out


# Fixed values of the zscale line fit.
Z_SAMPLES = 1000
Z_CONTRAST = 0.25
Z_MAX_REJECT = 0.5
Z_MIN_PIXELS = 5
Z_KREJ = 2.5
Z_ITERATIONS = 5


def zscale_limits(sample: np.ndarray, contrast: float = Z_CONTRAST) -> tuple[float, float] | None:
    """Display cuts of one sample of at most 1000 values: median and clipped line-fit slope."""
    v = np.sort(np.asarray(sample, dtype=np.float64))
    n = len(v)
    if n == 0:
        return None
    least = max(Z_MIN_PIXELS, int(n * Z_MAX_REJECT))
    grow = max(1, int(n * 0.01))
    x = np.arange(n, dtype=np.float64)
    keep = np.ones(n, dtype=bool)
    kept, before, slope = n, n + 1, 0.0
    for _ in range(Z_ITERATIONS):
        if kept >= before or kept < least:
            break
        xm, vm = x[keep].mean(), v[keep].mean()
        dx = x[keep] - xm
        slope = float((dx * (v[keep] - vm)).sum() / (dx * dx).sum())
        flat = v - (vm + slope * (x - xm))
        limit = Z_KREJ * flat[keep].std()
        bad = ~keep | (flat < -limit) | (flat > limit)
        keep = ~(np.convolve(bad, np.ones(grow), mode="same") > 0)
        before, kept = kept, int(keep.sum())
    z1, z2 = v[0], v[-1]
    if kept >= least:
        run = slope / contrast if contrast > 0 else slope
        mid, med = (n - 1) // 2, np.median(v)
        z1, z2 = max(z1, med - (mid - 1) * run), min(z2, med + (n - mid) * run)
    if not (z2 > z1) or not (np.isfinite(z1) and np.isfinite(z2)):
        return None
    return float(z1), float(z2)


#: Pixels of partial sums that a task holds before it passes them on.
HELD_PIXELS = 1 << 21
SUMS_SCHEMA = (
    "z int, tile_x int, tile_y int, w int, tr double, tg double, tb double, h int, "
    "r array<double>, g array<double>, b array<double>, shown array<boolean>"
)
_SUMS = pa.schema(
    [(c, pa.int32()) for c in ("z", "tile_x", "tile_y", "w")] + [(c, pa.float64()) for c in ("tr", "tg", "tb")] + [("h", pa.int32())]
    + [(c, pa.list_(pa.float64())) for c in "rgb"] + [("shown", pa.list_(pa.bool_()))]
)


class _Sums:
    """By tile (place, width, divisors): its height, sums of shape (3, pixels) and mask. Bands may end at different rows."""

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.size = 0

    def add(self, head: tuple, h: int, sums: np.ndarray, mask: np.ndarray) -> None:
        n = len(mask)
        if head not in self.held:
            self.held[head] = [h, np.zeros((3, n)), np.zeros(n, bool)]
            self.size += n
        mine = self.held[head]
        if n > len(mine[2]):
            more = n - len(mine[2])
            self.size += more
            mine[:] = h, np.pad(mine[1], ((0, 0), (0, more))), np.pad(mine[2], (0, more))
        mine[1][:, :n] += sums
        mine[2][:n] |= mask

    def batch(self) -> pa.RecordBatch:
        heads, held = list(self.held), list(self.held.values())
        offsets = np.concatenate([[0], np.cumsum([len(m) for _, _, m in held])]).astype(np.int32)
        arrays = [pa.array([h[i] for h in heads], _SUMS.field(i).type) for i in range(7)] + [pa.array([h for h, _, _ in held], pa.int32())]
        arrays += [pa.ListArray.from_arrays(offsets, np.concatenate([s[c] for _, s, _ in held])) for c in range(3)]
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m for _, _, m in held]))))
        return pa.RecordBatch.from_arrays(arrays, schema=_SUMS)


def weighted_sums(batches):
    """Stretched pixels times weights, summed by tile over the bands that this task meets.

    z, tile_x, tile_y, w, h, x0, x2, k, weights of r, g, b, their totals, pixels -> partial sums.
    """
    found = _Sums()
    for batch in batches:
        heads = zip(*[batch.column(i).to_pylist() for i in range(14)], strict=True)
        column = batch.column(14)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for (z, tx, ty, w, h, x0, x2, k, wr, wg, wb, tr, tg, tb), low, high in zip(heads, offsets, offsets[1:], strict=False):
            v = flat[low:high].astype(np.float64)
            there = ~np.isnan(v)
            with np.errstate(invalid="ignore", divide="ignore"):
                n = np.clip((v - x0) / (x2 - x0), 0.0, 1.0) if x2 != x0 else np.where(v == x0, np.nan, v > x0)
                s = np.where(there, np.log(k * n + 1) / np.log(k + 1) if k > 0 else n, 0.0)
            found.add((z, tx, ty, w, tr, tg, tb), h, np.multiply.outer((wr, wg, wb), s), there)
        if found.size >= HELD_PIXELS:
            yield found.batch()
            found = _Sums()
    if found.held:
        yield found.batch()


def added_sums(batches):
    """Partial sums, sorted by tile, added up: the same columns, one row for each tile."""
    found = _Sums()
    for batch in batches:
        heads = zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True)
        offsets, heights = batch.column(8).offsets.to_numpy(), batch.column(7).to_pylist()
        flat = [batch.column(8 + c).values.to_numpy(zero_copy_only=False) for c in range(4)]
        for head, h, low, high in zip(heads, heights, offsets, offsets[1:], strict=False):
            if found.held and head not in found.held:
                yield found.batch()
                found = _Sums()
            found.add(head, h, np.stack([f[low:high] for f in flat[:3]]), flat[3][low:high])
    if found.held:
        yield found.batch()
