"""Gnomonic (TAN) sky projection and sky geometry as column arithmetic.

The projection is written with direction cosines in the tangent plane: LONPOLE is
a plain rotation of that plane, so a point costs one sine/cosine pair per angle
and no inverse of an inverse trigonometric function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from starloom.functions.let import let, pack
from starloom.functions.nan import is_finite

FIELDS = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22", "lonpole")


@dataclass(frozen=True)
class Wcs:
    """The columns of one projection."""

    crpix1: Column
    crpix2: Column
    crval1: Column
    crval2: Column
    cd11: Column
    cd12: Column
    cd21: Column
    cd22: Column
    lonpole: Column

    @classmethod
    def of(cls, source: Column | None = None, prefix: str = "") -> "Wcs":
        """From a struct column, or from plain columns ``prefix + name``."""
        if source is not None:
            return cls(*[source[f] for f in FIELDS])
        return cls(*[F.col(prefix + f) for f in FIELDS])

    @property
    def det(self) -> Column:
        return self.cd11 * self.cd22 - self.cd12 * self.cd21


def parse_wcs(hdr: Column, cd: Column) -> Column:
    """Projection struct of a header, NULL unless it is a usable RA/Dec TAN grid in degrees.

    ``hdr`` needs ctype1/2, radesys, cunit1/2 (strings) and crpix/crval/lonpole (doubles).
    """

    def text(name: str) -> Column:
        return F.upper(F.coalesce(hdr[name], F.lit("")))

    def number(name: str) -> Column:
        return F.when(is_finite(hdr[name]), hdr[name])

    units = [F.lower(F.trim(F.coalesce(hdr[n], F.lit("")))) for n in ("cunit1", "cunit2")]
    det = cd["cd11"] * cd["cd22"] - cd["cd12"] * cd["cd21"]
    usable = (
        text("ctype1").rlike("^RA--.*TAN$")
        & text("ctype2").rlike("^DEC-.*TAN$")
        & text("radesys").isin("", "ICRS")
        & units[0].isin("", "deg", "degree", "degrees")
        & units[1].isin("", "deg", "degree", "degrees")
        & number("crpix1").isNotNull()
        & number("crpix2").isNotNull()
        & number("crval1").isNotNull()
        & number("crval2").isNotNull()
        & is_finite(det)
        & (det != 0)
    )
    lonpole = F.coalesce(number("lonpole"), F.when(hdr["crval2"] >= 90, 0.0).otherwise(180.0))
    return F.when(
        usable,
        F.struct(
            *[hdr[n].alias(n) for n in ("crpix1", "crpix2", "crval1", "crval2")],
            *[cd[n].alias(n) for n in ("cd11", "cd12", "cd21", "cd22")],
            lonpole.alias("lonpole"),
        ),
    )


def pix_to_sky(w: Wcs, x: Column, y: Column) -> tuple[Column, Column]:
    """Native position (0,0 = outer corner of the first pixel) to (ra, dec) in degrees."""
    u, v = x + 0.5 - w.crpix1, y + 0.5 - w.crpix2
    px = F.radians(w.cd11 * u + w.cd12 * v)
    py = F.radians(w.cd21 * u + w.cd22 * v)
    pole = F.radians(w.lonpole)
    west = px * F.cos(pole) + py * F.sin(pole)
    north = px * F.sin(pole) - py * F.cos(pole)
    s0, c0 = F.sin(F.radians(w.crval2)), F.cos(F.radians(w.crval2))
    along = c0 - north * s0
    ra = w.crval1 + F.degrees(F.atan2(-west, along))
    dec = F.degrees(F.atan2(s0 + north * c0, F.hypot(west, along)))
    return F.pmod(ra, F.lit(360.0)), dec


def sky_to_pix(w: Wcs, ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """(x, y, in_front): native position, and whether the point faces the tangent plane."""
    da, d = F.radians(ra - w.crval1), F.radians(dec)
    s0, c0 = F.sin(F.radians(w.crval2)), F.cos(F.radians(w.crval2))
    facing = F.sin(d) * s0 + F.cos(d) * c0 * F.cos(da)
    west = -F.cos(d) * F.sin(da) / facing
    north = (F.sin(d) * c0 - F.cos(d) * s0 * F.cos(da)) / facing
    pole = F.radians(w.lonpole)
    px = F.degrees(west * F.cos(pole) + north * F.sin(pole))
    py = F.degrees(west * F.sin(pole) - north * F.cos(pole))
    u = (w.cd22 * px - w.cd12 * py) / w.det
    v = (w.cd11 * py - w.cd21 * px) / w.det
    return u + w.crpix1 - 0.5, v + w.crpix2 - 0.5, facing > 0


def sky_at(w: Wcs, x: Column, y: Column) -> Column:
    """:func:`pix_to_sky` as one value, struct(ra, dec), for use inside larger formulas."""

    def finish(p: Column) -> Column:
        along = p["c0"] - p["north"] * p["s0"]
        return pack(
            ra=F.pmod(w.crval1 + F.degrees(F.atan2(-p["west"], along)), F.lit(360.0)),
            dec=F.degrees(F.atan2(p["s0"] + p["north"] * p["c0"], F.hypot(p["west"], along))),
        )

    def turn(q: Column) -> Column:
        return let(
            pack(
                west=q["px"] * q["cp"] + q["py"] * q["sp"],
                north=q["px"] * q["sp"] - q["py"] * q["cp"],
                s0=F.sin(F.radians(w.crval2)),
                c0=F.cos(F.radians(w.crval2)),
            ),
            finish,
        )

    u, v = x + 0.5 - w.crpix1, y + 0.5 - w.crpix2
    pole = F.radians(w.lonpole)
    return let(
        pack(
            px=F.radians(w.cd11 * u + w.cd12 * v), py=F.radians(w.cd21 * u + w.cd22 * v), cp=F.cos(pole), sp=F.sin(pole)
        ),
        turn,
    )


def pix_at(w: Wcs, ra: Column, dec: Column) -> Column:
    """:func:`sky_to_pix` as one value, struct(x, y, front)."""

    def finish(p: Column) -> Column:
        return pack(
            x=(w.cd22 * p["px"] - w.cd12 * p["py"]) / p["det"] + w.crpix1 - 0.5,
            y=(w.cd11 * p["py"] - w.cd21 * p["px"]) / p["det"] + w.crpix2 - 0.5,
            front=p["facing"] > 0,
        )

    def turn(q: Column) -> Column:
        return let(
            pack(
                px=F.degrees(q["west"] * q["cp"] + q["north"] * q["sp"]),
                py=F.degrees(q["west"] * q["sp"] - q["north"] * q["cp"]),
                det=w.det,
                facing=q["facing"],
            ),
            finish,
        )

    def plane(t: Column) -> Column:
        flat = t["cd"] * t["ca"]
        return let(
            pack(
                facing=t["sd"] * t["s0"] + flat * t["c0"], west=-t["cd"] * t["sa"], north=t["sd"] * t["c0"] - flat * t["s0"]
            ),
            lambda f: let(
                pack(
                    west=f["west"] / f["facing"], north=f["north"] / f["facing"], facing=f["facing"],
                    cp=F.cos(F.radians(w.lonpole)), sp=F.sin(F.radians(w.lonpole)),
                ),
                turn,
            ),
        )

    da, d, d0 = F.radians(ra - w.crval1), F.radians(dec), F.radians(w.crval2)
    return let(
        pack(sd=F.sin(d), cd=F.cos(d), sa=F.sin(da), ca=F.cos(da), s0=F.sin(d0), c0=F.cos(d0)), plane
    )


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance (haversine form) in degrees."""
    sd = F.sin(F.radians(dec2 - dec1) / 2)
    sr = F.sin(F.radians(ra2 - ra1) / 2)
    hav = sd * sd + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sr * sr
    return F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(hav))) * 2)


def position_angle_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Direction of point 2 seen from point 1, from North through East, in [0, 360)."""
    d1, d2, da = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    east = F.cos(d2) * F.sin(da)
    north = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def ruler(w: Wcs | None, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixel distance plus sky separation and position angle (NULL without a projection)."""
    pix = F.hypot(x2 - x1, y2 - y1)
    if w is None:
        none = F.lit(None).cast("double")
        return pack(pixel_dist=pix, sep_deg=none, pa_deg=none)

    def measure(p: Column) -> Column:
        ends = (p["a"]["ra"], p["a"]["dec"], p["b"]["ra"], p["b"]["dec"])
        return pack(pixel_dist=pix, sep_deg=separation_deg(*ends), pa_deg=position_angle_deg(*ends))

    return let(pack(a=sky_at(w, x1, y1), b=sky_at(w, x2, y2)), measure)


def _compass(w: Wcs, ra: Column, dec: Column, eps: float) -> Column:
    """Native positions of a sky point (c), a step north of it (n) and a step east (e), and that step."""
    cos_dec = F.cos(F.radians(dec))
    return let(
        F.when(F.abs(cos_dec) > 1e-8, eps / cos_dec).otherwise(F.lit(eps)),
        lambda step: pack(
            c=pix_at(w, ra, dec), n=pix_at(w, ra, dec + eps), e=pix_at(w, ra + step, dec), step=step
        ),
    )


def local_basis(w: Wcs, ra: Column, dec: Column, eps: float = 1e-4) -> Column:
    """Native-pixel frame at a sky point: centre, unit North, unit East-side normal, scales."""

    def offsets(t: Column) -> Column:
        return let(
            pack(
                cx=t["c"]["x"], cy=t["c"]["y"], step=t["step"],
                nx=t["n"]["x"] - t["c"]["x"], ny=t["n"]["y"] - t["c"]["y"],
                ex=t["e"]["x"] - t["c"]["x"], ey=t["e"]["y"] - t["c"]["y"],
            ),
            lengths,
        )

    def lengths(o: Column) -> Column:
        return let(pack(o=o, n=F.hypot(o["nx"], o["ny"]), e=F.hypot(o["ex"], o["ey"])), frame)

    def frame(t: Column) -> Column:
        o, ux, uy = t["o"], t["o"]["nx"] / t["n"], t["o"]["ny"] / t["n"]
        side = F.when(-uy * o["ex"] + ux * o["ey"] >= 0, 1.0).otherwise(-1.0)
        return pack(
            cx=o["cx"], cy=o["cy"], north_x=ux, north_y=uy, east_x=-uy * side, east_y=ux * side,
            north_per_deg=t["n"] / eps, east_per_deg=t["e"] / o["step"],
            shear=F.abs((ux * o["ex"] + uy * o["ey"]) / t["e"]),
        )

    return let(_compass(w, ra, dec, eps), offsets)


def north_up(w: Wcs, x: Column, y: Column, eps: float = 1e-4) -> Column:
    """2x2 that turns North to screen-up and East to screen-left at a native position."""

    def offsets(t: Column) -> Column:
        return let(
            pack(
                nx=t["n"]["x"] - x, ny=t["n"]["y"] - y, ex=t["e"]["x"] - x, ey=t["e"]["y"] - y,
                n=F.hypot(t["n"]["x"] - x, t["n"]["y"] - y),
            ),
            turn,
        )

    def turn(o: Column) -> Column:
        # With the unit North vector (p, q), the turn to (0, -1) has cosine -q and sine -p.
        return let(
            pack(
                c=-o["ny"] / o["n"], s=-o["nx"] / o["n"], usable=(o["n"] > 0) & is_finite(o["n"]),
                flip=-o["ny"] * o["ex"] + o["nx"] * o["ey"] > 0,
            ),
            matrix,
        )

    def matrix(m: Column) -> Column:
        def pick(turned: Column, plain: float) -> Column:
            return F.when(m["usable"], turned).otherwise(F.lit(plain))

        return pack(
            m11=pick(F.when(m["flip"], -m["c"]).otherwise(m["c"]), 1.0),
            m12=pick(F.when(m["flip"], m["s"]).otherwise(-m["s"]), 0.0),
            m21=pick(m["s"], 0.0),
            m22=pick(m["c"], 1.0),
        )

    return let(sky_at(w, x, y), lambda p: let(_compass(w, p["ra"], p["dec"], eps), offsets))


def world_to_screen(view: Column, m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """``view``: struct cx, cy, zoom, vw, vh; ``m``: struct m11..m22."""
    dx, dy = (x - view["cx"]) * view["zoom"], (y - view["cy"]) * view["zoom"]
    return (
        m["m11"] * dx + m["m12"] * dy + view["vw"] / 2,
        m["m21"] * dx + m["m22"] * dy + view["vh"] / 2,
    )


def screen_to_world(view: Column, m: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    dx, dy = (sx - view["vw"] / 2) / view["zoom"], (sy - view["vh"] / 2) / view["zoom"]
    return (
        view["cx"] + m["m11"] * dx + m["m21"] * dy,
        view["cy"] + m["m12"] * dx + m["m22"] * dy,
    )


def viewport_box(view: Column, m: Column) -> Column:
    """Axis-aligned native-pixel box of the viewport: centre plus/minus the rotated half sizes."""
    hx, hy = view["vw"] / (view["zoom"] * 2), view["vh"] / (view["zoom"] * 2)
    rx = F.abs(m["m11"]) * hx + F.abs(m["m21"]) * hy
    ry = F.abs(m["m12"]) * hx + F.abs(m["m22"]) * hy
    return F.struct(
        (view["cx"] - rx).alias("x0"),
        (view["cy"] - ry).alias("y0"),
        (view["cx"] + rx).alias("x1"),
        (view["cy"] + ry).alias("y1"),
    )
