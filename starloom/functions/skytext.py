"""Sky coordinates as text, both ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from starloom.functions.let import let, pack
from starloom.functions.nan import is_finite


def _sexagesimal(value: Column, decimals: int) -> tuple[Column, Column, Column]:
    """(whole, minutes, seconds) of |value|, seconds rounded half up, 60s carried upward."""
    size = F.abs(value)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    factor = 10.0**decimals
    seconds = F.floor((size - whole - minutes / 60) * 3600 * factor + 0.5) / factor
    over = F.when(seconds >= 60, 1).otherwise(0)
    seconds, minutes = seconds - over * 60, minutes + over
    over = F.when(minutes >= 60, 1).otherwise(0)
    return whole + over, minutes - over * 60, seconds


def _seconds_text(seconds: Column, decimals: int) -> Column:
    width = decimals + 3 if decimals else 2
    return F.format_string(f"%0{width}.{decimals}f", seconds)


def format_ra(ra: Column, decimals: int = 3) -> Column:
    """``HH:MM:SS.sss``."""
    whole, minutes, seconds = _sexagesimal(F.pmod(ra, F.lit(360.0)) / 15, decimals)
    return F.concat(
        F.format_string("%02d:%02d:", F.pmod(whole, F.lit(24)), minutes), _seconds_text(seconds, decimals)
    )


def format_dec(dec: Column, decimals: int = 2) -> Column:
    """``+DD:MM:SS.ss``; a negative value that rounds to zero prints ``+``."""
    whole, minutes, seconds = _sexagesimal(dec, decimals)
    minus = (dec < 0) & ((whole > 0) | (minutes > 0) | (seconds > 0))
    return F.concat(
        F.when(minus, "-").otherwise("+"),
        F.format_string("%02d:%02d:", whole, minutes),
        _seconds_text(seconds, decimals),
    )


def format_separation(sep: Column) -> Column:
    """Arcseconds below one arcminute, arcminutes below one degree, else degrees."""
    arcsec = F.abs(sep) * 3600
    return (
        F.when(sep.isNull() | ~is_finite(sep), "—")
        .when(arcsec < 60, F.format_string("%.2f″", arcsec))
        .when(arcsec < 3600, F.format_string("%.2f′", arcsec / 60))
        .otherwise(F.format_string("%.3f°", F.abs(sep)))
    )


def _field_degrees(tokens: Column, is_ra: bool) -> Column:
    """One token: degrees. Three: sexagesimal, hours for RA. Anything else: NULL."""

    def value(t: Column) -> Column:
        n, first = t["n"], F.get(t["n"], F.lit(0))
        sign = F.when(F.get(t["tokens"], F.lit(0)).startswith("-"), -1.0).otherwise(1.0)
        angle = F.abs(first) + F.get(n, F.lit(1)) / 60 + F.get(n, F.lit(2)) / 3600
        good = F.forall(n, lambda x: x.isNotNull() & is_finite(x))
        return F.when(good & (F.size(n) == 1), first).when(
            good & (F.size(n) == 3), sign * angle * (15.0 if is_ra else 1.0)
        )

    decimal = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    numbers = F.transform(tokens, lambda t: F.when(t.rlike(decimal), t.try_cast("double")))
    return let(pack(tokens=tokens, n=numbers), value)


def parse_sky(text: Column) -> Column:
    """Free-form RA/Dec text to struct(ra, dec) in degrees, NULL if it is not one position.

    Dec starts at the first signed token after the first; without a sign, two or six
    tokens split in the middle.
    """
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, "[hHdDmMsS'\":,]", " "), r"\s+", " "))

    def with_cut(tokens: Column) -> Column:
        signed = F.array_min(F.transform(tokens, lambda t, i: F.when((i > 0) & t.rlike("^[+-]"), i)))
        n = F.size(tokens)
        cut = F.coalesce(signed, F.when(n == 2, 1).when(n == 6, 3), F.lit(0))
        return let(pack(tokens=tokens, cut=cut), fields)

    def fields(t: Column) -> Column:
        ra = F.slice(t["tokens"], F.lit(1), t["cut"])
        dec = F.slice(t["tokens"], t["cut"] + 1, F.size(t["tokens"]))
        return let(pack(ra=_field_degrees(ra, True), dec=_field_degrees(dec, False), cut=t["cut"]), checked)

    def checked(p: Column) -> Column:
        inside = (p["ra"] >= 0) & (p["ra"] <= 360) & (p["dec"] >= -90) & (p["dec"] <= 90)
        return F.when((p["cut"] > 0) & inside, pack(ra=p["ra"], dec=p["dec"]))

    return let(F.split(spaced, " "), with_cut)
