"""Which filter, instrument and wavelength an image is, from header words or a file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starloom.functions.let import let, pack

# Pivot wavelengths in microns by instrument key and filter.
PIVOTS = (
    ("NIRCAM", "F070W", 0.704), ("NIRCAM", "F090W", 0.902), ("NIRCAM", "F115W", 1.154), ("NIRCAM", "F140M", 1.404),
    ("NIRCAM", "F150W", 1.501), ("NIRCAM", "F150W2", 1.659), ("NIRCAM", "F162M", 1.626), ("NIRCAM", "F164N", 1.645),
    ("NIRCAM", "F182M", 1.845), ("NIRCAM", "F187N", 1.874), ("NIRCAM", "F200W", 1.99), ("NIRCAM", "F210M", 2.093),
    ("NIRCAM", "F212N", 2.12), ("NIRCAM", "F250M", 2.503), ("NIRCAM", "F277W", 2.786), ("NIRCAM", "F300M", 2.996),
    ("NIRCAM", "F322W2", 3.232), ("NIRCAM", "F323N", 3.237), ("NIRCAM", "F335M", 3.365), ("NIRCAM", "F356W", 3.563),
    ("NIRCAM", "F360M", 3.621), ("NIRCAM", "F405N", 4.055), ("NIRCAM", "F410M", 4.092), ("NIRCAM", "F430M", 4.28),
    ("NIRCAM", "F444W", 4.421), ("NIRCAM", "F460M", 4.624), ("NIRCAM", "F466N", 4.654), ("NIRCAM", "F470N", 4.707),
    ("NIRCAM", "F480M", 4.834),
    ("NIRISS", "F090W", 0.901), ("NIRISS", "F115W", 1.15), ("NIRISS", "F140M", 1.404), ("NIRISS", "F150W", 1.493),
    ("NIRISS", "F158M", 1.587), ("NIRISS", "F200W", 1.972), ("NIRISS", "F277W", 2.776), ("NIRISS", "F356W", 3.563),
    ("NIRISS", "F380M", 3.826), ("NIRISS", "F430M", 4.286), ("NIRISS", "F444W", 4.408), ("NIRISS", "F480M", 4.815),
    ("MIRI", "F560W", 5.6), ("MIRI", "F770W", 7.7), ("MIRI", "F1000W", 10.0), ("MIRI", "F1130W", 11.3), ("MIRI", "F1280W", 12.8),
    ("MIRI", "F1500W", 15.0), ("MIRI", "F1800W", 18.0), ("MIRI", "F2100W", 21.0), ("MIRI", "F2550W", 25.5),
    ("ACS", "F435W", 0.4329), ("ACS", "F475W", 0.4747), ("ACS", "F502N", 0.5023), ("ACS", "F550M", 0.5581), ("ACS", "F555W", 0.5361),
    ("ACS", "F606W", 0.5907), ("ACS", "F625W", 0.6311), ("ACS", "F658N", 0.6584), ("ACS", "F660N", 0.6599), ("ACS", "F775W", 0.7693),
    ("ACS", "F814W", 0.8057), ("ACS", "F850LP", 0.9033),
    ("WFC3/UVIS", "F218W", 0.2228), ("WFC3/UVIS", "F225W", 0.2372), ("WFC3/UVIS", "F275W", 0.271), ("WFC3/UVIS", "F336W", 0.3355),
    ("WFC3/UVIS", "F390W", 0.3924), ("WFC3/UVIS", "F438W", 0.4326), ("WFC3/UVIS", "F475W", 0.4773), ("WFC3/UVIS", "F555W", 0.5308),
    ("WFC3/UVIS", "F606W", 0.5887), ("WFC3/UVIS", "F625W", 0.6242), ("WFC3/UVIS", "F775W", 0.7651), ("WFC3/UVIS", "F814W", 0.8039),
    ("WFC3/UVIS", "F850LP", 0.9176),
    ("WFC3/IR", "F098M", 0.9864), ("WFC3/IR", "F105W", 1.0552), ("WFC3/IR", "F110W", 1.1534), ("WFC3/IR", "F125W", 1.2486),
    ("WFC3/IR", "F127M", 1.274), ("WFC3/IR", "F139M", 1.3838), ("WFC3/IR", "F140W", 1.3923), ("WFC3/IR", "F153M", 1.5322),
    ("WFC3/IR", "F160W", 1.5369),
)

# Instrument keys in order of preference when only the filter is known.
PREFERENCE = (
    ("NIRCAM", "JWST", "NIRCam"),
    ("NIRISS", "JWST", "NIRISS"),
    ("MIRI", "JWST", "MIRI"),
    ("WFC3/IR", "HST", "WFC3"),
    ("ACS", "HST", "ACS"),
    ("WFC3/UVIS", "HST", "WFC3"),
)

# Telescope and display name of each supported instrument word.
INSTRUMENTS = {
    "NIRCAM": ("JWST", "NIRCam"),
    "NIRISS": ("JWST", "NIRISS"),
    "MIRI": ("JWST", "MIRI"),
    "ACS": ("HST", "ACS"),
    "WFC3": ("HST", "WFC3"),
}

# The form of a filter token, alone and inside a file name.
FILTER_PATTERN = r"^F\d{3,4}(?:W2|LP|[WMNX])?$"
NAME_FILTER_PATTERN = r"(?i)(?<![a-z0-9])(f\d{3,4}(?:w2|lp|[wmnx])?)(?![a-z0-9])"
NAME_INSTRUMENT_PATTERN = r"(?i)(?<![a-z0-9])(nircam|niriss|miri|acs|wfc3)(?![a-z0-9])"


def pivot_table(spark: SparkSession) -> DataFrame:
    """lookup_key, filter, pivot_um: 84 rows, always small enough to broadcast."""
    return spark.createDataFrame(list(PIVOTS), "lookup_key string, filter string, pivot_um double")


def word(v: Column) -> Column:
    """A header word as compared: upper case, trimmed, empty when missing."""
    return F.upper(F.trim(F.coalesce(v, F.lit(""))))


def is_filter_token(v: Column) -> Column:
    return v.rlike(FILTER_PATTERN)


def is_clear(v: Column) -> Column:
    return (v == "") | v.startswith("CLEAR")


def is_broadband(filt: Column) -> Column:
    return filt.endswith("W") | filt.endswith("W2")


def instrument_key(telescop: Column, instrume: Column) -> Column:
    """NIRCAM, NIRISS, MIRI, ACS or WFC3; NULL for anything else or for a pair that cannot be."""
    jwst_names, hst_names = ("NIRCAM", "NIRISS", "MIRI"), ("ACS", "WFC3")

    def decide(w: Column) -> Column:
        in_jwst, in_hst = w["ins"].isin(*jwst_names), w["ins"].isin(*hst_names)
        return F.when((w["tel"] == "JWST") | in_jwst, F.when(in_jwst, w["ins"])).when(
            (w["tel"] == "HST") | in_hst, F.when(in_hst, w["ins"])
        )

    return let(pack(tel=word(telescop), ins=word(instrume)), decide)


def by_instrument(key: Column, what: int) -> Column:
    """Telescope (0) or display name (1) of an instrument word."""
    pairs = [F.lit(x) for name, pair in INSTRUMENTS.items() for x in (name, pair[what])]
    return F.try_element_at(F.create_map(*pairs), key)


def header_filter(key: Column, filt: Column, pupil: Column, filter1: Column, filter2: Column) -> Column:
    """The science filter: pupil before filter wheel (NIRCam, NIRISS), the single
    non-clear wheel (ACS), the FILTER word otherwise."""

    def decide(w: Column) -> Column:
        plain = F.when(is_filter_token(w["f"]), w["f"])
        first = ~is_clear(w["f1"]) & is_filter_token(w["f1"])
        second = ~is_clear(w["f2"]) & is_filter_token(w["f2"])
        return (
            F.when(w["key"].isin("NIRCAM", "NIRISS"), F.when(is_filter_token(w["p"]), w["p"]).otherwise(plain))
            .when(w["key"].isin("MIRI", "WFC3"), plain)
            .when(w["key"] == "ACS", F.when(first & ~second, w["f1"]).when(second & ~first, w["f2"]))
        )

    return let(pack(key=key, f=word(filt), p=word(pupil), f1=word(filter1), f2=word(filter2)), decide)


def lookup_key(key: Column, detector: Column) -> Column:
    return F.when(
        key == "WFC3", F.when(word(detector) == "IR", "WFC3/IR").otherwise("WFC3/UVIS")
    ).otherwise(key)


def pivot_estimate(key: Column, filt: Column) -> Column:
    """Wavelength read off the filter number: nanometres for ACS and UVIS, else 0.01 micron."""
    digits = F.regexp_extract(filt, r"^F(\d{3,4})", 1)
    number = F.when(digits != "", digits.cast("double"))
    return F.when(number.isNull(), 0.0).when(key.isin("ACS", "WFC3/UVIS"), number / 1000.0).otherwise(
        number * 0.01
    )


def name_filters(filename: Column) -> Column:
    """Distinct filter tokens standing alone in a file name, upper case."""
    found = F.regexp_extract_all(filename, F.lit(NAME_FILTER_PATTERN), 1)
    return F.array_distinct(F.transform(found, F.upper))


def only(tokens: Column) -> Column:
    """The token of a one-token array, else NULL."""
    return let(tokens, lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))))


def name_instruments(filename: Column) -> Column:
    found = F.regexp_extract_all(filename, F.lit(NAME_INSTRUMENT_PATTERN), 1)
    return F.array_distinct(F.transform(found, F.upper))
