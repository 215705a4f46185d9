"""Slugs, object classes, serving headers, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cache windows in seconds and the purge batch size.
TILE_MAX_AGE = 604800
STALE_GRACE = 2592000
ASSET_MAX_AGE = 31536000
PURGE_BATCH = 100

# Content type by file extension; anything else is a byte stream.
CONTENT_TYPES = {
    ".json": "application/json",
    ".csv": "text/csv",
    ".html": "text/html",
    ".js": "text/javascript",
    ".mjs": "text/javascript",
    ".css": "text/css",
    ".map": "application/json",
    ".svg": "image/svg+xml",
    ".wasm": "application/wasm",
    ".woff2": "font/woff2",
    ".woff": "font/woff",
    ".ico": "image/x-icon",
    ".txt": "text/plain",
}
BYTE_STREAM = "application/octet-stream"

# Names a band may not take because output files use them.
RESERVED = ("dataset", "catalog", "index", "assets", "deploy", "embed", "collection")

LEDGER_NAME = "deploy-manifest.json"


def band_slug(name: Column) -> Column:
    """Anything but letters, digits, ``_`` and ``-`` becomes ``_``; empty becomes ``band``."""
    s = F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")
    return F.when(s == "", "band").otherwise(s)


def dataset_slug(name: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "dataset").otherwise(s)


def strip_fits_suffix(name: Column) -> Column:
    """Drop one of .fz/.gz, then one of .fits/.fit, ignoring case."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.(fz|gz)$", ""), r"(?i)\.(fits|fit)$", "")


def object_class(path: Column) -> Column:
    """tile (compressed image), asset (hashed bundle) or pointer (all else)."""
    return (
        F.when(F.lower(path).endswith(".fits.fz"), "tile")
        .when(path.startswith("assets/"), "asset")
        .otherwise("pointer")
    )


def cache_control(cls: Column, tile_max_age: int = TILE_MAX_AGE, grace: int = STALE_GRACE) -> Column:
    return (
        F.when(cls == "tile", f"public, max-age={tile_max_age}, stale-while-revalidate={grace}")
        .when(cls == "asset", f"public, max-age={ASSET_MAX_AGE}, immutable")
        .otherwise("public, no-cache")
    )


def content_type(path: Column) -> Column:
    low = F.lower(path)
    base = F.regexp_extract(low, r"[^/]*$", 0)
    # A leading dot starts a name, not an extension.
    ext = F.regexp_extract(base, r"[^.].*(\.[^.]*)$", 1)
    out = F.when(low.endswith(".fits.fz"), BYTE_STREAM)
    for suffix, kind in CONTENT_TYPES.items():
        out = out.when(ext == suffix, kind)
    return out.otherwise(BYTE_STREAM)


def object_key(prefix: Column, path: Column) -> Column:
    p = F.trim(prefix, F.lit("/"))
    return F.when(p == "", path).otherwise(F.concat_ws("/", p, path))


def public_url(base: Column, path: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def sibling(manifest_path: Column, filename: Column) -> Column:
    """``filename`` next to a manifest."""
    folder = F.regexp_replace(manifest_path, "/?[^/]*$", "")
    return F.when(folder == "", filename).otherwise(F.concat_ws("/", folder, filename))


def is_site_file(path: Column) -> Column:
    return (path == "index.html") | path.startswith("assets/")


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``, NULL when it is not below it."""
    r = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    rest = F.when(path.startswith(r), path.substr(F.length(r) + 1, F.length(path)))
    return F.when(~rest.rlike(r"(^|/)\.\.(/|$)"), rest)


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")
