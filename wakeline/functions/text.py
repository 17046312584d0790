"""Conversions and strings as column expressions; nothing here raises on bad input but ``required``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that tell nothing about a destination.
BAD_DESTINATIONS = ("CLASS A", "CLASS B", "CLASS C", "UNKNOWN", "UNDEFINED", "NONE", "N/A", "NA")
BAD_PREFIX = "CLASS "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_int(x, default: int = -1) -> Column:
    """A whole number from a JSON value kept as text: digits with an optional sign; anything else gives the default."""
    return F.coalesce(F.trim(_c(x)).try_cast("int"), F.lit(default))


def json_int(raw, default: int = -1) -> Column:
    """A whole number from raw JSON: numbers are cut toward zero, quoted digits count, quoted decimals do not."""
    raw = F.trim(_c(raw))
    quoted = raw.startswith('"')
    inner = F.trim(F.regexp_replace(raw, '^"|"$', ""))
    return F.coalesce(F.when(quoted, F.when(inner.rlike(r"^[+-]?\d+$"), inner.try_cast("int"))).otherwise(raw.try_cast("double").try_cast("int")), F.lit(default))


def byte_text(x, size: int, default: str = "null") -> Column:
    """Text cut to so many UTF-8 bytes, whole characters only; the default for null."""
    raw = F.encode(F.coalesce(_c(x).cast("string"), F.lit(default)), "UTF-8")
    return F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, size).cast("string")), "�+$", "")


def lossy_text(raw) -> Column:
    """Bytes as text: malformed runs are replaced and trailing NULs go."""
    return F.regexp_replace(F.make_valid_utf8(_c(raw).cast("string")), "\\x00+$", "")


def normal_destination(x) -> Column:
    """Upper case, with underscores and hyphens as blanks, and single blanks between words; empty for null."""
    clean = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^[\s\x00]+|[\s\x00]+$", "")
    return F.upper(F.trim(F.regexp_replace(F.translate(clean, "_-", "  "), r"\s+", " ")))


def bad_destination(normal) -> Column:
    normal = _c(normal)
    return (normal == "") | normal.isin(*BAD_DESTINATIONS) | normal.startswith(BAD_PREFIX)


def short_label(x, most: int) -> Column:
    x = _c(x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def human_bytes(size) -> Column:
    """A size with the largest unit below it, in steps of 1024."""
    n, out = _c(size).cast("double"), None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        text = F.format_string(f"%.2f {unit}", n / float(1024**power))
        out = F.when(n >= float(1024**power), text) if out is None else out.when(n >= float(1024**power), text)
    return out.otherwise(F.format_string("%.2f B", n))


def range_label(low, high) -> Column:
    return F.format_string("%08d-%08d", _c(low), _c(high))


def pair_key(a, b) -> Column:
    return F.concat(_c(a).cast("string"), F.lit("->"), _c(b).cast("string"))


def group_name(name) -> Column:
    """A zone's name without the number at its end."""
    return F.trim(F.regexp_extract(_c(name), r"^(.*?)(?:\s+\d+)?$", 1))


def tile_of(path) -> dict[str, Column]:
    """Zoom and place of a map tile from its path."""
    return {n: F.regexp_extract(_c(path), rf"{k}:(\d+)", 1).try_cast("int") for n, k in (("tile_z", "z"), ("tile_x", "X"), ("tile_y", "Y"))}


def url_position(url) -> Column:
    """Longitude, latitude and zoom that a map's URL names, as a struct; null where it names none."""
    url = F.col(url) if isinstance(url, str) else url
    number = r"(-?\d+(?:\.\d+)*)"
    pattern = f"centerx:{number}/centery:{number}/zoom:(\\d+)"
    part = lambda k, kind: F.nullif(F.regexp_extract(url, pattern, k), F.lit("")).try_cast(kind)
    return F.when(F.regexp_like(url, F.lit(pattern)), F.struct(part(1, "double").alias("x"), part(2, "double").alias("y"), part(3, "int").alias("zoom")))


def event_time(response, elapsed) -> Column:
    """When a fix was taken: the response's time less its age."""
    return _c(response) - F.coalesce(_c(elapsed), F.lit(0))
