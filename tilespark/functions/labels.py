"""Names, formats, addresses and sizes as Column functions, and the retry rules of the tile client."""

from __future__ import annotations

import email.utils
import random
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to format, longest side by format, world-file extension by format.
FORMATS = {".webp": "webp", ".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png"}
LONGEST_SIDE = {"webp": 16383, "jpeg": 65535, "png": 1 << 20}
WORLD_FILE = {"webp": ".wld", "jpeg": ".jgw", "png": ".pgw"}


def looked_up(value: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def extension(path: Column) -> Column:
    """From the last dot on; empty where there is none or a separator follows."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def format_of(path: Column) -> Column:
    """webp, jpeg or png; null for other extensions."""
    ext = F.lower(extension(path))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), ext)


def longest_side(kind: Column) -> Column:
    return looked_up(kind, LONGEST_SIDE)


def world_file_extension(kind: Column) -> Column:
    return looked_up(kind, WORLD_FILE)


def human_bytes(n: Column) -> Column:
    """A size in B, KB, MB or GB, of any integer or decimal type. It counts as the nearest double where it fits 64 bits; ties go to the even digit.

    Digits come from whole numbers: format_string rounds ties up, and bround takes what only reads as a tie for one.
    """

    def in_unit(n: Column, kind: str, power: int, places: int, unit: str) -> Column:
        one, shown = F.lit(1 << power).cast("long"), 10**places
        rest = (n % one).cast("long")
        units, over = ((n - rest) / one).cast(kind), (rest * shown) % one
        digits = ((rest * shown - over) / one).cast("long")
        odd = (digits if places else units) % 2 == 1
        digits = digits + F.when((over * 2 > one) | ((over * 2 == one) & odd), 1).otherwise(0)
        units = (units + F.when(digits == shown, 1).otherwise(0)).cast("string")
        return F.concat(units, F.concat(F.lit("."), F.lpad((digits % shown).cast("string"), places, F.lit("0"))) if places else F.lit(""), F.lit(f" {unit}"))

    fits = n.try_cast("long")
    near = fits.cast("double").cast("long")
    return (
        F.when(fits.isNull(), in_unit(n.cast("decimal(38,0)"), "decimal(38,0)", 30, 2, "GB"))
        .when(fits >= 1 << 30, in_unit(near, "long", 30, 2, "GB"))
        .when(fits >= 1 << 20, in_unit(near, "long", 20, 1, "MB"))
        .when(fits >= 1 << 10, in_unit(near, "long", 10, 0, "KB"))
        .otherwise(F.concat(fits.cast("string"), F.lit(" B")))
    )


def width_of(last: Column) -> Column:
    return F.greatest(F.lit(2), F.length(last.cast("string")))


def chunk_suffix(row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """Zero-padded grid place; nothing for a single chunk."""

    def part(v: Column, n: Column) -> Column:
        return F.lpad(v.cast("string"), width_of(n - 1), F.lit("0"))

    return F.when(rows * cols == 1, F.lit("")).otherwise(F.concat(F.lit("_r"), part(row, rows), F.lit("_c"), part(col, cols)))


def tile_url(template: Column, z: Column, x: Column, y: Column, token: Column) -> Column:
    """The template with its places filled, and the token, encoded for a query, if there is one."""
    u = template
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        u = F.replace(u, F.lit(name), value.cast("string"))
    joint = F.when(F.contains(u, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(F.coalesce(token, F.lit("")) == "", u).otherwise(F.concat(u, joint, F.lit("token="), F.url_encode(token)))


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)token=.*", "token=REDACTED")


# The same rules for the code that sends requests.

RETRIES = 4
MOST_BYTES = 8 << 20
TIMEOUT_S = 45.0
LONGEST_WAIT_S, LONGEST_ASKED_S = 10.0, 30.0


def asked_wait(header: str | None, now: float | None = None) -> float:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date; else 0."""
    text = (header or "").strip()
    if not text:
        return 0.0
    try:
        return float(int(text))
    except ValueError:
        pass
    try:
        return email.utils.parsedate_to_datetime(text).timestamp() - (time.time() if now is None else now)
    except (TypeError, ValueError):
        return 0.0


def wait_bounds(attempt: int, asked: float = 0.0, timed_out: bool = False) -> tuple[float, float]:
    """Least and most seconds before attempt number ``attempt`` (from 1 on)."""
    if asked > 0:
        return min(asked, LONGEST_ASKED_S), min(asked, LONGEST_ASKED_S)
    base = (0.5 if timed_out else 0.2) * 2 ** (attempt - 1)
    return min(base, LONGEST_WAIT_S), min(base * 1.5, LONGEST_WAIT_S)


def wait_before(attempt: int, asked: float = 0.0, timed_out: bool = False) -> float:
    return random.uniform(*wait_bounds(attempt, asked, timed_out))


def redact(url: str) -> str:
    at = url.find("token=")
    return url if at < 0 else url[:at] + "token=REDACTED"
