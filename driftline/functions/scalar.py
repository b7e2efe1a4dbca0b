"""Scalar expressions on series: time, labels, text, formats."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candidate offsets from UTC in minutes, the whole hours first,
#: then the half hours and the others between. Of two as near the first counts.
ZONE_MINUTES = (*range(-720, 841, 60), -570, -210, 210, 330, 570, 630, 345, 765)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp taken as UTC,
    whatever the session's time zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def seconds(us: Column) -> Column:
    return us.cast("double") / 1e6


def relative_minutes(t: Column, origin: Column) -> Column:
    return (t - origin) / 60


def magnitude(*parts: Column) -> Column:
    """Length of a vector."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def wrist(gz: Column, below: float = -0.5) -> Column:
    return F.when(gz < below, "down").when(gz.isNotNull(), "up")


def rate_of(interval_ms: Column) -> Column:
    """Events a minute from the gap between two, in milliseconds; without a gap
    it is infinite, with the sign of the zero."""
    gap = interval_ms.cast("double")
    endless = F.when(gap.cast("string").startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
    return F.when(gap == 0, endless).otherwise(F.try_divide(F.lit(60000.0), gap))


def epoch_index(t: Column, origin: Column, epoch_s: float, shift: int = 0) -> Column:
    """Number of the epoch that holds ``t``; negative before the origin."""
    return F.floor((t - origin) / float(epoch_s)) - shift


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds a value; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def prefix_strip(name: Column, *prefixes: str) -> Column:
    return F.regexp_replace(name, "^(" + "|".join(prefixes) + ")", "")


def cohort(record: Column) -> Column:
    """An identifier without the digits at its end."""
    return F.regexp_replace(record, "[0-9]+$", "")


def recode(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """Mapped labels; others pass through, or become ``default``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value if default is None else default)


def calibrate(digital: Column, d_min: Column, d_max: Column, p_min: Column, p_max: Column) -> Column:
    """Physical value of a digital sample, by the two ranges."""
    return (digital - d_min) * ((p_max - p_min) / (d_max - d_min)) + p_min


def fixed_text(x: Column, digits: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, half
    to even, as C and Python print it; ``format_string`` rounds the shortest
    decimal that stands for it, half up. For values below 2**52 / 10**digits."""
    scale = float(10**digits)
    a = F.abs(x)

    def halves(v):
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (ah, al), (sh, sl) = halves(a), halves(scale)
    high = a * scale
    low = ((ah * sh - high) + ah * sl + al * sh) + al * sl  # high + low is the exact product
    whole = F.floor(high)
    over = high - whole.cast("double") - 0.5
    up = (over > 0) | ((over == 0) & ((low > 0) | ((low == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    parts = [F.floor(n / scale).cast("string"), *([F.lpad((n % int(scale)).cast("string"), digits, "0")] if digits else [])]
    text = F.concat_ws(".", *parts)
    return F.when(x.isNull(), None).when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def duration_text(s: Column) -> Column:
    """12.0s, 3.5m or 2.25h."""
    minutes, hours = F.concat(fixed_text(s / 60, 1), F.lit("m")), F.concat(fixed_text(s / 3600, 2), F.lit("h"))
    return F.when(s < 60, F.concat(fixed_text(s, 1), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def offset_text(s: Column) -> Column:
    """A signed offset as +1h02m03.25s."""
    a = F.abs(s)
    whole = F.floor(a / 60)
    rest = F.lpad(fixed_text(a - whole * 60, 2), 5, "0")
    return F.concat(F.when(s < 0, "-").otherwise("+"), F.format_string("%dh%02dm", F.floor(a / 3600), whole % 60), rest, F.lit("s"))


def nearest_zone(offset_s: Column) -> Column:
    """struct<minutes, residual_s>: the candidate UTC offset nearest to an
    offset; the first of ``ZONE_MINUTES`` among some as near."""
    gaps = F.array(*[F.struct(F.abs(offset_s - 60.0 * m).alias("gap"), F.lit(k).alias("k"), F.lit(m).alias("minutes")) for k, m in enumerate(ZONE_MINUTES)])
    best = F.array_min(gaps)
    return F.struct(best.minutes.alias("minutes"), (offset_s - 60.0 * best.minutes).alias("residual_s"))


#: Characters that compatibility normalisation turns into a plain space.
SPACES = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: Forms that it turns into plain ASCII, by their offset: full-width letters, digits and signs.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def plain(name: Column) -> Column:
    """Lower case, with every kind of space as a space and full-width forms as
    plain ones: what names of sources are compared by."""
    ascii_of = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
    return F.lower(F.translate(name, SPACES + WIDE, " " * len(SPACES) + ascii_of))


def source_matches(name: Column, needle: str) -> Column:
    return plain(name).contains(unicodedata.normalize("NFKC", needle).lower())


def is_device(hardware: Column, model: Column, prefix: str) -> Column:
    """By the prefix of the hardware version, or else the model's name."""
    return F.coalesce(hardware.startswith(prefix), F.lit(False)) | F.coalesce(model == prefix, F.lit(False))


def night_of(text: Column, hours_back: int = 12) -> Column:
    """Date that a local night belongs to, from 'yyyy-MM-dd HH:mm:ss Z': the
    wall clock, ``hours_back`` earlier, whatever the offset from UTC."""
    wall = F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_date(wall - F.expr(f"INTERVAL {hours_back} HOURS"))


def parse_offset_time(text: Column) -> Column:
    """Instant of 'yyyy-MM-dd HH:mm:ss Z'; null if it can't be read."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z"))
