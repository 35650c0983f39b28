"""String, label and number column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.config import SEVERITIES


def base_name(path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path) -> Column:
    """Last extension in lower case with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def prefix_group(image) -> Column:
    """Text before the first underscore of the stem, else its first four characters."""
    s = stem(image)
    return F.when(F.instr(s, "_") > 0, F.substring_index(s, "_", 1)).otherwise(F.substring(s, 1, 4))


def window_group(image, window: int = 10) -> Column:
    """Last run of digits in the stem divided by the window, else the prefix group."""
    s = stem(image)
    digits = F.element_at(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), -1)
    has = F.regexp_extract(s, r"(\d)", 1) != ""
    whole = digits.cast("bigint")
    bucket = (whole - F.pmod(whole, F.lit(window))) / F.lit(window)
    return F.when(has, bucket.cast("bigint").cast("string")).otherwise(prefix_group(image))


def capitalised(label) -> Column:
    """Trimmed, first letter upper case, the rest lower case."""
    t = F.trim(label)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))


def severity_number(label) -> Column:
    t = capitalised(label)
    out = F.lit(0)
    for n, name in enumerate(SEVERITIES):
        out = F.when(t == name, F.lit(n)).otherwise(out)
    return out.cast("bigint")


def severity_name(number) -> Column:
    """Half-even rounding, clamped to the known labels."""
    n = F.greatest(F.lit(0), F.least(F.lit(2), F.bround(number, 0).cast("int")))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), n + 1)


def frame_time(frame_idx, fps, offset) -> Column:
    """Seconds of a frame on the GPS clock; a non-positive rate counts as 30."""
    rate = F.when(fps > 0, fps).otherwise(F.lit(30.0))
    return frame_idx / rate + offset


def epoch_seconds(text) -> Column:
    """A float epoch or an ISO-8601 instant (no zone means UTC session time), else null."""
    iso = F.try_to_timestamp(F.trim(text))
    return F.coalesce(text.try_cast("double"), F.unix_micros(iso) / F.lit(1e6))


def median3(values) -> Column:
    """Median of an array of numbers, nulls ignored."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    low = F.element_at(v, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(v, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))
