"""Time keys and slots as column expressions. A time key is yyyy_MM_dd_HH_mm_ss, whose order is that of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy_MM_dd_HH_mm_ss"


def time_key(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def key_time(key: Column) -> Column:
    return F.to_timestamp_ntz(key, F.lit(FORMAT))


def shifted(ts: Column, slots: Column, minutes: int = 5) -> Column:
    return ts + F.make_interval(mins=slots * minutes)


def past_keys(ts: Column, frames: int = 6, minutes: int = 5) -> Column:
    """Keys of the last `frames` slots, this one included, oldest first."""
    return F.transform(F.sequence(F.lit(frames - 1), F.lit(0)), lambda i: time_key(shifted(ts, -i, minutes)))


def future_keys(ts: Column, frames: int, minutes: int = 5, zero_as: int | None = None) -> Column:
    """Keys of the next slots. zero_as: what 0 frames stand for, where they are to mean a default."""
    frames = zero_as if not frames and zero_as else frames
    if frames < 1:
        return F.array().cast("array<string>")
    return F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: time_key(shifted(ts, i, minutes)))


def ends_month(ts: Column, step: str = "5 minutes") -> Column:
    """Whether one step later is another month."""
    return F.month(ts + F.expr(f"interval {step}")) != F.month(ts)


def radar_url(ts: Column, template: str) -> Column:
    """The template with %Y %m %d %H %M filled in."""
    out = F.lit(template)
    for sign, part in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm")):
        out = F.replace(out, F.lit(sign), F.date_format(ts, part))
    return out
