"""Calendar bins in a time zone: keys that sort as their times do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    """Wall time in ``zone`` of a zone-less UTC timestamp, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def bin_key(ts: Column, interval: str, zone: str = "UTC", turn: Column | None = None) -> Column:
    """Key of ``15m``, ``6h``, ``3d``, ``1w`` or ``10t``: minutes and hours restart at local midnight, days on
    the first of the month, weeks are ISO weeks whatever their number, turns count to the last in the bin."""
    n, unit = int(interval[:-1]), interval[-1]
    t = local(ts, zone)
    day = F.date_format(t, "yyyy-MM-dd")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    if unit == "m":
        at = F.floor((F.hour(t) * 60 + F.minute(t)) / n) * n
        return F.concat(day, F.lit(" "), pad(F.floor(at / 60)), F.lit(":"), pad(at % 60))
    if unit == "h":
        return F.concat(day, F.lit(" "), pad(F.floor(F.hour(t) / n) * n), F.lit(":00"))
    if unit == "d":
        return F.concat(F.date_format(t, "yyyy-MM-"), pad(F.floor((F.dayofmonth(t) - 1) / n) * n + 1))
    if unit == "w":
        return F.date_format(F.date_trunc("week", t), "yyyy-MM-dd")
    if unit == "t":
        return F.lpad((F.ceil(turn / n) * n).cast("string"), 6, "0")
    raise ValueError(f"no such interval: {interval}")
