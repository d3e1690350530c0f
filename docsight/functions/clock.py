"""Date and time arithmetic on wall clocks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the days from Monday, and of the parts of the day with the hour at which each ends.
WEEKDAYS = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日")
PERIODS = ((6, "凌晨"), (12, "上午"), (14, "中午"), (18, "下午"), (24, "晚上"))

_SECONDS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


_DAY, _CLOCK = r"\d{4}(?:-\d\d){2}", r"\d\d(?::\d\d){1,2}"


def base_time(text: Column) -> Column:
    """The first day, with its clock time if one follows, in a text; null without a valid one."""
    piece = F.regexp_extract(F.translate(text, "T", " "), f"{_DAY}(?: {_CLOCK})?", 0)
    return F.nullif(piece, F.lit("")).try_cast("timestamp_ntz")


def delta_seconds(delta: Column) -> Column:
    """The sum of parts like ``+2d``, ``-3h``, ``30m`` and ``45s`` in seconds; 0 without any."""

    def seconds(unit: str, worth: int) -> Column:
        numbers = F.regexp_extract_all(delta, F.lit(rf"([-+]?[0-9]+)\s*{unit}"), F.lit(1))
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, n: s + n.try_cast("long") * worth)

    return sum((seconds(unit, worth) for unit, worth in _SECONDS.items()), F.lit(0).cast("long"))


def shifted(base: Column, delta: Column) -> Column:
    """The wall-clock time of ``base`` moved by ``delta``; null if the base holds no date."""
    return base_time(base) + F.make_dt_interval(secs=delta_seconds(delta))


def weekday(time: Column) -> Column:
    return F.when(time.isNotNull(), F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(time)))


def period(time: Column) -> Column:
    out = F.lit(None).cast("string")
    for end, label in reversed(PERIODS):
        out = F.when(F.hour(time) < end, label).otherwise(out)
    return out
