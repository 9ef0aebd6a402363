"""Time frames, segments and periods. Frames are in seconds, times and intervals in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frames by name, in seconds. W1 and MN1 are 7 and 30 days from the epoch, not of the calendar.
SECONDS = {
    "UNKNOWN": 0, "S1": 1, "S3": 3, "S5": 5, "S15": 15, "M1": 60, "M5": 300, "M15": 900, "M30": 1800,
    "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800, "MN1": 2592000,
}
HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000
# The length of a storage segment, by frame.
SEGMENT = {
    "S1": HOUR, "S3": HOUR, "S5": HOUR, "S15": HOUR, "M1": DAY, "M5": DAY, "M15": DAY, "M30": DAY, "H1": DAY, "H4": WEEK, "D1": WEEK,
}
SEGMENTABLE = tuple(SECONDS[k] for k in SEGMENT)
#: Intervals that a longer one may be built from, longest first; the shortest frame is not among them.
STEPS = tuple(1000 * s for s in sorted(SEGMENTABLE, reverse=True)[:-1])


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(pairs: dict, key: Column, otherwise: Column) -> Column:
    table = F.create_map(*(F.lit(x).cast("long") for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), otherwise)


def to_ms(frame: Column | str) -> Column:
    return _col(frame).cast("long") * 1000


def to_timeframe(seconds: Column | str) -> Column:
    """The frame of that many seconds, 0 if there is none."""
    s = _col(seconds)
    return F.when(s.isin(*SECONDS.values()), s.cast("long")).otherwise(F.lit(0).cast("long"))


def to_timeframe_ms(ms: Column | str) -> Column:
    m = _col(ms)
    return F.when(m % 1000 == 0, to_timeframe((m / 1000).cast("long"))).otherwise(F.lit(0).cast("long"))


def segment_ms(frame: Column | str) -> Column:
    """The segment length of a frame; an error for a frame that isn't kept in segments."""
    s = _col(frame).cast("long")
    pairs = {SECONDS[k]: v for k, v in SEGMENT.items()}
    return _lookup(pairs, s, F.raise_error(F.concat(F.lit("no segment for frame "), s.cast("string"))).cast("long"))


def is_segmentable(frame: Column | str) -> Column:
    return _col(frame).isin(*SEGMENTABLE)


def is_segmentable_ms(ms: Column | str) -> Column:
    return _col(ms).isin(*(1000 * s for s in SEGMENTABLE))


def lower_timeframe(frame: Column | str) -> Column:
    """The next shorter segmentable frame; 0 below the shortest and for frames outside the chain."""
    chain = sorted(SEGMENTABLE, reverse=True)
    return _lookup(dict(zip(chain, chain[1:])), _col(frame).cast("long"), F.lit(0).cast("long")).cast("int")


def lower_interval_ms(ms: Column | str) -> Column:
    """The step below a known interval if it divides it; for another interval the longest known step that properly divides it; else 0."""
    m = _col(ms).cast("long")
    below = _lookup(dict(zip(STEPS, STEPS[1:])), m, F.lit(None).cast("long"))
    steps = F.array(*(F.lit(s).cast("long") for s in STEPS))
    other = F.get(F.filter(steps, lambda s: (m > s) & (m % s == 0)), 0)
    known = F.when(m % below == 0, below).otherwise(F.lit(0).cast("long"))
    return F.when(below.isNotNull(), known).otherwise(F.coalesce(other, F.lit(0).cast("long")))


def is_aligned(time_ms: Column | str, frame: Column | str, literal: bool = False) -> Column:
    """Whether a bar of that frame may start at that time. literal: take the remainder by the frame's seconds, not milliseconds."""
    step = _col(frame).cast("long") * (1 if literal else 1000)
    return F.pmod(_col(time_ms), step) == 0


def floor_to(time_ms: Column | str, period_ms: int | Column) -> Column:
    t, p = _col(time_ms), F.lit(period_ms) if isinstance(period_ms, int) else period_ms
    return (t - F.pmod(t, p)).cast("long")


def period_number(time_ms: Column | str, period_ms: int | Column) -> Column:
    """Which period of that length a time lies in."""
    p = F.lit(period_ms) if isinstance(period_ms, int) else period_ms
    return (floor_to(time_ms, p) / p).cast("long")


def nearest_hour(time_ms: Column | str) -> Column:
    return period_number(_col(time_ms) + HOUR // 2, HOUR)


def seconds_to_ms(seconds: Column | str) -> Column:
    """Seconds with a fraction, to whole milliseconds."""
    return F.round(_col(seconds).cast("double") * 1000).cast("long")


def aligned_range(start: Column | str, end: Column | str, duration_ms: int | Column) -> tuple[Column, Column]:
    """Start floored, and end moved to the boundary after it (also if it is on one)."""
    d = F.lit(duration_ms) if isinstance(duration_ms, int) else duration_ms
    return floor_to(start, d), floor_to(end, d) + d
