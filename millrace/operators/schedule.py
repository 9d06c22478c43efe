"""Schedule algebra: fire times, backfill grids, batches. Fire times are enumerated on the driver, all else is a table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
_NAMES = (
    {},
    {},
    {},
    {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())},
)


class Cron:
    """A five-field cron schedule (minute, hour, day of month, month, day of week) in UTC."""

    def __init__(self, spec: str) -> None:
        fields = spec.lower().split()
        if len(fields) != 5:
            raise ValueError(f"{spec!r} does not have five fields")
        self.sets = [self._field(f, *r, names) for f, r, names in zip(fields, _RANGES, _NAMES, strict=True)]
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"

    @staticmethod
    def _field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span == "*":
                a, b = low, high
            else:
                first, _, last = span.partition("-")
                a = names[first] if first in names else int(first)
                b = (names[last] if last in names else int(last)) if last else (high if step else a)
            top = 7 if high == 6 else high
            if not low <= a <= b <= top:
                raise ValueError(f"{part!r} is out of range")
            out.update(v % 7 if high == 6 else v for v in range(a, b + 1, int(step or 1)))
        return out

    def _day(self, t: datetime) -> bool:
        day, weekday = t.day in self.sets[2], (t.weekday() + 1) % 7 in self.sets[4]
        either = not self.any_day and not self.any_weekday
        return t.month in self.sets[3] and ((day or weekday) if either else (day and weekday))

    def after(self, t: datetime) -> datetime | None:
        """The first fire later than t; None if there is none within five years."""
        t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        end = t + timedelta(days=5 * 366)
        while t < end:
            if not self._day(t):
                t = t.replace(hour=0, minute=0) + timedelta(days=1)
            elif t.hour not in self.sets[1]:
                t = t.replace(minute=0) + timedelta(hours=1)
            elif t.minute not in self.sets[0]:
                t += timedelta(minutes=1)
            else:
                return t
        return None

    def between(self, start: datetime, end: datetime) -> Iterator[datetime]:
        """Fires in [start, end]."""
        t = self.after(start - timedelta(minutes=1) if start.second == 0 and start.microsecond == 0 else start)
        while t is not None and t <= end:
            yield t
            t = self.after(t)

    def before(self, t: datetime) -> datetime | None:
        """The last fire earlier than t, searched from two periods back."""
        one = self.after(t)
        two = self.after(one) if one else None
        if two is None:
            return None
        start = t - 2 * (two - one) - timedelta(minutes=1)
        fires = [f for f in self.between(start, t) if f < t]
        return fires[-1] if fires else None


def previous_fire(at: datetime, cron: str | None = None, interval: timedelta | None = None) -> datetime | None:
    return at - interval if interval is not None else Cron(cron).before(at)


def fire_times(spark: SparkSession, start: datetime, end: datetime, cron: str | None = None, interval: timedelta | None = None) -> DataFrame:
    """ts: fire times in [start, end]. A fixed interval is a sequence in the plan."""
    if interval is not None:
        bounds = spark.range(1).select(
            F.explode(F.sequence(F.lit(start.isoformat(" ")).cast("timestamp_ntz"), F.lit(end.isoformat(" ")).cast("timestamp_ntz"), F.expr(f"interval {int(interval.total_seconds())} seconds"))).alias("ts")
        )
        return bounds
    rows = [(t.isoformat(" "),) for t in Cron(cron).between(start, end)]
    return spark.createDataFrame(rows, "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))


def backfill_grid(fires: DataFrame, params: DataFrame) -> DataFrame:
    """Every fire time with every parameter: the grid is the result, both sides are schedules."""
    return fires.crossJoin(params)


def batches(df: DataFrame, order: list[str], size: int = 10) -> DataFrame:
    """Rows of a schedule in order, with the number of their batch (from 0)."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("bigint"))


def trigger_kind(batch_rerun: bool = False, start: object = None, end: object = None, interval: object = None, cron: object = None) -> str:
    """Kind of a recurring trigger, the first that fits."""
    if batch_rerun:
        return "batch_rerun"
    if start is not None and end is not None:
        return "backfill"
    if interval is not None:
        return "interval"
    return "cron" if cron is not None else "unknown"
