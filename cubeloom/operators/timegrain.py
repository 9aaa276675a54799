"""Time buckets: truncation with week start and zone, and the spine of all buckets in a window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.instant import naive

STEP = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def bucket(c: Column, grain: str, spark_type: str, week_start: str = "monday", timezone: str | None = None) -> Column:
    """The start of the bucket that a value is in, of the value's own type.

    A zone shifts the clock before truncating: a timestamp without zone counts as UTC. Dates are not
    shifted.
    """
    if spark_type == "date":
        shifted = c.cast("timestamp_ntz")
    elif timezone:
        shifted = F.convert_timezone(F.lit("UTC"), F.lit(timezone), c.cast("timestamp_ntz"))
    else:
        shifted = c
    if grain == "week" and week_start == "sunday":
        cut = F.date_trunc("week", shifted + F.expr("interval 1 day")) - F.expr("interval 1 day")
    else:
        cut = F.date_trunc(grain, shifted)
    if spark_type == "date":
        return cut.cast("date")
    return cut.cast("timestamp_ntz" if timezone else spark_type)


def floor_instant(at: datetime, grain: str, week_start: str = "monday") -> datetime:
    """The same truncation of one instant, on the driver."""
    if grain == "week":
        back = (at.weekday() + (1 if week_start == "sunday" else 0)) % 7
        return (at - timedelta(days=back)).replace(hour=0, minute=0, second=0, microsecond=0)
    parts = {"second": {}, "minute": {"second": 0}, "hour": {"minute": 0, "second": 0}, "day": {"hour": 0, "minute": 0, "second": 0}}
    if grain in parts:
        return at.replace(microsecond=0, **parts[grain])
    month = {"month": at.month, "quarter": (at.month - 1) // 3 * 3 + 1, "year": 1}[grain]
    return at.replace(month=month, day=1, hour=0, minute=0, second=0, microsecond=0)


def spine(spark: SparkSession, window: tuple[str, str], grain: str, spark_type: str, name: str, week_start: str = "monday", timezone: str | None = None) -> DataFrame:
    """One row per bucket that meets [start, end); an empty window has none."""
    start, end = naive(window[0]), naive(window[1])

    def edge(at: datetime) -> Column:
        value = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        return bucket(value.cast("date") if spark_type == "date" else value, grain, "date" if spark_type == "date" else "timestamp_ntz", week_start, None if spark_type == "date" else timezone)

    if start >= end:
        return spark.range(0).select(edge(start).alias(name))
    last = end - timedelta(microseconds=1)
    buckets = F.sequence(edge(start), edge(last), F.expr(f"interval {STEP[grain]}"))
    out = spark.range(1).select(F.explode(buckets).alias(name))
    return out.withColumn(name, F.col(name).cast("timestamp_ntz" if timezone and spark_type != "date" else spark_type))
