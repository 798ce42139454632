"""First and last counter reading of each asset and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.dates import as_timestamp
from fleetledger.operators.joins import key_join

_PERIODS = {
    "year": ("year",),
    "month": ("year", "month"),
    "day": ("year", "month", "day"),
}
_PARTS = {"year": F.year, "month": F.month, "day": F.day}


def _readings(df: DataFrame, period: str, time: str) -> tuple[DataFrame, list[str]]:
    parts = _PERIODS[period]
    ts = as_timestamp(time, dict(df.dtypes)[time])
    rows = df.select("asset_id", ts.alias("ts"), "counter_value").where(
        "asset_id IS NOT NULL AND ts IS NOT NULL"
    )
    return rows.select("*", *[_PARTS[p]("ts").alias(p) for p in parts]), ["asset_id", *parts]


def counter_period_bounds(df: DataFrame, period: str = "month", time: str = "ts") -> DataFrame:
    """One row per asset and period: first and last timestamp and the counter at each.

    The time column holds epoch milliseconds, timestamps or text; readings without a time are left out.
    Of several readings at the first timestamp the least counter is taken, at the last one the
    greatest. No join: timestamp and counter travel together through one aggregation.
    """
    rows, keys = _readings(df, period, time)
    reading = F.struct("ts", "counter_value")
    bounds = rows.groupBy(*keys).agg(F.min(reading).alias("first"), F.max(reading).alias("last"))
    return bounds.select(
        *keys,
        F.col("last.ts").alias("max_timestamp"),
        F.col("first.ts").alias("min_timestamp"),
        F.col("first.counter_value").alias("counter_value_min"),
        F.col("last.counter_value").alias("counter_value_max"),
    )


def counter_bound_readings(df: DataFrame, period: str = "month", time: str = "ts") -> DataFrame:
    """Every reading at the first or last timestamp of its asset and period, ties included.

    Long form: one row per distinct counter value at a bound, with the number of readings that
    share it. It holds all tied readings and grows with them, where a wide row per pair of a first
    and a last reading would grow with their product.
    """
    rows, keys = _readings(df, period, time)
    span = rows.groupBy(*keys).agg(F.min("ts").alias("min"), F.max("ts").alias("max"))
    bounds = span.unpivot(keys, ["min", "max"], "bound", "ts")
    # The reading time is part of the join key, so a busy asset spreads over all partitions.
    tied = key_join(rows, bounds, [*keys, "ts"], "inner", null_safe=False)
    return tied.groupBy(*keys, "bound", "ts", "counter_value").agg(F.count("*").alias("n_readings"))


def annualised(counter: Column, days: Column) -> Column:
    """Counter per 365 days; no days, no rate."""
    return F.try_divide(counter, days) * F.lit(365)
