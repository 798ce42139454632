"""Cost-driver model inputs: operating data joined with costs, ready for a design."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.aggregates import sum_or_zero
from fleetledger.functions.dates import month_end, year_end
from fleetledger.functions.text import as_label
from fleetledger.operators.grouping import keep_top_values, known_keys
from fleetledger.operators.joins import key_join
from fleetledger.plans.counters import annualised

# Fixed value: how many contract end hours a fit by asset keeps.
TOP_END_HOURS = 25

UNIT_CATEGORIES = ("engine_type", "gas_type", "start_year", "category", "year")
UNIT_NUMBERS = ("run_time", "actual_hours", "counter_value_max")
ASSET_CATEGORIES = (
    "engine_type",
    "engine_version",
    "gas_type_formatted",
    "industry",
    "subregion",
    "year",
    "start_year",
    "category",
)
MONTH_CATEGORIES = (*ASSET_CATEGORIES[:6], "month", *ASSET_CATEGORIES[6:])
ASSET_NUMBERS = ("average_actual_hours", "actual_hours")


def _labels(df: DataFrame, *names: str) -> dict[str, Column]:
    types = dict(df.dtypes)
    return {name: as_label(name, types[name]) for name in names}


def _hours_category(df: DataFrame) -> Column:
    parts = _labels(df, "start_hours", "end_hours")
    return F.concat(parts["start_hours"], parts["end_hours"])


def cost_features_unit(
    operating: DataFrame,
    unit_costs: DataFrame,
    as_of: dt.date,
    year: int = 2023,
    cost_category: str = "Unplanned",
    margin_class: str = "Expense",
) -> DataFrame:
    """By unit: unplanned expenses against the run time up to a date, for one operating year."""
    costs = (
        known_keys(unit_costs, ["unit_serial"])
        .where((F.col("cost_category") == cost_category) & (F.col("margin_class") == margin_class))
        .groupBy("unit_serial")
        .agg(sum_or_zero("amount_eur").alias("amount_eur"))
    )
    rows = operating.where((F.col("year") == year)).dropna(how="any", subset=["start_hours", "end_hours"])
    joined = key_join(rows, costs, ["unit_serial"], "inner", null_safe=False)
    return joined.select(
        "unit_serial",
        "engine_type",
        "gas_type",
        _labels(rows, "start_year")["start_year"].alias("start_year"),
        _hours_category(rows).alias("category"),
        _labels(rows, "year")["year"].alias("year"),
        F.date_diff(F.lit(as_of), F.col("contract_start")).alias("run_time"),
        "actual_hours",
        "counter_value_max",
        "amount_eur",
    )


def cost_features_asset(
    operating: DataFrame,
    asset_costs: DataFrame,
    monthly: bool = False,
    top_n: int = TOP_END_HOURS,
    period_end: str = "year",
) -> DataFrame:
    """By asset and year (or month): booked costs against the yearly operating rate.

    Keeps the rows with one of the most frequent contract end hours, a positive run time up to the
    end of the period and no missing value. The period ends with the year, also for months, unless
    ``period_end="month"``.
    """
    period = ["year", "month"] if monthly else ["year"]
    categories = MONTH_CATEGORIES if monthly else ASSET_CATEGORIES
    kept = keep_top_values(operating, "end_hours", top_n)
    end = month_end(F.col("year"), F.col("month")) if period_end == "month" else year_end(F.col("year"))
    rows = (
        kept.withColumn("run_time", F.date_diff(end, F.col("contract_start")))
        .where("run_time > 0")
        .dropna(how="any", subset=["start_hours", "end_hours"])
    )
    # Rows without costs would be dropped as incomplete below, so the join can be an inner one.
    costs = asset_costs.select("asset_id", *period, "amount_eur").where(F.col("amount_eur").isNotNull())
    joined = key_join(rows, costs, ["asset_id", *period], "inner", null_safe=True)
    texts = _labels(rows, *period, "start_year")
    return (
        joined.withColumn("category", _hours_category(rows))
        .withColumn("average_actual_hours", annualised(F.col("counter_value_max"), F.col("run_time")))
        .withColumns(texts)
        .select(*ASSET_NUMBERS, *categories, "amount_eur")
        .dropna(how="any")
    )
