"""Service cases, booked costs and unit margins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.aggregates import sum_or_zero
from fleetledger.functions.dates import from_epoch_millis_whole_seconds
from fleetledger.operators.grouping import known_keys, mean_by
from fleetledger.operators.joins import key_join, left_join

_TRX_KEYS = (
    "service_request_number",
    "sub_division",
    "cost_category",
    "project_code",
    "fiscal_period",
    "ledger",
    "account_dd",
)
_ACCOUNT_KEYS = ("hierarchy_1", "hierarchy_2", "hierarchy_3", "alt_hierarchy")


def case_event_timeline(
    cases: DataFrame,
    subcases: DataFrame,
    events: DataFrame,
    start: dt.date,
    end: dt.date,
    segment: str,
    excluded_site: str,
) -> DataFrame:
    """Cases of a segment created between two dates, with their subcases and maintenance events.

    Newest case first; the ids break ties, which also lets the sort split a busy day. ``end`` is a point in time, midnight of that day, as the source query has it.
    Only the case side is filtered, and it is filtered and projected before the joins.
    """
    picked = cases.where(
        F.col("created").between(F.lit(start), F.lit(end))
        & F.col("segment").contains(segment)
        & F.col("site_customer").isNotNull()
        & (F.col("site_name") != excluded_site)
    ).select(
        "case_id", "site_name", "site_customer", "case_number",
        F.col("created").alias("case_created"), "incident",
        F.col("closed").alias("case_closed"), "event_link",
    )
    subs = subcases.select("subcase_id", "main_case_id", F.col("created").alias("subcase_created"))
    done = events.select(
        "event_id",
        "main_event_id",
        F.col("case_number").alias("event_case_number"),
        from_epoch_millis_whole_seconds("approval_ms").alias("approval_date"),
        from_epoch_millis_whole_seconds("engine_ready_ms").alias("engine_ready"),
    )
    chained = left_join(picked, subs, [("case_id", "main_case_id")], null_safe=False)
    chained = left_join(
        chained, done, [("case_id", "event_case_number")], null_safe=False, keep_right_keys=True
    )
    return chained.drop("case_id").orderBy(
        F.desc("case_created"), "case_number", "subcase_id", "event_id"
    )


def cost_actuals(
    trx: DataFrame,
    accounts: DataFrame,
    period_suffix: str,
    project: str,
    segment: str = "Services",
    account_type: str = "Expense",
) -> DataFrame:
    """Booked amounts of service requests by request, account hierarchy and period.

    Transactions are summed per account before the chart of accounts is joined, so the join sees
    one row per group and no account is hot, however large the chart of accounts is. An account
    listed twice counts twice, as in a join of the single transactions.
    """
    booked = (
        trx.where(
            F.col("fiscal_period").endswith(period_suffix)
            & (F.col("project_code") == project)
            & F.col("service_request_ref").isNotNull()
            & (F.col("business_segment") == segment)
            & (F.col("service_request_number") != "")
            & F.col("account").isNotNull()
        )
        .groupBy(*_TRX_KEYS, "account")
        .agg(F.sum("amount_eur").alias("amount_eur"))
    )
    chart = accounts.where(F.col("account_type") == account_type).select("account", *_ACCOUNT_KEYS)
    joined = key_join(booked, chart, ["account"], "inner", null_safe=False)
    return joined.groupBy(*_TRX_KEYS, *_ACCOUNT_KEYS).agg(F.sum("amount_eur").alias("amt_eur_trx"))


def cost_detail(
    trx: DataFrame,
    accounts: DataFrame,
    period_suffix: str,
    project: str,
    n: int,
    order_by: Sequence[str],
    account_type: str = "Expense",
) -> DataFrame:
    """The first ``n`` single transactions with all account columns, which get the prefix ``coa_``."""
    booked = trx.where(
        F.col("fiscal_period").endswith(period_suffix)
        & (F.col("project_code") == project)
        & (F.col("service_request_number") != "")
    )
    chart = accounts.where(F.col("account_type") == account_type)
    chart = chart.withColumnsRenamed({c: f"coa_{c}" for c in chart.columns})
    joined = key_join(
        booked, chart, [("account", "coa_account")], "inner", null_safe=False, keep_right_keys=True
    )
    return joined.orderBy(*order_by).limit(n)


def unit_financials(df: DataFrame) -> DataFrame:
    """Yearly cost, billings and margin of each unit and contract, from rows with billings.

    A missing billing amount is not a zero and stays in. Billings that add up to zero have no margin.
    """
    keys = ["unit_serial", "contract_number", "billing_year"]
    rows = df.withColumn("billing_year", F.year("unit_period")).where("billings <> 0 OR billings IS NULL")
    billings, cost = F.col("billings"), F.col("cost")
    return (
        known_keys(rows, keys)
        .groupBy(*keys)
        .agg(*[sum_or_zero(c).alias(c) for c in ("cost", "billings", "ic_cost")])
        .withColumn("cm", F.try_divide(billings - cost, billings))
    )


def enrich_with_margin(base: DataFrame, financials: DataFrame) -> DataFrame:
    """The base rows with the financials of their unit, contract and year."""
    keys = ["unit_serial", "contract_number", ("year", "billing_year")]
    # The financials have no null keys, so nothing is lost by plain equality.
    return left_join(base, financials, keys, null_safe=False)


def margin_by_segment(
    enriched: DataFrame, keys: Sequence[str] = ("service_region", "industry", "gas_type")
) -> DataFrame:
    """Mean margin per region, industry and gas type."""
    return mean_by(enriched, keys, "cm", "cm")
