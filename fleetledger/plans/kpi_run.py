"""The monthly KPI run: current figures, and current figures together with their history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetledger.functions.dates import as_of_dates, shift_months
from fleetledger.plans.funnel import (
    FLEET_IB_TYPES,
    FunnelSpec,
    contract_funnel,
    fleet_status,
    kpi_metadata,
)
from fleetledger.sources.snapshots import append_snapshot, write_results

FUNNEL_KEYS = ("filter", "kpi", "category", "timestamp")
STATUS_KEYS = ("kpi", "timestamp")


@dataclass(frozen=True)
class KpiRun:
    """Where a run writes and what it counts."""

    path: str
    funnel: FunnelSpec
    types: Sequence[str]
    fleet_ib_types: Sequence[str] = FLEET_IB_TYPES
    months: int = 24


def run_kpis(spark: SparkSession, landscape: DataFrame, run: KpiRun, as_of: dt.date) -> dict[str, DataFrame]:
    """Write the current tables and the appended snapshots of one run, and return them.

    The fleet status is taken at the last as-of date of the funnel. The history is read back from
    the written current tables, so each report is computed once.
    """
    last = shift_months(as_of, -1)
    exempt = run.funnel.exemptions
    current = {
        "funnel": contract_funnel(landscape, run.funnel, as_of_dates(as_of, run.months)),
        "fleet_status": fleet_status(landscape, last, run.types, run.fleet_ib_types, exempt),
        "kpi_metadata": kpi_metadata(spark, last, run.fleet_ib_types, exempt),
    }
    written = write_results(current, f"{run.path}/current/{as_of.isoformat()}")
    tables = {name: spark.read.parquet(place) for name, place in written.items()}
    keys = {"funnel": FUNNEL_KEYS, "fleet_status": STATUS_KEYS, "kpi_metadata": STATUS_KEYS}
    archive = {
        f"{name}_history": append_snapshot(table, f"{run.path}/archive/{name}", as_of, keys[name])
        for name, table in tables.items()
    }
    return {**tables, **archive}
