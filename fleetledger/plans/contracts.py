"""Active contracts and the contract count profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.aggregates import distinct_count
from fleetledger.functions.text import (
    SERIAL_PREFIXES,
    any_term,
    lacks_marker,
    normalize_serial,
    strip_literals,
)
from fleetledger.operators.grouping import first_per_key
from fleetledger.plans.funnel import ACTIVE

# Fixed value: marks serials that stand for no real unit.
PLACEHOLDER = "Dummy"


def active_contracts(landscape: DataFrame) -> DataFrame:
    """Distinct rows of active contracts on real units, with normalised unit and engine serials.

    A missing unit serial is kept.
    """
    rows = landscape.where((F.col("contract_status") == ACTIVE) & lacks_marker("unit_serial_raw", PLACEHOLDER))
    renamed = {
        "contract_type": "oracle_contract_type",
        "unit_status": "oracle_unit_status",
        "unit_serial_raw": "usn_unformatted",
        "engine_serial_raw": "esn_unformatted",
    }
    # The serials follow from the raw ones, so they are made once per distinct row.
    serials = {"usn": normalize_serial("unit_serial_raw"), "esn": normalize_serial("engine_serial_raw")}
    return rows.distinct().withColumns(serials).withColumnsRenamed(renamed)


def contract_profile(extract: DataFrame, type_terms: Sequence[str]) -> DataFrame:
    """Counts over the active contracts of a cleaned landscape extract, one row per contract.

    Rows of the result, by ``part``: ``totals``, ``by_type_and_status``, and for the contract types
    that hold one of the terms ``selected_by_type`` and ``selected_totals``; each with its number of
    contracts and of distinct unit serials. Of several rows of a contract the least one stays, in
    the order of the columns. One pass: the parts are grouping sets over the contracts.
    """
    active = extract.where(F.col("oracle_contract_type") == ACTIVE).withColumns(
        {
            "unit_serial_raw": strip_literals("unit_serial_raw", SERIAL_PREFIXES),
            "engine_serial_raw": strip_literals("engine_serial_raw", SERIAL_PREFIXES),
        }
    )
    contracts = first_per_key(
        active, ["oracle_contract_number"], [c for c in active.columns if c != "oracle_contract_number"]
    ).select(
        "oracle_contract_number",
        "unit_serial_raw",
        "contract_type",
        F.col("oracle_unit_status").alias("unit_status"),
        F.coalesce(any_term("contract_type", type_terms), F.lit(False)).alias("selected"),
    )
    by_type, by_status, by_selection = (
        F.grouping(c) == 0 for c in ("contract_type", "unit_status", "selected")
    )
    part = (
        F.when(by_status, "by_type_and_status")
        .when(by_type, "selected_by_type")
        .when(by_selection, "selected_totals")
        .otherwise("totals")
    )
    sets = [[], ["contract_type", "unit_status"], ["selected", "contract_type"], ["selected"]]
    counted = contracts.groupingSets(sets, "contract_type", "unit_status", "selected").agg(
        part.alias("part"),
        F.count("oracle_contract_number").alias("n_contracts"),
        distinct_count("unit_serial_raw", count_null=False).alias("n_units"),
    )
    known = F.col("contract_type").isNotNull() & F.col("unit_status").isNotNull()
    kept = (
        F.when(F.col("part") == "by_type_and_status", known)
        .when(F.col("part") == "totals", F.lit(True))
        .otherwise(F.col("selected"))
    )
    return counted.where(kept).select("part", "contract_type", "unit_status", "n_contracts", "n_units")
