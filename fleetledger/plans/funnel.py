"""Contract funnel and fleet status: how many contracts and units pass each status stage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetledger.functions.text import any_term
from fleetledger.operators.joins import left_join

# Statuses as the source system writes them.
ACTIVE = "ACTIVE"
FUNNEL_IB_TYPES = ("Active", "Standby", "Active Docu incomplete")
FLEET_IB_TYPES = ("Active", "Temporarily Inactive", "Active Docu incomplete")

STAGES = ("contract_active", "unit_active", "ib_active", "unit_level", "not_unit_level")

FLEET_KPIS = (
    "active_contracts",
    "active_units",
    "active_units_not_unit_level",
    "active_units_commissioned",
)


@dataclass(frozen=True)
class Exemptions:
    """Terms that mark a unit as not executed on unit level, per landscape column.

    Customer terms compare in upper case, the others in lower case.
    """

    customer_name: Sequence[str] = ()
    contract_name: Sequence[str] = ()
    country: Sequence[str] = ()

    def condition(self) -> Column:
        tests = [
            any_term("customer_name", self.customer_name, "upper"),
            any_term("contract_name", self.contract_name, "lower"),
            any_term("country", self.country, "lower"),
        ]
        return reduce(or_, [F.coalesce(test, F.lit(False)) for test in tests])

    def text(self) -> str:
        parts = ["customer:", *self.customer_name, "contract:", *self.contract_name, "country:", *self.country]
        return "|".join(parts)


@dataclass(frozen=True)
class FunnelSpec:
    """What to count. A category is one contract type, or a list of types named by its first one."""

    types: Sequence[str | Sequence[str]]
    kpi_keys: Sequence[str] = ("unit_serial", "contract_number")
    types2: Sequence[str] = ()
    ib_types: Sequence[str] = FUNNEL_IB_TYPES
    exemptions: Exemptions = field(default_factory=Exemptions)

    def groups(self) -> dict[str, list[str]]:
        listed = [[t] if isinstance(t, str) else list(t) for t in self.types]
        return {group[0]: group for group in listed}

    def criteria(self) -> dict[str, str]:
        """The real criteria of each stage, as text."""
        contract = f"contract status {ACTIVE}"
        unit = f"{contract} & unit status {ACTIVE}"
        ib = f"{unit} & installed-base status in {'|'.join(self.ib_types)}"
        return {
            "contract_active": contract,
            "unit_active": unit,
            "ib_active": ib,
            "unit_level": f"{ib} & not {self.exemptions.text()}",
            "not_unit_level": f"{ib} & {self.exemptions.text()}",
        }


def _category(groups: Mapping[str, Sequence[str]]) -> Column:
    """The category of a contract type; a type listed in several categories counts in each."""
    tests = [F.when(F.col("contract_type").isin(list(ts)), F.lit(label)) for label, ts in groups.items()]
    listed = [t for ts in groups.values() for t in ts]
    if len(set(listed)) == len(listed):
        return F.coalesce(*tests)
    return F.explode(F.array_compact(F.array(*tests)))


def first_dates(landscape: DataFrame, spec: FunnelSpec, until: dt.date) -> DataFrame:
    """Per category, KPI key and entity: the first commissioning date that lets it pass each stage.

    The as-of date only enters the reports as ``commissioning <= as_of``, so the earliest date per
    stage answers every as-of date at once. Rows are reduced to one per category, keys and status
    level before the join with the exempt units, so a unit with many rows enters the join once per
    contract.
    """
    groups = spec.groups()
    active_unit = F.col("unit_status") == ACTIVE
    in_base = active_unit & F.col("ib_status").isin(list(spec.ib_types))
    level = F.when(in_base, 3).when(active_unit, 2).otherwise(1)

    wanted = [t for ts in groups.values() for t in ts]
    rows = landscape.where(
        (F.col("contract_status") == ACTIVE)
        & F.col("contract_type").isin(wanted)
        & (F.col("commissioning") <= F.lit(until))
    )
    if spec.types2:
        rows = rows.where(F.col("contract_type2").isin(list(spec.types2)))

    keys = list(dict.fromkeys([*spec.kpi_keys, "unit_serial"]))
    reduced = (
        rows.select(_category(groups).alias("category"), *keys, level.alias("level"), "commissioning")
        .groupBy("category", *keys, "level")
        .agg(F.min("commissioning").alias("since"))
    )
    # The exempt units come from the whole table: no date, status or type restricts them.
    exempt_units = landscape.where(spec.exemptions.condition()).select("unit_serial").distinct()
    flagged = left_join(reduced, exempt_units.withColumn("exempt", F.lit(True)), ["unit_serial"])
    exempt = F.coalesce("exempt", F.lit(False))

    def since(test: Column) -> Column:
        return F.min(F.when(test, F.col("since")))

    kpi = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in spec.kpi_keys])
    entity = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in spec.kpi_keys])
    return (
        flagged.groupingSets([["category", k] for k in spec.kpi_keys], "category", *spec.kpi_keys)
        .agg(
            kpi.alias("kpi"),
            entity.alias("entity"),
            F.min("since").alias("contract_active"),
            since(F.col("level") >= 2).alias("unit_active"),
            since(F.col("level") == 3).alias("ib_active"),
            since((F.col("level") == 3) & ~exempt).alias("unit_level"),
            since((F.col("level") == 3) & exempt).alias("not_unit_level"),
        )
        .select("category", "kpi", "entity", *STAGES)
    )


def _stage_rows(dates: DataFrame) -> DataFrame:
    """One row per entity and stage it ever passes."""
    pairs = F.array(*[F.struct(F.lit(s).alias("filter"), F.col(s).alias("since")) for s in STAGES])
    return dates.select("category", "kpi", "entity", F.inline(pairs)).where("since IS NOT NULL")


def _literal_rows(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of a few parameter lists, as a table."""
    rows = spark.range(1)
    for name, values in columns.items():
        rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows.drop("id")


def _reached_at(column: str, dates: Sequence[dt.date]) -> Column:
    """The first of the ascending dates that is not before the value; the last one holds for the rest."""
    *early, last = [f"DATE '{day.isoformat()}'" for day in dates]
    cases = " ".join(f"WHEN {column} <= {day} THEN {day}" for day in early)
    return F.expr(f"CASE {cases} ELSE {last} END" if cases else last)


def contract_funnel(landscape: DataFrame, spec: FunnelSpec, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Distinct entities per as-of date, category, KPI key and stage; null counts as one entity.

    Combinations without any entity are reported as zero. Without any as-of date there is nothing to count at: a ValueError says so.
    """
    dates = sorted(set(as_of_dates))
    if not dates:
        raise ValueError("contract_funnel needs at least one as-of date")
    stages = _stage_rows(first_dates(landscape, spec, dates[-1]))
    # The first as-of date an entity is counted at; dates[-1] bounds them all.
    entered = stages.groupBy("category", "kpi", "filter", _reached_at("since", dates).alias("timestamp")).agg(
        F.count("*").alias("n")
    )

    grid = _literal_rows(
        landscape.sparkSession,
        {"category": list(spec.groups()), "kpi": list(spec.kpi_keys), "filter": STAGES, "timestamp": dates},
    )
    labels = F.coalesce(*[F.when(F.col("filter") == s, F.lit(c)) for s, c in spec.criteria().items()])
    # One partition per category, key and stage, with as many rows as there are as-of dates.
    so_far = (
        Window.partitionBy("category", "kpi", "filter")
        .orderBy("timestamp")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = left_join(grid, entered, ["category", "kpi", "filter", "timestamp"], null_safe=False)
    return counted.select(
        "filter",
        F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("value"),
        "timestamp",
        labels.alias("operationalization"),
        "category",
        "kpi",
    )


def funnel_members(landscape: DataFrame, spec: FunnelSpec, as_of: dt.date) -> DataFrame:
    """The distinct entities behind each funnel count at one date."""
    return _stage_rows(first_dates(landscape, spec, as_of)).select("filter", "category", "kpi", "entity")


def fleet_status(
    landscape: DataFrame,
    as_of: dt.date,
    types: Sequence[str],
    ib_types: Sequence[str] = FLEET_IB_TYPES,
    exemptions: Exemptions = Exemptions(),
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Four KPIs as rows, one column per contract type and a total of distinct entities.

    A type column ignores null entities, the total counts null once; an entity in several types is
    counted once in the total. ``labels`` renames the type columns. One scan and one shuffle: each
    contract and each unit is reduced to flags per type, which are then added up.
    """
    due = (F.col("contract_status") == ACTIVE) & (F.col("commissioning") <= F.lit(as_of))
    unit_due = due & (F.col("unit_status") == ACTIVE)
    base_due = unit_due & F.col("ib_status").isin(list(ib_types))
    exempt = exemptions.condition()

    def seen(test: Column, name: str) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False)).alias(name)

    tests = []
    for i, contract_type in enumerate(types):
        of_type = F.col("contract_type") == contract_type
        tests += [
            seen(due & of_type, f"contract_{i}"),
            seen(unit_due & of_type, f"unit_{i}"),
            seen(base_due & of_type, f"base_{i}"),
        ]
    rows = landscape.where((due & F.col("contract_type").isin(list(types))) | exempt)
    entities = rows.groupingSets([["contract_number"], ["unit_serial"]], "contract_number", "unit_serial").agg(
        (F.grouping("contract_number") == 0).alias("is_contract"), seen(exempt, "exempt"), *tests
    )

    is_contract, exempted = F.col("is_contract"), F.col("exempt")
    named = F.when(is_contract, F.col("contract_number").isNotNull()).otherwise(
        F.col("unit_serial").isNotNull()
    )
    rules = {
        "active_contracts": ("contract", is_contract),
        "active_units": ("unit", ~is_contract),
        "active_units_not_unit_level": ("unit", ~is_contract & exempted),
        "active_units_commissioned": ("base", ~is_contract),
    }
    columns = [(labels or {}).get(t, t) for t in types]
    sums, cells = [], []
    for kpi, (flag, scope) in rules.items():
        flags = [F.col(f"{flag}_{i}") for i in range(len(types))]
        sums += [F.count_if(scope & named & f).alias(f"{kpi}_{i}") for i, f in enumerate(flags)]
        sums.append(F.count_if(scope & reduce(or_, flags)).alias(f"{kpi}_total"))
        parts = [F.col(f"{kpi}_{i}").alias(c) for i, c in enumerate(columns)]
        cells.append(F.struct(*parts, F.col(f"{kpi}_total").alias("total"), F.lit(kpi).alias("kpi")))
    return (
        entities.agg(*sums)
        .select(F.inline(F.array(*cells)))
        .withColumn("timestamp", F.lit(as_of))
    )


def kpi_metadata(
    spark: SparkSession,
    as_of: dt.date,
    ib_types: Sequence[str] = FLEET_IB_TYPES,
    exemptions: Exemptions = Exemptions(),
) -> DataFrame:
    """The criteria behind each fleet status KPI: KPI, list of criteria, date."""
    contract = ["contract status:", ACTIVE]
    unit = ["contract status:, unit status:", ACTIVE, ACTIVE]
    criteria = {
        "active_contracts": contract,
        "active_units": unit,
        "active_units_not_unit_level": [
            "contract status:, unit status:, unit in exempt group:",
            ACTIVE,
            ACTIVE,
            *exemptions.customer_name,
            *exemptions.contract_name,
            *exemptions.country,
        ],
        "active_units_commissioned": [
            "contract status:, unit status:, installed-base status:",
            ACTIVE,
            ACTIVE,
            *ib_types,
        ],
    }
    rows = [F.struct(F.lit(k).alias("kpi"), F.array(*map(F.lit, c)).alias("operationalization"))
            for k, c in criteria.items()]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("timestamp", F.lit(as_of))
