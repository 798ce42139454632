"""What the plans must look like to hold at scale."""

import datetime as dt

import pytest
from helpers import SF_DIR
from test_queries import QUERIES

from fleetledger.checks import standins as views
from fleetledger.checks.standins import table, view
from fleetledger.operators.joins import left_join
from fleetledger.plans.costs import cost_actuals
from fleetledger.plans.counters import counter_period_bounds
from fleetledger.plans.funnel import Exemptions, FunnelSpec, contract_funnel, fleet_status

# Build their result with jobs of their own, so there is no single plan to look at.
SKIP = {"kpi_run", "snapshot_roundtrip", "probit_fit"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_pairwise_joins_and_no_row_at_a_time_python(spark, name):
    plan = physical(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    rows = table(spark, SF_DIR, "lineitem")
    plan = physical(rows.where("l_returnflag = 'A'").groupBy("l_suppkey").agg({"l_tax": "sum"}))
    assert "EqualTo(l_returnflag,A)" in plan and "ReadSchema: struct<l_suppkey:bigint,l_tax:double,l_returnflag:string>" in plan
    actuals = cost_actuals(view(spark, SF_DIR, views.TRANSACTIONS), view(spark, SF_DIR, views.ACCOUNTS), "98", "P1")
    assert "l_quantity" not in physical(actuals)


def test_counter_bounds_shuffle_once(spark):
    plan = physical(counter_period_bounds(view(spark, SF_DIR, views.COUNTERS), "month"))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_null_safe_keys_still_join_by_hash_or_sort(spark):
    a = spark.range(10).selectExpr("id AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(left_join(a, a.selectExpr("k", "k + 1 AS v"), ["k"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_snapshot_reads_one_partition(spark, rows, tmp_path):
    from fleetledger.sources.snapshots import _committed, read_latest_snapshot, write_snapshot

    for day in (1, 2, 3):
        write_snapshot(rows([("a", day)], "k string, v int"), str(tmp_path), dt.date(2024, 1, day))
    latest = read_latest_snapshot(spark, str(tmp_path), rows([], "k string, v int").schema)
    files = latest.inputFiles()
    newest = _committed(spark, str(tmp_path))[dt.date(2024, 1, 3)]
    assert files and all(f"{newest}/" in f for f in files)
    assert latest.first()["v"] == 3


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "20",
}


@pytest.fixture
def small_skew(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL_SKEW}
    for name, value in SMALL_SKEW.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_unit_is_split_in_the_funnel_join(spark, small_skew):
    """A third of all rows is one unit with a contract of its own each."""
    landscape = spark.range(120_000).selectExpr(
        "concat('contract-', id) AS contract_number",
        "if(id % 3 = 0, 'hot', concat('unit-', id % 5000)) AS unit_serial",
        "'A' AS contract_type", "'s' AS contract_type2", "'ACTIVE' AS contract_status", "'ACTIVE' AS unit_status",
        "'Active' AS ib_status", "if(id % 1000 = 0, 'Blue', 'Red') AS customer_name", "'x' AS contract_name",
        "'Spain' AS country", "date_add(DATE '2020-01-01', cast(id % 700 AS int)) AS commissioning",
    )
    spec = FunnelSpec(types=["A"], exemptions=Exemptions(customer_name=["blue"]))
    found = contract_funnel(landscape, spec, [dt.date(2021, 1, 1), dt.date(2022, 12, 31)])
    last = {(r["kpi"], r["filter"]): r["value"] for r in found.collect() if r["timestamp"].year == 2022}
    assert "SortMergeJoin(skew=true)" in physical(found)
    assert last["contract_number", "ib_active"] == 120_000
    # Ids by thousands: every third one is the hot unit, the others share the units 1000, 2000, ...
    flagged = landscape.where("customer_name = 'Blue'").select("unit_serial").distinct()
    exempt = landscape.join(flagged, "unit_serial", "left_semi").count()
    assert last["contract_number", "not_unit_level"] == exempt > 40_000
    assert last["contract_number", "unit_level"] == 120_000 - exempt


def test_copies_of_one_row_are_split_in_a_join(spark, small_skew):
    """Rows that agree in every column cannot be spread by their content, but by map output."""
    fact = spark.range(200_000, numPartitions=8).selectExpr(
        "if(id % 10 < 9, 7, id) AS k", "if(id % 10 < 9, repeat('copy ', 60), cast(id AS string)) AS t"
    )
    side = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    totals = left_join(fact, side, ["k"]).groupBy("v", "t").count()
    assert max(r["count"] for r in totals.collect()) >= 180_000
    assert "SortMergeJoin(skew=true)" in physical(totals)


def test_the_funnel_reads_two_narrow_scans_of_a_stored_landscape(spark, tmp_path):
    path = str(tmp_path / "landscape")
    view(spark, SF_DIR, views.LANDSCAPE).write.parquet(path)
    spec = FunnelSpec(types=["1-URGENT", "2-HIGH"], exemptions=Exemptions(country=["atlantis"]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = physical(contract_funnel(spark.read.parquet(path), spec, [dt.date(2001, 1, 1)]))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    counted = next(s for s in scans if "commissioning" in s)
    for pushed in ("EqualTo(contract_status,ACTIVE)", "contract_type", "LessThanOrEqual(commissioning,2001-01-01)"):
        assert pushed in counted
    flags = next(s for s in scans if s is not counted)
    assert "commissioning" not in flags and "contract_status" not in flags and "unit_serial" in flags


def test_the_fleet_status_scans_once(spark, tmp_path):
    path = str(tmp_path / "landscape")
    view(spark, SF_DIR, views.LANDSCAPE).write.parquet(path)
    found = fleet_status(spark.read.parquet(path), dt.date(2001, 1, 1), ["1-URGENT"], exemptions=Exemptions(country=["x"]))
    plan = physical(found)
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
