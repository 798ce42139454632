import datetime as dt
import itertools
import random

import pytest
from helpers import as_list, as_set
from pyspark.sql import functions as F

from fleetledger.functions.dates import as_of_dates
from fleetledger.plans.contracts import active_contracts, contract_profile
from fleetledger.plans.costs import (
    cost_actuals,
    enrich_with_margin,
    margin_by_segment,
    unit_financials,
)
from fleetledger.plans.counters import counter_bound_readings, counter_period_bounds
from fleetledger.plans.funnel import (
    STAGES,
    Exemptions,
    FunnelSpec,
    contract_funnel,
    fleet_status,
    funnel_members,
    kpi_metadata,
)
from fleetledger.plans.kpi_run import KpiRun, run_kpis
from fleetledger.plans.model_inputs import cost_features_asset, cost_features_unit

LANDSCAPE = (
    "contract_number string, unit_serial string, contract_type string, contract_type2 string, contract_status string, "
    "unit_status string, ib_status string, customer_name string, contract_name string, country string, commissioning date"
)
EXEMPT = Exemptions(customer_name=["blue"], contract_name=["RENT"], country=["atlantis"])


def some_landscape(seed=3, n=400):
    rng = random.Random(seed)
    pick = rng.choice
    data = []
    for _ in range(n):
        # One unit holds a third of all rows.
        unit = "hot" if rng.random() < 0.33 else pick([None, *[f"u{i}" for i in range(40)]])
        data.append((
            pick([None, *[f"c{i}" for i in range(60)]]), unit, pick(["A", "B", "C", None]), pick(["s", "t"]),
            pick(["ACTIVE", "ACTIVE", "CLOSED", None]), pick(["ACTIVE", "ACTIVE", "ENDED", None]),
            pick(["Active", "Standby", "Retired", None]), pick(["Blue AG", None, *["Red"] * 30]),
            pick(["x", None, *["y"] * 20]), pick(["Norway", None, "Atlantis", *["Spain"] * 40]),
            pick([None, dt.date(2022, 1, 1) + dt.timedelta(days=rng.randrange(900))]),
        ))
    return data


def brute_funnel(data, types, keys, dates, types2=()):
    fields = {n.split()[0]: i for i, n in enumerate(LANDSCAPE.split(", "))}

    def get(row, name):
        return row[fields[name]]

    def exempt(row):
        customer, name, country = (get(row, c) for c in ("customer_name", "contract_name", "country"))
        return ("BLUE" in (customer or "").upper() or "rent" in (name or "").lower()
                or "atlantis" in (country or "").lower())

    flagged = {get(r, "unit_serial") for r in data if exempt(r)}
    out, members = {}, {}
    for (label, group), key, day in itertools.product(types.items(), keys, dates):
        due = [r for r in data if get(r, "contract_type") in group and (not types2 or get(r, "contract_type2") in types2)
               and get(r, "contract_status") == "ACTIVE" and get(r, "commissioning") and get(r, "commissioning") <= day]
        unit = [r for r in due if get(r, "unit_status") == "ACTIVE"]
        base = [r for r in unit if get(r, "ib_status") in ("Active", "Standby", "Active Docu incomplete")]
        levels = [due, unit, base, [r for r in base if get(r, "unit_serial") not in flagged],
                  [r for r in base if get(r, "unit_serial") in flagged]]
        for stage, passed in zip(STAGES, levels):
            found = {get(r, key) for r in passed}
            out[stage, label, key, day] = len(found)
            members[stage, label, key, day] = found
    return out, members


@pytest.fixture(scope="module")
def landscape(spark):
    return spark.createDataFrame(some_landscape(), LANDSCAPE).repartition(6).cache()


@pytest.mark.parametrize("types2", [(), ("s",)])
def test_funnel_equals_one_count_per_date(landscape, types2):
    spec = FunnelSpec(types=["A", ("B", "A"), "missing"], types2=types2, exemptions=EXEMPT)
    days = as_of_dates(dt.date(2024, 5, 31))
    keys = ["unit_serial", "contract_number"]
    want, _ = brute_funnel(some_landscape(), {"A": ["A"], "B": ["B", "A"], "missing": ["missing"]}, keys, days, types2)
    got = {(r["filter"], r["category"], r["kpi"], r["timestamp"]): r["value"]
           for r in contract_funnel(landscape, spec, days).collect()}
    assert got == want
    assert any(v == 0 for v in want.values()) and max(want.values()) > 5


def test_funnel_stages_nest_and_grow(landscape):
    spec = FunnelSpec(types=["A"], kpi_keys=["unit_serial"], exemptions=EXEMPT)
    values = {}
    for r in contract_funnel(landscape, spec, as_of_dates(dt.date(2024, 5, 31))).collect():
        values.setdefault(r["timestamp"], {})[r["filter"]] = r["value"]
    for day in values.values():
        assert day["contract_active"] >= day["unit_active"] >= day["ib_active"]
        assert day["unit_level"] + day["not_unit_level"] == day["ib_active"]
    for earlier, later in itertools.pairwise(sorted(values)):
        assert all(values[earlier][s] <= values[later][s] for s in STAGES)


def test_funnel_with_one_date_and_members(landscape):
    spec = FunnelSpec(types=["A", "C"], exemptions=EXEMPT)
    day = dt.date(2023, 6, 15)
    want, members = brute_funnel(some_landscape(), {"A": ["A"], "C": ["C"]}, spec.kpi_keys, [day])
    got = contract_funnel(landscape, spec, [day])
    assert {(r["filter"], r["category"], r["kpi"], r["timestamp"]): r["value"] for r in got.collect()} == want
    lists = {}
    for r in funnel_members(landscape, spec, day).collect():
        lists.setdefault((r["filter"], r["category"], r["kpi"], day), set()).add(r["entity"])
    assert lists == {k: v for k, v in members.items() if v}


def test_fleet_status_totals_count_null_and_parts_do_not(rows):
    day = dt.date(2024, 1, 1)
    old, new = dt.date(2020, 1, 1), dt.date(2025, 1, 1)
    act = ("ACTIVE", "ACTIVE", "Active", "Red", "y", "Spain")
    data = [
        ("c1", "u1", "A", "s", *act, old), ("c1", "u2", "B", "s", *act, old), (None, None, "A", "s", *act, old),
        ("c2", "u3", "A", "s", *act, new), ("c3", "u4", "X", "s", *act, old),
        ("c4", "u5", "B", "s", "ACTIVE", "ACTIVE", "Retired", "Red", "y", "Spain", old),
        ("c5", "u1", "X", "s", "CLOSED", "ENDED", None, "Blue", None, None, None),
    ]
    got = fleet_status(rows(data, LANDSCAPE), day, ["A", "B"], exemptions=EXEMPT)
    assert got.columns == ["A", "B", "total", "kpi", "timestamp"]
    assert as_set(got) == {
        (1, 2, 3, "active_contracts", day),
        (1, 2, 4, "active_units", day),
        (1, 0, 1, "active_units_not_unit_level", day),
        (1, 1, 3, "active_units_commissioned", day),
    }


def test_fleet_status_with_a_flagged_missing_unit(rows):
    act = ("ACTIVE", "ACTIVE", "Active")
    data = [("c1", None, "A", "s", *act, "Blue", "y", "Spain", dt.date(2020, 1, 1))]
    got = {r["kpi"]: (r["A"], r["total"]) for r in
           fleet_status(rows(data, LANDSCAPE), dt.date(2024, 1, 1), ["A"], exemptions=EXEMPT).collect()}
    assert got["active_units_not_unit_level"] == (0, 1)


def test_kpi_metadata(spark):
    found = kpi_metadata(spark, dt.date(2024, 1, 1), ("Active",), EXEMPT).collect()
    assert len(found) == 4 and {r["timestamp"] for r in found} == {dt.date(2024, 1, 1)}
    texts = {r["kpi"]: r["operationalization"] for r in found}
    assert texts["active_contracts"] == ["contract status:", "ACTIVE"]
    assert texts["active_units_not_unit_level"][-3:] == ["blue", "RENT", "atlantis"]


def test_kpi_run_keeps_history_once(spark, landscape, tmp_path):
    run = KpiRun(str(tmp_path), FunnelSpec(types=["A"], exemptions=EXEMPT), ["A", "B"], months=3)
    first = run_kpis(spark, landscape, run, dt.date(2024, 3, 1))
    assert first["funnel_history"].count() == first["funnel"].count() == 5 * 2 * 3
    run_kpis(spark, landscape, run, dt.date(2024, 4, 1))
    second = run_kpis(spark, landscape, run, dt.date(2024, 4, 1))
    assert second["funnel_history"].count() == 5 * 2 * 4
    assert second["fleet_status_history"].count() == 8
    assert second["kpi_metadata_history"].count() == 8


def test_active_contracts(rows):
    schema = ("contract_number string, contract_type string, contract_status string, unit_status string, "
              "unit_serial_raw string, engine_serial_raw string")  # fmt: skip
    data = [
        ("1", "A", "ACTIVE", "x", "JEN-12", "E_1"), ("1", "A", "ACTIVE", "x", "JEN-12", "E_1"),
        ("2", "A", "CLOSED", "x", "JEN-13", "E"), ("3", "A", "ACTIVE", "x", "Dummy 1", "E"),
        ("4", "A", "ACTIVE", "x", None, None),
    ]
    got = active_contracts(rows(data, schema))
    assert {(r["contract_number"], r["usn"], r["esn"]) for r in got.collect()} == {("1", "12", "E_1"), ("4", None, None)}
    assert got.count() == 2


def test_contract_profile_null_rules(rows):
    schema = ("oracle_contract_number string, contract_type string, oracle_contract_type string, oracle_unit_status string, "
              "unit_serial_raw string, engine_serial_raw string")  # fmt: skip
    data = [
        ("1", "MSA A", "ACTIVE", "x", "JEN-2", None), ("1", "MSA A", "ACTIVE", "x", "GEJ-1", None),
        ("2", "MSA A", "ACTIVE", "y", "1", None), ("3", "OTHER", "ACTIVE", "x", None, None),
        ("4", None, "ACTIVE", "x", "9", None), ("5", "MSA B", "CLOSED", "x", "7", None),
        (None, "MSA A", "ACTIVE", "x", "8", None),
    ]
    assert as_set(contract_profile(rows(data, schema), ["MSA"])) == {
        ("totals", None, None, 4, 3),
        ("by_type_and_status", "MSA A", "x", 1, 2),
        ("by_type_and_status", "MSA A", "y", 1, 1),
        ("by_type_and_status", "OTHER", "x", 1, 0),
        ("selected_by_type", "MSA A", None, 2, 2),
        ("selected_totals", None, None, 2, 2),
    }


def test_unit_financials_null_and_zero_rules(rows):
    schema = "unit_period date, unit_serial string, contract_number string, cost double, billings double, ic_cost double"
    day = dt.date(2023, 5, 1)
    data = [
        (day, "u", "c", 1.0, 4.0, None), (day, "u", "c", 5.0, 0.0, 1.0), (day, "u", "c", 1.0, None, None),
        (day, "v", "c", 1.0, 2.0, 1.0), (day, "v", "c", 1.0, -2.0, 1.0), (day, None, "c", 1.0, 2.0, 1.0),
        (day, "w", "c", None, None, None),
    ]
    fin = unit_financials(rows(data, schema))
    assert as_set(fin) == {
        ("u", "c", 2023, 2.0, 4.0, 0.0, 0.5), ("v", "c", 2023, 2.0, 0.0, 2.0, None), ("w", "c", 2023, 0.0, 0.0, 0.0, None)}
    base = rows([("u", "c", 2023, "r", "i", "g"), ("u", "c", 2022, "r", "i", "g"), (None, "c", 2023, "r", "i", None)],
                "unit_serial string, contract_number string, year int, service_region string, industry string, gas_type string")
    enriched = enrich_with_margin(base, fin)
    assert enriched.count() == 3
    assert as_set(margin_by_segment(enriched)) == {("r", "i", "g", 0.5)}


def test_cost_actuals_counts_an_account_listed_twice_twice(rows):
    trx = rows(
        [("sr", "ref", "d", "cat", "P", "JAN-23", "L", "a", "dd", "Services", v) for v in (1.0, 2.0, None)]
        + [("", "ref", "d", "cat", "P", "JAN-23", "L", "a", "dd", "Services", 5.0)]
        + [("sr", None, "d", "cat", "P", "JAN-23", "L", "a", "dd", "Services", 5.0)]
        + [("n", "ref", "d", "cat", "P", "JAN-23", "L", "a", "dd", "Services", None)],
        "service_request_number string, service_request_ref string, sub_division string, cost_category string, "
        "project_code string, fiscal_period string, ledger string, account string, account_dd string, "
        "business_segment string, amount_eur double",
    )
    chart = rows([("a", "1", "2", "3", "x", "Expense"), ("a", "1", "2", "3", "x", "Expense"), ("a", "9", "9", "9", "x", "Revenue")],
                 "account string, hierarchy_1 string, hierarchy_2 string, hierarchy_3 string, alt_hierarchy string, account_type string")
    got = {r["service_request_number"]: r["amt_eur_trx"] for r in cost_actuals(trx, chart, "23", "P").collect()}
    # As in SQL, a sum over nothing but nulls stays null.
    assert got == {"sr": 6.0, "n": None}


def ts(day, hour):
    return dt.datetime(2023, 1, day, hour)


def test_counter_bounds_and_ties(rows):
    data = [
        (1, ts(1, 0), 10.0), (1, ts(1, 0), 12.0), (1, ts(1, 0), 12.0), (1, ts(5, 0), 50.0), (1, ts(9, 0), 90.0),
        (1, ts(9, 0), 95.0), (2, ts(3, 3), 7.0), (None, ts(1, 0), 1.0), (3, None, 1.0),
    ]
    frame = rows(data, "asset_id int, ts timestamp_ntz, counter_value double")
    assert as_set(counter_period_bounds(frame, "month")) == {
        (1, 2023, 1, ts(9, 0), ts(1, 0), 10.0, 95.0), (2, 2023, 1, ts(3, 3), ts(3, 3), 7.0, 7.0)}
    assert as_set(counter_bound_readings(frame, "year")) == {
        (1, 2023, "min", ts(1, 0), 10.0, 1), (1, 2023, "min", ts(1, 0), 12.0, 2), (1, 2023, "max", ts(9, 0), 90.0, 1),
        (1, 2023, "max", ts(9, 0), 95.0, 1), (2, 2023, "min", ts(3, 3), 7.0, 1), (2, 2023, "max", ts(3, 3), 7.0, 1)}


def test_counter_times_in_millis_or_text(rows):
    millis = rows([(1, 1672531200000, 5.0), (1, 1675123200500, 6.0), (1, None, 9.0)], "asset_id int, ms bigint, counter_value double")
    want = {(1, 2023, 1, dt.datetime(2023, 1, 31, 0, 0, 0, 500000), dt.datetime(2023, 1, 1), 5.0, 6.0)}
    assert as_set(counter_period_bounds(millis, "month", "ms")) == want
    text = rows([(1, "2023-01-01", 5.0), (1, "2023-01-31 00:00:00.5", 6.0), (1, "soon", 9.0)],
                "asset_id int, t string, counter_value double")
    assert as_set(counter_period_bounds(text, "month", "t")) == want


OPERATING = (
    "asset_id int, unit_serial string, year int, month int, engine_type string, engine_version string, gas_type string, "
    "gas_type_formatted string, industry string, subregion string, start_year int, contract_start date, "
    "start_hours double, end_hours double, actual_hours double, counter_value_max double"
)


def operating(asset, year, month, start, hours=(0.0, 59999.0), gas="g"):
    return (asset, f"u{asset}", year, month, "e", "v", "gas", gas, "i", "s", 2014, start, *hours, 100.0, 730.0)


def test_cost_features_unit(rows):
    frame = rows([operating(1, 2023, 1, dt.date(2022, 1, 1)), operating(2, 2023, 1, dt.date(2022, 1, 1)),
                  operating(1, 2022, 1, dt.date(2022, 1, 1)), operating(1, 2023, 1, dt.date(2022, 1, 1), (None, 1.0))],
                 OPERATING)
    costs = rows([("Unplanned", "Expense", "u1", 3.0), ("Unplanned", "Expense", "u1", 4.0), ("Planned", "Expense", "u2", 9.0),
                  ("Unplanned", "Expense", None, 9.0)],
                 "cost_category string, margin_class string, unit_serial string, amount_eur double")
    got = cost_features_unit(frame, costs, dt.date(2023, 1, 1)).collect()
    assert [(r["unit_serial"], r["category"], r["run_time"], r["amount_eur"]) for r in got] == [("u1", "059999", 365, 7.0)]


def test_cost_features_asset(rows):
    start = dt.date(2022, 1, 1)
    data = [
        operating(1, 2022, 3, start), operating(1, 2021, 3, start), operating(2, 2022, 3, start),
        operating(None, 2022, 3, start), operating(1, 2022, 4, start, gas=None), operating(1, 2022, 5, start, (0.0, 7.0)),
    ]
    frame = rows(data, OPERATING)
    costs = rows([(1, 2022, 5.0), (None, 2022, 6.0), (2, 2022, None)], "asset_id int, year int, amount_eur double")
    got = as_list(cost_features_asset(frame, costs, top_n=1).select("average_actual_hours", "year", "category", "amount_eur"))
    rate = 730.0 / 364 * 365
    assert got == [(rate, "2022", "059999", 5.0), (rate, "2022", "059999", 6.0)]
    monthly = costs.withColumn("month", F.lit(3))
    by_month = cost_features_asset(frame, monthly, monthly=True, top_n=1, period_end="month")
    assert {r["average_actual_hours"] for r in by_month.collect()} == {730.0 / 89 * 365}
    assert {r["month"] for r in by_month.collect()} == {"3"}


def test_funnel_without_dates_says_so(landscape):
    with pytest.raises(ValueError, match="at least one as-of date"):
        contract_funnel(landscape, FunnelSpec(types=["A"], types2=(), exemptions=EXEMPT), [])
