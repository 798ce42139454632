"""Every report and operator as a query over the test tables: ``name -> (spark, folder) -> table``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.checks import standins as views
from fleetledger.checks.standins import table, view
from fleetledger.functions.aggregates import distinct_count, sum_or_zero
from fleetledger.functions.dates import as_of_dates, from_epoch_millis, from_epoch_millis_whole_seconds
from fleetledger.functions.text import (
    any_term,
    lacks_marker,
    normalize_serial,
    strip_literals,
    text_class,
)
from fleetledger.models.design import build_design, gram_stats, gram_stats_wide, profiled
from fleetledger.models.effects import lattice_effects, segment_effects
from fleetledger.models.iterative import ols_cg
from fleetledger.models.regress import (
    FitResult,
    cost_model,
    ols,
    ols_wide,
    predict,
    probit,
    ridge,
    score_segments,
)
from fleetledger.operators.grouping import count_by, keep_top_values, range_profile, top_values
from fleetledger.operators.joins import anti, left_join, semi
from fleetledger.operators.reshape import (
    active_cells,
    comparison_matrices,
    comparison_matrix,
    cross_cells,
    display_grids,
    explode_combinations,
    interaction_terms,
    one_hot,
    unpivot_metrics,
)
from fleetledger.operators.search import first_keyword, first_keyword_table, matching_rows, search_columns
from fleetledger.plans.contracts import active_contracts, contract_profile
from fleetledger.plans.costs import (
    case_event_timeline,
    cost_actuals,
    cost_detail,
    enrich_with_margin,
    margin_by_segment,
    unit_financials,
)
from fleetledger.plans.counters import counter_bound_readings, counter_period_bounds
from fleetledger.plans.funnel import (
    Exemptions,
    FunnelSpec,
    contract_funnel,
    fleet_status,
    funnel_members,
    kpi_metadata,
)
from fleetledger.plans.kpi_run import KpiRun, run_kpis
from fleetledger.plans.model_inputs import (
    ASSET_CATEGORIES,
    ASSET_NUMBERS,
    MONTH_CATEGORIES,
    UNIT_CATEGORIES,
    UNIT_NUMBERS,
    cost_features_asset,
    cost_features_unit,
)
from fleetledger.session import scratch_path, written_once
from fleetledger.sources.snapshots import append_snapshot, union_history, write_results
from fleetledger.sources.tables import (
    clean_landscape,
    head_rows,
    load_counter_readings,
    load_financials_csv,
    load_table,
)

Query = Callable[[SparkSession, str], DataFrame]

BASE_DATE = dt.date(2001, 11, 1)
TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
TYPE_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
EXEMPT = Exemptions(customer_name=["#000000001"], contract_name=["small ring"], country=["atlantis"])
SPEC = FunnelSpec(types=TYPES, exemptions=EXEMPT)
TWO_TYPES = FunnelSpec(
    types=[("1-URGENT", "2-HIGH"), "2-HIGH"], types2=("BUILDING", "MACHINERY"), exemptions=EXEMPT
)
KEYWORDS = {"shape": ["ring", "bolt", "widget"], "size_word": ["small", "large", "red"]}
DIMS = ["region", "gas", "industry"]

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def _landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, views.LANDSCAPE)


# --- funnel and fleet -------------------------------------------------------------------------


@query("contract_funnel")
def contract_funnel_24_months(spark, sf_dir):
    return contract_funnel(_landscape(spark, sf_dir), SPEC, as_of_dates(BASE_DATE))


@query("contract_funnel_grouped_types")
def contract_funnel_grouped_types(spark, sf_dir):
    return contract_funnel(_landscape(spark, sf_dir), TWO_TYPES, as_of_dates(BASE_DATE, 6))


@query("funnel_members")
def funnel_member_lists(spark, sf_dir):
    return funnel_members(_landscape(spark, sf_dir), SPEC, dt.date(2000, 6, 30))


@query("fleet_status")
def fleet_status_matrix(spark, sf_dir):
    return fleet_status(
        _landscape(spark, sf_dir), dt.date(2001, 10, 1), TYPES, ("Active", "Standby"), EXEMPT, TYPE_LABELS
    )


@query("kpi_metadata")
def fleet_status_with_criteria(spark, sf_dir):
    """The totals of the fleet status next to the criteria behind them."""
    day, ib_types = dt.date(2001, 10, 1), ("Active", "Standby")
    status = fleet_status(_landscape(spark, sf_dir), day, TYPES, ib_types, EXEMPT)
    criteria = kpi_metadata(spark, day, ib_types, EXEMPT)
    return left_join(status.select("kpi", "timestamp", "total"), criteria, ["kpi", "timestamp"]).withColumn(
        "operationalization", F.array_join("operationalization", "|")
    )


@query("kpi_run")
def kpi_run_history(spark, sf_dir):
    """Two monthly runs into one archive; the second one's appended funnel."""
    run = KpiRun(scratch_path(spark, "kpi-run"), SPEC, TYPES)
    rows = _landscape(spark, sf_dir)
    run_kpis(spark, rows, run, dt.date(2001, 10, 1))
    return run_kpis(spark, rows, run, BASE_DATE)["funnel_history"]


# --- contracts --------------------------------------------------------------------------------


@query("active_contracts")
def active_contract_rows(spark, sf_dir):
    return active_contracts(_landscape(spark, sf_dir))


@query("clean_landscape")
def clean_landscape_extract(spark, sf_dir):
    return clean_landscape(_landscape(spark, sf_dir))


@query("contract_profile")
def contract_profile_counts(spark, sf_dir):
    return contract_profile(clean_landscape(_landscape(spark, sf_dir)), ["URGENT", "HIGH"])


# --- scans, text, filters ---------------------------------------------------------------------


@query("full_scan")
def full_scan(spark, sf_dir):
    catalog = {"gl_transactions": {"format": "parquet", "path": f"{sf_dir}/orders.parquet"}}
    return load_table(spark, "gl_transactions", catalog)


@query("load_counters")
def counter_readings(spark, sf_dir):
    return load_counter_readings(view(spark, sf_dir, views.COUNTERS), "view", "HISTORY")


@query("head_rows")
def head_of_transactions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return head_rows(rows, 100, ["l_orderkey", "l_linenumber", *[c for c in rows.columns if c not in (
        "l_orderkey", "l_linenumber")]])


@query("financials_csv")
def financials_from_csv(spark, sf_dir):
    """The financials written as CSV and read back with their schema."""
    rows = view(spark, sf_dir, views.FINANCIALS)
    place = write_results({"financials": rows}, scratch_path(spark, "csv"), "csv")["financials"]
    return load_financials_csv(spark, place)


@query("serial_numbers")
def serial_numbers(spark, sf_dir):
    rows = _landscape(spark, sf_dir).select("unit_serial_raw", "engine_serial_raw").distinct()
    return rows.select(
        "unit_serial_raw",
        "engine_serial_raw",
        normalize_serial("unit_serial_raw").alias("usn"),
        normalize_serial("engine_serial_raw").alias("esn"),
        strip_literals("unit_serial_raw", ["GEJ-", "JEN-"]).alias("usn_stripped"),
        lacks_marker("unit_serial_raw", "Dummy").alias("real_unit"),
    )


@query("epoch_times")
def epoch_times(spark, sf_dir):
    rows = view(spark, sf_dir, views.MAINTENANCE)
    return rows.select(
        "event_id",
        from_epoch_millis("engine_ready_ms").alias("ready_ms"),
        from_epoch_millis_whole_seconds("engine_ready_ms").alias("ready_s"),
    )


@query("search_columns")
def column_search(spark, sf_dir):
    return search_columns(table(spark, sf_dir, "documents"), "and")


@query("matching_rows")
def rows_with_text(spark, sf_dir):
    return matching_rows(table(spark, sf_dir, "part"), "ring|promo")


@query("first_keyword")
def keyword_columns(spark, sf_dir):
    return first_keyword(table(spark, sf_dir, "part"), "p_name", KEYWORDS)


@query("first_keyword_table")
def keyword_columns_from_table(spark, sf_dir):
    """``first_keyword`` with the same lists given as a table (name, keyword, priority = place in the list)."""
    rows = [(name, word, i) for name, words in KEYWORDS.items() for i, word in enumerate(words)]
    lists = spark.createDataFrame(rows, "name string, keyword string, priority int")
    return first_keyword_table(table(spark, sf_dir, "part"), "p_name", lists, list(KEYWORDS))


@query("any_term")
def any_term_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.where(
        any_term("p_name", ["RING", "bolt"], "lower") | any_term("p_type", ["promo"], "upper")
    ).select("p_partkey", "p_name", "p_type")


@query("text_class")
def text_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    test = text_class("text", ["AND ", "THE "], ["THERE", "ANDS"])
    return rows.select("doc_id", test.alias("in_class"))


# --- joins and sets ---------------------------------------------------------------------------


@query("left_join")
def null_safe_left_join(spark, sf_dir):
    """Yearly operating rows with the costs of their asset; a missing asset meets a missing asset."""
    rows = view(spark, sf_dir, views.OPERATING).select("asset_id", "year", "month", "actual_hours")
    costs = view(spark, sf_dir, views.ASSET_COSTS_YEAR)
    return _rounded(left_join(rows, costs, ["asset_id", "year"]), 2, "amount_eur")


@query("semi_join")
def units_in_set(spark, sf_dir):
    rows = _landscape(spark, sf_dir)
    exempt = rows.where(EXEMPT.condition())
    return semi(rows, exempt, "unit_serial").select("contract_number", "unit_serial", "commissioning")


@query("anti_join")
def units_not_in_set(spark, sf_dir):
    rows = _landscape(spark, sf_dir)
    exempt = rows.where(EXEMPT.condition())
    return anti(rows, exempt, "unit_serial").select("contract_number", "unit_serial", "commissioning")


@query("union_history")
def history_union(spark, sf_dir):
    """Daily order counts: the later half as current rows, all days but one as history."""
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("kpi"))
        .agg(F.count("*").alias("value"))
    )
    current = daily.where(F.col("day") >= F.lit(dt.date(1998, 1, 1)))
    history = daily.where(F.col("day") < F.lit(dt.date(1999, 1, 1))).select(
        "day", "kpi", (-F.col("value")).alias("value"), F.lit("old").alias("note")
    )
    return union_history(current, history, ["day", "kpi"])


@query("snapshot_roundtrip")
def snapshot_history(spark, sf_dir):
    """Three snapshots, the last one written twice; the rows of the newest."""
    path = scratch_path(spark, "snapshots")
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("kpi"))
        .agg(F.count("*").alias("value"))
    )
    spans = [
        (dt.date(1900, 1, 1), dt.date(1997, 1, 1)),
        (dt.date(1996, 6, 1), dt.date(1999, 1, 1)),
        (dt.date(1998, 6, 1), dt.date(2100, 1, 1)),
        (dt.date(1998, 6, 1), dt.date(2100, 1, 1)),
    ]
    for start, end in spans:
        rows = daily.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
        newest = append_snapshot(rows, path, end, ["day", "kpi"])
    return newest


@query("distinct_count")
def distinct_counts(spark, sf_dir):
    rows = _landscape(spark, sf_dir)
    return rows.groupBy("contract_type").agg(
        distinct_count("unit_serial").alias("with_null"),
        distinct_count("unit_serial", count_null=False).alias("without_null"),
    )


@query("count_by")
def grouped_counts(spark, sf_dir):
    return count_by(_landscape(spark, sf_dir), ["contract_type", "unit_serial"], "commissioning", "n")


@query("range_profile")
def hours_range(spark, sf_dir):
    rows = view(spark, sf_dir, views.OPERATING)
    return range_profile(rows, ["gas_type_formatted"], "actual_hours", F.col("start_year") == 1996)


@query("top_values")
def top_end_hours(spark, sf_dir):
    return top_values(view(spark, sf_dir, views.OPERATING), "end_hours", 25)


@query("keep_top_values")
def rows_of_top_values(spark, sf_dir):
    rows = keep_top_values(view(spark, sf_dir, views.OPERATING), "end_hours", 25)
    return rows.groupBy("engine_type", "end_hours").agg(F.count("*").alias("n"))


# --- counters and costs -----------------------------------------------------------------------


@query("counter_bounds_by_day")
def counter_bounds_by_day(spark, sf_dir):
    return counter_period_bounds(view(spark, sf_dir, views.COUNTERS), "day")


@query("counter_bounds_one")
def counter_bounds_by_month(spark, sf_dir):
    return counter_period_bounds(view(spark, sf_dir, views.COUNTERS), "month")


@query("counter_bounds_epoch")
def counter_bounds_from_millis(spark, sf_dir):
    return counter_period_bounds(view(spark, sf_dir, views.COUNTERS_IN_MILLIS), "month", "ts_ms")


@query("counter_bounds_all")
def counter_bounds_with_ties(spark, sf_dir):
    return counter_bound_readings(view(spark, sf_dir, views.COUNTERS), "day")


@query("case_timeline")
def case_timeline(spark, sf_dir):
    return case_event_timeline(
        view(spark, sf_dir, views.CASES),
        view(spark, sf_dir, views.SUBCASES),
        view(spark, sf_dir, views.MAINTENANCE),
        dt.date(1996, 1, 1),
        dt.date(1999, 12, 31),
        "HIGH",
        "Training Center",
    )


@query("cost_actuals")
def cost_actuals_by_request(spark, sf_dir):
    found = cost_actuals(
        view(spark, sf_dir, views.TRANSACTIONS), view(spark, sf_dir, views.ACCOUNTS), "98", "P1"
    )
    return _rounded(found, 2, "amt_eur_trx")


@query("cost_detail")
def cost_detail_head(spark, sf_dir):
    rows = view(spark, sf_dir, views.TRANSACTIONS)
    return cost_detail(rows, view(spark, sf_dir, views.ACCOUNTS), "98", "P1", 100, sorted(rows.columns))


def _financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_financials(view(spark, sf_dir, views.FINANCIALS))


@query("unit_financials")
def unit_financials_by_year(spark, sf_dir):
    return _rounded(_rounded(_financials(spark, sf_dir), 4, "cost", "billings", "ic_cost"), 6, "cm")


@query("enrich_with_margin")
def rows_with_margin(spark, sf_dir):
    found = enrich_with_margin(view(spark, sf_dir, views.MARGIN_BASE), _financials(spark, sf_dir))
    return _rounded(_rounded(found, 4, "cost", "billings", "ic_cost"), 6, "cm")


@query("margin_by_segment")
def margin_by_region_industry_gas(spark, sf_dir):
    base = view(spark, sf_dir, views.MARGIN_BASE)
    return _rounded(margin_by_segment(enrich_with_margin(base, _financials(spark, sf_dir))), 6, "cm")


def _features(spark: SparkSession, sf_dir: str, monthly: bool, **options) -> DataFrame:
    costs = views.ASSET_COSTS_MONTH if monthly else views.ASSET_COSTS_YEAR
    return cost_features_asset(
        view(spark, sf_dir, views.OPERATING), view(spark, sf_dir, costs), monthly, **options
    )


@query("cost_features_unit")
def cost_features_by_unit(spark, sf_dir):
    found = cost_features_unit(
        view(spark, sf_dir, views.OPERATING), view(spark, sf_dir, views.UNIT_COSTS), BASE_DATE, year=1998
    )
    return _rounded(found, 2, "amount_eur")


@query("cost_features_asset")
def cost_features_by_asset_year(spark, sf_dir):
    found = _features(spark, sf_dir, monthly=False)
    return _rounded(_rounded(found, 2, "amount_eur"), 6, "average_actual_hours")


@query("cost_features_month")
def cost_features_by_asset_month(spark, sf_dir):
    found = _features(spark, sf_dir, monthly=True)
    return _rounded(_rounded(found, 2, "amount_eur"), 6, "average_actual_hours")


@query("cost_features_to_month_end")
def cost_features_to_month_end(spark, sf_dir):
    found = _features(spark, sf_dir, monthly=True, period_end="month")
    return _rounded(_rounded(found, 2, "amount_eur"), 6, "average_actual_hours")


# --- reshaping --------------------------------------------------------------------------------

FLAGS, LINES = ["A", "N", "R"], ["F", "O"]


@query("comparison_matrix")
def matrix_of_means(spark, sf_dir):
    # Whole quantities: their sums are exact, so the means need no rounding to compare.
    rows = table(spark, sf_dir, "lineitem")
    return comparison_matrix(rows, "l_quantity", "l_suppkey", "l_returnflag", "mean", FLAGS)


@query("matrix_median")
def matrix_of_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = comparison_matrix(rows, "l_extendedprice", "l_linestatus", "l_returnflag", "median", FLAGS)
    return _rounded(found, 4, *[f"l_returnflag_{f}" for f in FLAGS])


@query("matrix_nunique")
def matrix_of_distinct_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return comparison_matrix(rows, "l_partkey", "l_linenumber", "l_returnflag", "nunique", FLAGS)


@query("matrix_first")
def matrix_of_first_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return comparison_matrix(rows, "l_quantity", "l_suppkey", "l_returnflag", "first", FLAGS, order)


def _matrix_of(operation, target, order=()):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem")
        return comparison_matrix(rows, target, "l_suppkey", "l_returnflag", operation, FLAGS, order)

    return run


for _operation in ("min", "max", "count"):
    query(f"matrix_{_operation}")(_matrix_of(_operation, "l_quantity"))
query("matrix_last")(_matrix_of("last", "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber"]))


@query("matrix_var")
def matrix_of_variances(spark, sf_dir):
    return _rounded(_matrix_of("var", "l_quantity")(spark, sf_dir), 5, *[f"l_returnflag_{f}" for f in FLAGS])


@query("matrix_of_types")
def matrices_by_boolean_and_number(spark, sf_dir):
    """Columns headed by values of other types; they are found in the data."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", (F.col("l_linenumber") > 3).alias("late"), (F.col("l_linenumber") / 4).alias("share")
    )
    return comparison_matrices(rows, "l_quantity", "l_suppkey", ["late", "share"], "count")


@query("comparison_matrices")
def matrices_of_sums(spark, sf_dir):
    """Two matrices in one pass; values are found in the data, one column can be null."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END").alias("flag"),
        F.col("l_linenumber").alias("line"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END").alias("quantity"),
    )
    return comparison_matrices(rows, "quantity", "l_suppkey", ["flag", "line"], "sum")


@query("matrices_std")
def matrices_of_deviations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = comparison_matrices(
        rows, "l_quantity", "l_suppkey", ["l_returnflag", "l_linestatus"], "std",
        {"l_returnflag": FLAGS, "l_linestatus": LINES},
    )
    return _rounded(found, 5, *[c for c in found.columns if c != "l_suppkey"])


@query("display_grids")
def prediction_grids(spark, sf_dir):
    """The grids of two variables under each other."""
    grids = display_grids(
        view(spark, sf_dir, views.PREDICTIONS),
        ["industry", "gas_type"],
        "region",
        ["amount", "n_orders"],
        {"industry": ["BUILDING", "MACHINERY"], "region": ["R0", "R1", "R2", "R3"]},
        headers=["BUILDINGF", "BUILDINGO", "MACHINERYF", "MACHINERYO"],
    )
    amount = grids["amount"].withColumn("variable", F.lit("amount"))
    orders = grids["n_orders"]
    orders = orders.select(
        "region", *[F.col(c).cast("double").alias(c) for c in orders.columns if c != "region"],
        F.lit("n_orders").alias("variable"),
    )
    return amount.unionByName(orders)


@query("unpivot_metrics")
def long_form(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount",
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END").alias("l_tax"),
    )
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    return unpivot_metrics(rows, ids, ["l_quantity", "l_discount", "l_tax"])


@query("one_hot")
def indicator_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", F.expr("CASE WHEN p_size > 20 THEN NULL ELSE p_size % 3 END").alias("size_class")
    )
    return one_hot(rows, ["p_type", "size_class"])


@query("explode_combinations")
def list_combinations(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.split("p_name", " ").alias("word"), F.array("p_brand", "p_type").alias("attribute")
    )
    return explode_combinations(rows, ["word", "attribute"])


def _flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("gas"), F.col("l_linestatus").alias("line"), "l_quantity", "l_linenumber"
    )
    return one_hot(rows, ["gas", "line"], {"gas": FLAGS, "line": LINES})


@query("interaction_terms")
def interaction_sums(spark, sf_dir):
    """Column sums of the products of two indicator groups."""
    wide = interaction_terms(_flagged_lines(spark, sf_dir), ["gas_", "line_"])
    products = [c for c in wide.columns if c.startswith("dummies_const")]
    return wide.agg(*[F.sum(c).alias(c) for c in products])


# --- models -----------------------------------------------------------------------------------


def _line_design(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "flag", F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END")
    )
    # Whole numbers only: every cell is an exact sum, whatever the order of the rows.
    return build_design(rows, ["flag", "l_linestatus"], ["l_quantity"], "l_linenumber")


@query("gram_stats")
def gram_cells(spark, sf_dir):
    return gram_stats(_line_design(spark, sf_dir))


@query("gram_stats_wide")
def gram_cells_of_wide_design(spark, sf_dir):
    return gram_stats_wide(_flagged_lines(spark, sf_dir), ["gas_A", "gas_N", "l_quantity"], "l_linenumber")


def _fit_rows(fit: FitResult, digits: int = 4) -> DataFrame:
    rows = fit.coefs.select("term", "coef", "std_err", "t")
    return _rounded(rows, digits, "coef", "std_err", "t").withColumn("n", F.lit(fit.n).cast("bigint"))


@query("ols_factor")
def ols_one_factor(spark, sf_dir):
    design = build_design(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [], "l_extendedprice")
    return _fit_rows(ols(design), 3)


@query("ols_cg_customers")
def ols_cg_by_customer(spark, sf_dir):
    """Order value on one indicator a customer (thousands of terms at sf0.1, past what a Gram matrix fit takes) by CGLS."""
    fit = ols_cg(build_design(table(spark, sf_dir, "orders"), ["o_custkey"], [], "o_totalprice"), tol=1e-14, max_iter=400)
    return _rounded(fit.coefs.select("term", "coef"), 0, "coef").withColumn("n", F.lit(fit.n).cast("bigint"))


@query("ols_predict")
def ols_line_predictions(spark, sf_dir):
    """Fitted quantity of every line from its return flag and discount: a fit, then ``predict`` on the whole table."""
    lines = table(spark, sf_dir, "lineitem")
    fit = ols(build_design(lines, ["l_returnflag"], ["l_discount"], "l_quantity"))
    found = predict(fit, lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount"), ["l_returnflag"], ["l_discount"])
    return _rounded(found.select("l_orderkey", "l_linenumber", "prediction"), 3, "prediction")


@query("ols_simple")
def ols_one_number(spark, sf_dir):
    fit = ols(build_design(table(spark, sf_dir, "lineitem"), [], ["l_quantity"], "l_extendedprice"))
    return _rounded(fit.coefs.select("term", "coef"), 4, "coef").withColumn("r2", F.round(F.lit(fit.r2), 8))


@query("ols_wide")
def ols_wide_number(spark, sf_dir):
    fit = ols_wide(table(spark, sf_dir, "lineitem"), ["l_discount"], "l_extendedprice")
    return _rounded(fit.coefs.select("term", "coef"), 4, "coef").withColumn("r2", F.round(F.lit(fit.r2), 8))


@query("ridge_simple")
def ridge_one_number(spark, sf_dir):
    fit = ridge(build_design(table(spark, sf_dir, "lineitem"), [], ["l_discount"], "l_extendedprice"))
    return _rounded(fit.coefs.select("term", "coef"), 4, "coef").withColumn("r2", F.round(F.lit(fit.r2), 8))


@query("probit_fit")
def probit_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    design = build_design(rows, ["lang"], ["toxic"], "quality")
    return _rounded(probit(design).coefs.select("term", "coef"), 4, "coef")


@query("probit_probabilities")
def probit_probabilities(spark, sf_dir):
    """With one factor the fitted probability of a level is the share of the target in it."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.withColumn("lang", F.expr("CASE WHEN lang <> 'es' THEN lang END"))
    coefs = {r.term: r.coef for r in probit(build_design(rows, ["lang"], [], "quality")).coefs.collect()}
    base = coefs.pop("const")
    levels = [(None, base), *[(term.removeprefix("lang_"), base + coef) for term, coef in coefs.items()]]
    fitted = [(level, NormalDist().cdf(value)) for level, value in levels]
    return _rounded(spark.createDataFrame(fitted, "lang string, probability double"), 5, "probability")


@query("cost_model_scores")
def cost_model_scores(spark, sf_dir):
    """The feature rows scored by the coefficients: per level and number, the share of the target that the scores explain."""
    features = written_once(_features(spark, sf_dir, monthly=False), "features")
    fit = cost_model(features, ASSET_CATEGORIES, ASSET_NUMBERS, "amount_eur")
    rows = build_design(features, ASSET_CATEGORIES, ASSET_NUMBERS, "amount_eur").frame.fillna("none", list(ASSET_CATEGORIES))
    none = spark.createDataFrame([(f"{c}_none", 0.0) for c in ASSET_CATEGORIES], "term string, coef double")
    weights = {r.term: r.coef for r in fit.coefs.where(F.col("term").isin(*ASSET_NUMBERS)).collect()}
    scored = score_segments(fit.coefs.select("term", "coef").unionByName(none), rows, ASSET_CATEGORIES)
    score = sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.col("prediction"))
    terms = [F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("term"), F.lit(1.0).alias("x")) for c in ASSET_CATEGORIES]
    terms += [F.struct(F.lit(c).alias("term"), F.col(c).alias("x")) for c in ASSET_NUMBERS]
    long = scored.select("amount_eur", score.alias("score"), F.inline(F.array(*terms)))
    found = long.groupBy("term").agg(
        F.count("*").alias("n"), F.round(F.sum(F.expr("x * score")) / F.sum(F.expr("x * amount_eur")), 5).alias("explained")
    )
    return found.where(~F.col("term").endswith("_none"))


@query("cost_model_coefficients")
def cost_model_coefficients(spark, sf_dir):
    features = _features(spark, sf_dir, monthly=False)
    fit = cost_model(features, ASSET_CATEGORIES, ASSET_NUMBERS, "amount_eur")
    return _rounded(fit.coefs, 4, "coef", "std_err", "t")


def _fitted_totals(features: DataFrame, categories, numbers, target: str) -> DataFrame:
    """Per level: the sum of the target, and the share of it that the fitted values add up to.

    Least squares with a term for every level leaves no residual sum on any of them, so the share
    is one wherever the fit is right.
    """
    design = profiled(build_design(features, categories, numbers, target))
    cells = written_once(gram_stats(design), "gram")
    coefs = ols(design).coefs.select(F.col("term").alias("col_term"), "coef")
    swapped = cells.where("row_term <> col_term").select(
        F.col("col_term").alias("row_term"), F.col("row_term").alias("col_term"), "value"
    )
    full = cells.unionByName(swapped).where(~F.col("row_term").isin([target, *numbers]))
    fitted = full.join(coefs, "col_term").groupBy("row_term").agg(F.sum(F.expr("value * coef")).alias("fitted"))
    totals = full.where(F.col("col_term") == target).select("row_term", F.col("value").alias("target_total"))
    return left_join(totals, fitted, ["row_term"], null_safe=False).select(
        F.col("row_term").alias("term"),
        F.round("target_total", 2).alias("target_total"),
        F.round(F.expr("fitted / target_total"), 5).alias("explained"),
    )


@query("cost_model_asset")
def cost_model_by_asset(spark, sf_dir):
    return _fitted_totals(_features(spark, sf_dir, monthly=False), ASSET_CATEGORIES, ASSET_NUMBERS, "amount_eur")


@query("cost_model_month")
def cost_model_by_month(spark, sf_dir):
    return _fitted_totals(_features(spark, sf_dir, monthly=True), MONTH_CATEGORIES, ASSET_NUMBERS, "amount_eur")


@query("cost_model_unit")
def cost_model_by_unit(spark, sf_dir):
    features = cost_features_unit(
        view(spark, sf_dir, views.OPERATING), view(spark, sf_dir, views.UNIT_COSTS), BASE_DATE, year=1998
    )
    return _fitted_totals(features, UNIT_CATEGORIES, UNIT_NUMBERS, "amount_eur")


def _mean_prices(rows: DataFrame, subsets: list[list[str]]) -> DataFrame:
    """Stand-in coefficients: the mean price of every value combination of the subsets, in one pass."""
    out = [F.grouping(d).alias(f"out_{d}") for d in DIMS]
    return rows.groupingSets(subsets, *DIMS).agg(F.round(F.avg("price"), 2).alias("coef"), *out)


def _level_coefs(rows: DataFrame) -> DataFrame:
    """The mean price of each level, and the mean of all as the constant."""
    level = [F.when(F.col(f"out_{d}") == 0, F.concat(F.lit(f"{d}_"), F.col(d))) for d in DIMS]
    prices = _mean_prices(rows, [[], *[[d] for d in DIMS]])
    return written_once(prices.select(F.coalesce(*level, F.lit("const")).alias("term"), "coef"), "levels")


@query("score_segments")
def segment_scores(spark, sf_dir):
    rows = view(spark, sf_dir, views.SEGMENT_ROWS)
    # No level of industry I1 is known to the model.
    coefs = _level_coefs(rows).where("term <> 'industry_I1'")
    scored = score_segments(coefs, rows.select(*DIMS).distinct(), DIMS)
    return _rounded(scored, 2, "prediction")


@query("segment_effects")
def effects_by_segment(spark, sf_dir):
    """Three-way interaction columns of every row, with the mean price of a cell as coefficient."""
    rows = view(spark, sf_dir, views.SEGMENT_ROWS)
    copies = rows.select(*DIMS, *[F.col(d).alias(f"{d}_level") for d in DIMS])
    levels = {"region_level": LINES, "gas_level": FLAGS, "industry_level": ["I0", "I1", "I2"]}
    pairs = interaction_terms(one_hot(copies, list(levels), levels), ["region_", "gas_"])
    cubes = interaction_terms(pairs, ["dummies_const", "industry_level_"])
    terms = [c for c in cubes.columns if c.count("dummies_const") == 2]
    name = F.format_string(
        "dummies_constindustry_level_%s_dummies_constgas_level_%s_region_level_%s", "industry", "gas", "region"
    )
    coefs = rows.groupBy(name.alias("term")).agg(F.round(F.avg("price"), 2).alias("coef"))
    return _rounded(segment_effects(cubes.select(*DIMS, *terms), coefs, DIMS, order=2), 2, "value")


@query("segment_effects_long")
def effects_by_segment_long(spark, sf_dir):
    """``segment_effects`` on sparse cells: each row's active levels crossed in arrays, one row a non-zero three-way cell."""
    rows = view(spark, sf_dir, views.SEGMENT_ROWS)
    copies = rows.select(*DIMS, *[F.col(d).alias(f"{d}_level") for d in DIMS])
    levels = {"region_level": LINES, "gas_level": FLAGS, "industry_level": ["I0", "I1", "I2"]}
    flags = one_hot(copies, list(levels), levels)
    region, gas, industry = (active_cells([c for c in flags.columns if c.startswith(p)]) for p in ("region_", "gas_", "industry_level_"))
    cubes = cross_cells(cross_cells(region, gas), industry)
    cells = flags.select(*DIMS, F.inline_outer(cubes))
    name = F.format_string(
        "dummies_constindustry_level_%s_dummies_constgas_level_%s_region_level_%s", "industry", "gas", "region"
    )
    coefs = rows.groupBy(name.alias("term")).agg(F.round(F.avg("price"), 2).alias("coef"))
    return _rounded(segment_effects(cells, coefs, DIMS, order=2, long=True), 2, "value")


@query("interaction_terms_long")
def interaction_sums_long(spark, sf_dir):
    """Sums of the products of two indicator groups from the sparse form: one row a term that occurs."""
    cells = interaction_terms(_flagged_lines(spark, sf_dir), ["gas_", "line_"], long=True)
    return cells.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("value").cast("bigint").alias("total"))


def _lattice_coefs(rows: DataFrame) -> DataFrame:
    """Coefficients of the flag term and of its interactions with every subset of the dimensions."""
    subsets = [list(s) for size in range(len(DIMS) + 1) for s in combinations(DIMS, size)]
    parts = [
        F.when(F.col(f"out_{d}") == 0, F.concat(F.lit(f"dummies_const{d}_"), F.col(d), F.lit("_"))) for d in DIMS
    ]
    term = F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit("minimumoperatinghours"))
    return _mean_prices(rows, subsets).select(term.alias("term"), "coef")


@query("lattice_effects")
def lattice_effects_by_segment(spark, sf_dir):
    rows = view(spark, sf_dir, views.SEGMENT_ROWS)
    found = lattice_effects(_lattice_coefs(rows), rows, DIMS, prefixes={"gas": "_"})
    return _rounded(found, 2, "effect")


@query("sum_or_zero")
def sums_by_unit(spark, sf_dir):
    """Grouped sum with null keys left out; a group of nulls adds up to zero."""
    rows = view(spark, sf_dir, views.FINANCIALS).dropna(subset=["unit_serial"])
    value = F.expr("CASE WHEN unit_period < DATE '2001-01-01' THEN NULL ELSE cost END")
    return _rounded(rows.groupBy("unit_serial").agg(sum_or_zero(value).alias("cost")), 4, "cost")
