"""The same results as plain SQL for DuckDB, written directly from the definitions.

Where a plan takes a shortcut (one pass for all dates, grouping sets, Gram matrices), the SQL here
takes the long way: one count per date, one aggregate per cell, closed forms for the models.
"""

from __future__ import annotations

from fleetledger.checks import standins as views
from fleetledger.checks.standins import sql_view

ORACLE: dict[str, str] = {}


def _with(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql_view(text)})" for name, text in ctes.items())


# --- funnel and fleet -------------------------------------------------------------------------

_EXEMPT_TEXT = "customer:|#000000001|contract:|small ring|country:|atlantis"
_CONTRACT = "contract status ACTIVE"
_UNIT = f"{_CONTRACT} & unit status ACTIVE"
_IB = f"{_UNIT} & installed-base status in Active|Standby|Active Docu incomplete"

_STAGE_TESTS = {
    "contract_active": ("TRUE", _CONTRACT),
    "unit_active": ("ua", _UNIT),
    "ib_active": ("ua AND ib", _IB),
    "unit_level": ("ua AND ib AND NOT ex", f"{_IB} & not {_EXEMPT_TEXT}"),
    "not_unit_level": ("ua AND ib AND ex", f"{_IB} & {_EXEMPT_TEXT}"),
}

_FLAGS = f"""
{_with(landscape=views.LANDSCAPE)},
exempt AS (
  SELECT DISTINCT unit_serial FROM landscape
  WHERE contains(upper(customer_name), '#000000001') OR contains(lower(contract_name), 'small ring')
     OR contains(lower(country), 'atlantis')
),
flags AS (
  SELECT l.*, unit_status = 'ACTIVE' AS ua, ib_status IN ('Active', 'Standby', 'Active Docu incomplete') AS ib,
         EXISTS (SELECT 1 FROM exempt e WHERE e.unit_serial IS NOT DISTINCT FROM l.unit_serial) AS ex
  FROM landscape l
)"""


def _stage_union(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, * FROM {source} WHERE contract_status = 'ACTIVE' AND {test}"
        for stage, (test, _) in _STAGE_TESTS.items()
    )


def _funnel(dates: str, categorised: str) -> str:
    grid_stages = ", ".join(f"('{s}', '{text}')" for s, (_, text) in _STAGE_TESTS.items())
    return f"""
{_FLAGS},
categorised AS ({categorised}),
stages AS ({_stage_union('categorised')}),
keyed AS (
  SELECT stage, category, commissioning, 'unit_serial' AS kpi, unit_serial AS entity FROM stages
  UNION ALL
  SELECT stage, category, commissioning, 'contract_number', contract_number FROM stages
),
dates AS ({dates}),
counts AS (
  SELECT stage, category, kpi, ts,
         count(DISTINCT entity) + max(CASE WHEN entity IS NULL THEN 1 ELSE 0 END) AS n
  FROM keyed JOIN dates ON commissioning <= ts
  GROUP BY stage, category, kpi, ts
)
SELECT g.stage AS "filter", CAST(coalesce(n, 0) AS BIGINT) AS "value", d.ts AS "timestamp",
       g.criteria AS operationalization, c.category, k.kpi
FROM (VALUES {grid_stages}) g(stage, criteria), dates d,
     (SELECT DISTINCT label AS category FROM labels) c, (VALUES ('unit_serial'), ('contract_number')) k(kpi)
LEFT JOIN counts ON counts.stage = g.stage AND counts.category = c.category AND counts.kpi = k.kpi
     AND counts.ts = d.ts
"""


def _months(base: str, n: int) -> str:
    return f"SELECT CAST(DATE '{base}' - to_months(CAST(i AS INTEGER)) AS DATE) AS ts FROM range(1, {n + 1}) t(i)"


_LABELS = "labels AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(label))"
_ONE_TYPE = "SELECT contract_type AS category, * FROM flags JOIN labels ON label = contract_type"


def _with_labels(sql: str, labels: str) -> str:
    return sql.replace("categorised AS (", f"{labels}, categorised AS (", 1)


ORACLE["contract_funnel"] = _with_labels(_funnel(_months("2001-11-01", 24), _ONE_TYPE), _LABELS)
ORACLE["contract_funnel_grouped_types"] = _with_labels(
    _funnel(
        _months("2001-11-01", 6),
        "SELECT label AS category, flags.* FROM flags JOIN labels ON member = contract_type "
        "WHERE contract_type2 IN ('BUILDING', 'MACHINERY')",
    ),
    "labels AS (SELECT * FROM (VALUES ('1-URGENT', '1-URGENT'), ('1-URGENT', '2-HIGH'), ('2-HIGH', '2-HIGH')) "
    "v(label, member))",
)
ORACLE["kpi_run"] = _with_labels(_funnel(_months("2001-11-01", 25), _ONE_TYPE), _LABELS)

ORACLE["funnel_members"] = f"""
{_FLAGS},
due AS (
  SELECT * FROM flags WHERE commissioning <= DATE '2000-06-30'
  AND contract_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
),
stages AS ({_stage_union('due')})
SELECT DISTINCT stage AS "filter", contract_type AS category, 'unit_serial' AS kpi, unit_serial AS entity FROM stages
UNION ALL
SELECT DISTINCT stage, contract_type, 'contract_number', contract_number FROM stages
"""


def _fleet_status() -> str:
    rules = {
        "active_contracts": ("contract_number", "TRUE"),
        "active_units": ("unit_serial", "ua"),
        "active_units_not_unit_level": ("unit_serial", "ua AND ex"),
        "active_units_commissioned": ("unit_serial", "ua AND ib"),
    }
    labels = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}
    parts = []
    for kpi, (key, test) in rules.items():
        columns = [
            f"count(DISTINCT {key}) FILTER (WHERE contract_type = '{t}') AS {name}" for name, t in labels.items()
        ]
        total = f"count(DISTINCT {key}) + coalesce(max(CASE WHEN {key} IS NULL THEN 1 ELSE 0 END), 0) AS total"
        parts.append(
            f"SELECT {', '.join(columns)}, {total}, '{kpi}' AS kpi, DATE '2001-10-01' AS \"timestamp\" "
            f"FROM due WHERE {test}"
        )
    return f"""
{_FLAGS},
due AS (
  SELECT * FROM flags WHERE commissioning <= DATE '2001-10-01' AND contract_status = 'ACTIVE'
  AND contract_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
)
{' UNION ALL '.join(parts)}
"""


ORACLE["fleet_status"] = _fleet_status()

ORACLE["kpi_metadata"] = f"""
SELECT kpi, "timestamp", total, operationalization FROM ({ORACLE["fleet_status"]}) JOIN (VALUES
  ('active_contracts', 'contract status:|ACTIVE'),
  ('active_units', 'contract status:, unit status:|ACTIVE|ACTIVE'),
  ('active_units_not_unit_level', 'contract status:, unit status:, unit in exempt group:|ACTIVE|ACTIVE|#000000001|small ring|atlantis'),
  ('active_units_commissioned', 'contract status:, unit status:, installed-base status:|ACTIVE|ACTIVE|Active|Standby')
) criteria(kpi, operationalization) USING (kpi)
"""

# --- contracts --------------------------------------------------------------------------------


def _serial(column: str) -> str:
    return (
        f"CASE WHEN contains({column}, '_') THEN {column} "
        f"ELSE nullif(regexp_replace({column}, '[^0-9]', '', 'g'), '') END"
    )


_SHORT_NUMBER = "regexp_replace(contract_number, '(_EXP[1-6]|_EXP|_REP|_OLD)', '', 'g')"

ORACLE["active_contracts"] = f"""
{_with(landscape=views.LANDSCAPE)}
SELECT DISTINCT contract_number, quote_number, contract_type AS oracle_contract_type, contract_type2,
       contract_status, contract_name, customer_name, country, unit_status AS oracle_unit_status, ib_status,
       unit_serial_raw AS usn_unformatted, unit_serial, engine_serial_raw AS esn_unformatted, eot_date,
       commissioning, {_serial('unit_serial_raw')} AS usn, {_serial('engine_serial_raw')} AS esn
FROM landscape
WHERE contract_status = 'ACTIVE' AND NOT coalesce(contains(unit_serial_raw, 'Dummy'), FALSE)
"""

_EXTRACT = f"""
SELECT {_SHORT_NUMBER} AS oracle_contract_number, quote_number, contract_type,
       contract_status AS oracle_contract_type, customer_name, unit_status AS oracle_unit_status,
       unit_serial_raw, engine_serial_raw, eot_date
FROM landscape
"""
ORACLE["clean_landscape"] = f"{_with(landscape=views.LANDSCAPE)} {_EXTRACT}"

_STRIPPED = "replace(replace({0}, 'GEJ-', ''), 'JEN-', '')"
ORACLE["contract_profile"] = f"""
{_with(landscape=views.LANDSCAPE)},
extract AS ({_EXTRACT}),
active AS (
  SELECT * REPLACE ({_STRIPPED.format('unit_serial_raw')} AS unit_serial_raw,
                    {_STRIPPED.format('engine_serial_raw')} AS engine_serial_raw)
  FROM extract WHERE oracle_contract_type = 'ACTIVE'
),
contracts AS (
  SELECT * FROM active QUALIFY row_number() OVER (
    PARTITION BY oracle_contract_number
    ORDER BY quote_number NULLS FIRST, contract_type NULLS FIRST, oracle_contract_type, customer_name NULLS FIRST,
             oracle_unit_status NULLS FIRST, unit_serial_raw NULLS FIRST, engine_serial_raw NULLS FIRST,
             eot_date NULLS FIRST) = 1
),
selected AS (
  SELECT * FROM contracts WHERE contains(contract_type, 'URGENT') OR contains(contract_type, 'HIGH')
)
SELECT 'totals' AS part, NULL::VARCHAR AS contract_type, NULL::VARCHAR AS unit_status,
       count(DISTINCT oracle_contract_number) AS n_contracts, count(DISTINCT unit_serial_raw) AS n_units
FROM contracts
UNION ALL
SELECT 'by_type_and_status', contract_type, oracle_unit_status, count(*), count(DISTINCT unit_serial_raw)
FROM contracts GROUP BY contract_type, oracle_unit_status
UNION ALL
SELECT 'selected_by_type', contract_type, NULL, count(*), count(DISTINCT unit_serial_raw)
FROM selected GROUP BY contract_type
UNION ALL
SELECT 'selected_totals', NULL, NULL, count(DISTINCT oracle_contract_number), count(DISTINCT unit_serial_raw)
FROM selected
"""

# --- scans, text, filters ---------------------------------------------------------------------

ORACLE["full_scan"] = "SELECT * FROM orders"
ORACLE["load_counters"] = f"""
{_with(counters=views.COUNTERS)}
SELECT * FROM counters WHERE counter_type = 'view' AND source = 'HISTORY'
"""
ORACLE["head_rows"] = """
SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate
LIMIT 100
"""
ORACLE["financials_csv"] = sql_view(views.FINANCIALS)
ORACLE["serial_numbers"] = f"""
{_with(landscape=views.LANDSCAPE)}
SELECT DISTINCT unit_serial_raw, engine_serial_raw, {_serial('unit_serial_raw')} AS usn,
       {_serial('engine_serial_raw')} AS esn, {_STRIPPED.format('unit_serial_raw')} AS usn_stripped,
       NOT coalesce(contains(unit_serial_raw, 'Dummy'), FALSE) AS real_unit
FROM landscape
"""
ORACLE["epoch_times"] = f"""
{_with(maintenance=views.MAINTENANCE)}
SELECT event_id, make_timestamp(engine_ready_ms * 1000) AS ready_ms,
       make_timestamp(engine_ready_ms // 1000 * 1000000) AS ready_s
FROM maintenance
"""


def _column_search(columns: list[str], table: str, pattern: str) -> str:
    test = "count(*) FILTER (WHERE regexp_matches(CAST({0} AS VARCHAR), '{1}', 'i'))"
    parts = [f"SELECT '{c}' AS column_name, {test.format(c, pattern)} AS n_matches FROM {table}" for c in columns]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_matches > 0"


ORACLE["search_columns"] = _column_search(["doc_id", "text", "lang", "source", "n_chars"], "documents", "and")
ORACLE["matching_rows"] = """
SELECT * FROM part WHERE regexp_matches(p_name, 'ring|promo', 'i') OR regexp_matches(p_type, 'ring|promo', 'i')
   OR regexp_matches(p_brand, 'ring|promo', 'i')
"""
ORACLE["first_keyword"] = """
SELECT *,
  CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt'
       WHEN contains(p_name, 'widget') THEN 'widget' END AS shape,
  CASE WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'large') THEN 'large'
       WHEN contains(p_name, 'red') THEN 'red' END AS size_word
FROM part
"""
# The same lists as a table give the same columns.
ORACLE["first_keyword_table"] = ORACLE["first_keyword"]
ORACLE["any_term"] = """
SELECT p_partkey, p_name, p_type FROM part
WHERE regexp_matches(lower(p_name), 'ring|bolt') OR regexp_matches(upper(p_type), 'PROMO')
"""
ORACLE["text_class"] = """
SELECT doc_id, (contains(upper(text), 'AND ') OR contains(upper(text), 'THE '))
       AND NOT contains(upper(text), 'THERE') AND NOT contains(upper(text), 'ANDS') AS in_class
FROM documents
"""

# --- joins and sets ---------------------------------------------------------------------------

ORACLE["left_join"] = f"""
{_with(operating=views.OPERATING, costs=views.ASSET_COSTS_YEAR)}
SELECT o.asset_id, o.year, o.month, actual_hours, round(amount_eur, 2) AS amount_eur
FROM operating o LEFT JOIN costs c
  ON o.asset_id IS NOT DISTINCT FROM c.asset_id AND o.year IS NOT DISTINCT FROM c.year
"""
ORACLE["semi_join"] = f"{_FLAGS} SELECT contract_number, unit_serial, commissioning FROM flags WHERE ex"
ORACLE["anti_join"] = f"{_FLAGS} SELECT contract_number, unit_serial, commissioning FROM flags WHERE NOT ex"

_DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS kpi, count(*) AS "value" FROM orders
  GROUP BY CAST(o_orderdate AS DATE), o_orderstatus
)"""
ORACLE["union_history"] = f"""
WITH {_DAILY}
SELECT day, kpi, "value", NULL::VARCHAR AS note FROM daily WHERE day >= DATE '1998-01-01'
UNION ALL
SELECT day, kpi, -"value", 'old' FROM daily WHERE day < DATE '1998-01-01'
"""
ORACLE["snapshot_roundtrip"] = f"""
WITH {_DAILY}
SELECT * FROM daily
"""
ORACLE["distinct_count"] = f"""
{_with(landscape=views.LANDSCAPE)}
SELECT contract_type, count(DISTINCT unit_serial) + max(CASE WHEN unit_serial IS NULL THEN 1 ELSE 0 END)
         AS with_null,
       count(DISTINCT unit_serial) AS without_null
FROM landscape GROUP BY contract_type
"""
ORACLE["count_by"] = f"""
{_with(landscape=views.LANDSCAPE)}
SELECT contract_type, unit_serial, count(commissioning) AS n FROM landscape
WHERE contract_type IS NOT NULL AND unit_serial IS NOT NULL GROUP BY contract_type, unit_serial
"""
ORACLE["range_profile"] = f"""
{_with(operating=views.OPERATING)}
SELECT gas_type_formatted, min(actual_hours) AS min_actual_hours, max(actual_hours) AS max_actual_hours
FROM operating WHERE start_year = 1996 AND gas_type_formatted IS NOT NULL GROUP BY gas_type_formatted
"""
_TOP = """
top AS (
  SELECT end_hours, count(*) AS n_rows FROM operating WHERE end_hours IS NOT NULL GROUP BY end_hours
  ORDER BY n_rows DESC, end_hours LIMIT 25
)"""
ORACLE["top_values"] = f"{_with(operating=views.OPERATING)}, {_TOP} SELECT * FROM top"
ORACLE["keep_top_values"] = f"""
{_with(operating=views.OPERATING)}, {_TOP}
SELECT engine_type, end_hours, count(*) AS n FROM operating WHERE end_hours IN (SELECT end_hours FROM top)
GROUP BY engine_type, end_hours
"""

# --- counters and costs -----------------------------------------------------------------------


def _bounds(parts: list[str]) -> str:
    keys = ", ".join(["asset_id", *parts])
    cut = ", ".join(f"{p}(ts) AS {p}" for p in parts)
    return f"""
{_with(counters=views.COUNTERS)},
readings AS (SELECT asset_id, {cut}, ts, counter_value FROM counters),
span AS (SELECT {keys}, max(ts) AS max_timestamp, min(ts) AS min_timestamp FROM readings GROUP BY {keys})
SELECT {keys}, max_timestamp, min_timestamp,
  (SELECT min(counter_value) FROM readings r WHERE r.ts = s.min_timestamp AND r.asset_id = s.asset_id)
    AS counter_value_min,
  (SELECT max(counter_value) FROM readings r WHERE r.ts = s.max_timestamp AND r.asset_id = s.asset_id)
    AS counter_value_max
FROM span s
"""


ORACLE["counter_bounds_by_day"] = _bounds(["year", "month", "day"])
ORACLE["counter_bounds_one"] = _bounds(["year", "month"])
ORACLE["counter_bounds_epoch"] = f"""
{_with(counters=views.COUNTERS_IN_MILLIS)},
timed AS (SELECT *, make_timestamp(ts_ms * 1000) AS ts FROM counters)
SELECT asset_id, year(ts) AS year, month(ts) AS month, max(ts) AS max_timestamp, min(ts) AS min_timestamp,
       arg_min(counter_value, ts_ms) AS counter_value_min, arg_max(counter_value, ts_ms) AS counter_value_max
FROM timed GROUP BY asset_id, year(ts), month(ts)
"""
ORACLE["counter_bounds_all"] = f"""
{_with(counters=views.COUNTERS)},
readings AS (
  SELECT asset_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, ts, counter_value,
         min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts
  FROM counters WINDOW w AS (PARTITION BY asset_id, CAST(ts AS DATE))
)
SELECT asset_id, year, month, day, 'min' AS bound, ts, counter_value, count(*) AS n_readings
FROM readings WHERE ts = first_ts GROUP BY ALL
UNION ALL
SELECT asset_id, year, month, day, 'max', ts, counter_value, count(*)
FROM readings WHERE ts = last_ts GROUP BY ALL
"""
ORACLE["case_timeline"] = f"""
{_with(cases=views.CASES, subcases=views.SUBCASES, done=views.MAINTENANCE)}
SELECT site_name, site_customer, c.case_number, c.created AS case_created, incident, closed AS case_closed,
       event_link, subcase_id, s.created AS subcase_created, event_id, main_event_id,
       d.case_number AS event_case_number,
       make_timestamp(approval_ms // 1000 * 1000000) AS approval_date,
       make_timestamp(engine_ready_ms // 1000 * 1000000) AS engine_ready
FROM cases c LEFT JOIN subcases s ON c.case_id = s.main_case_id LEFT JOIN done d ON d.case_number = c.case_id
WHERE c.created >= '1996-01-01' AND c.created <= '1999-12-31' AND segment LIKE '%HIGH%'
  AND site_customer IS NOT NULL AND site_name <> 'Training Center'
ORDER BY c.created DESC
"""
ORACLE["cost_actuals"] = f"""
{_with(trx=views.TRANSACTIONS, coa=views.ACCOUNTS)}
SELECT service_request_number, sub_division, cost_category, project_code, fiscal_period, ledger, account_dd,
       hierarchy_1, hierarchy_2, hierarchy_3, alt_hierarchy, round(sum(amount_eur), 2) AS amt_eur_trx
FROM trx LEFT JOIN coa ON trx.account = coa.account
WHERE fiscal_period LIKE '%98' AND project_code LIKE 'P1' AND service_request_ref IS NOT NULL
  AND business_segment = 'Services' AND service_request_number NOT LIKE '' AND account_type LIKE 'Expense'
GROUP BY ALL
"""
_TRX_COLUMNS = (
    "account, account_dd, amount_eur, business_segment, cost_category, fiscal_period, ledger, line, order_key, "
    "part_key, project_code, service_request_number, service_request_ref, sub_division"
)
ORACLE["cost_detail"] = f"""
{_with(trx=views.TRANSACTIONS, coa=views.ACCOUNTS)}
SELECT trx.*, coa.account AS coa_account, hierarchy_1 AS coa_hierarchy_1, hierarchy_2 AS coa_hierarchy_2,
       hierarchy_3 AS coa_hierarchy_3, alt_hierarchy AS coa_alt_hierarchy, account_type AS coa_account_type
FROM trx LEFT JOIN coa ON trx.account = coa.account
WHERE fiscal_period LIKE '%98' AND project_code LIKE 'P1' AND service_request_number NOT LIKE ''
  AND account_type LIKE 'Expense'
ORDER BY {', '.join(f'trx.{c.strip()} NULLS FIRST' for c in _TRX_COLUMNS.split(','))} LIMIT 100
"""
_FINANCIALS = """
raw AS (
  SELECT unit_serial, contract_number, year(unit_period) AS billing_year, sum(cost) AS cost,
         sum(billings) AS billings, sum(ic_cost) AS ic_cost
  FROM financials
  WHERE (billings <> 0 OR billings IS NULL) AND unit_serial IS NOT NULL
  GROUP BY unit_serial, contract_number, year(unit_period)
),
fin AS (SELECT *, (billings - cost) / nullif(billings, 0) AS cm FROM raw)"""
_ROUNDED_FIN = "round(cost, 4) AS cost, round(billings, 4) AS billings, round(ic_cost, 4) AS ic_cost, round(cm, 6) AS cm"
ORACLE["unit_financials"] = f"""
{_with(financials=views.FINANCIALS)}, {_FINANCIALS}
SELECT unit_serial, contract_number, billing_year, {_ROUNDED_FIN} FROM fin
"""
_ENRICHED = """
base LEFT JOIN fin ON base.unit_serial IS NOT DISTINCT FROM fin.unit_serial
 AND base.contract_number IS NOT DISTINCT FROM fin.contract_number
 AND base.year IS NOT DISTINCT FROM fin.billing_year"""
ORACLE["enrich_with_margin"] = f"""
{_with(financials=views.FINANCIALS, base=views.MARGIN_BASE)}, {_FINANCIALS}
SELECT base.*, {_ROUNDED_FIN} FROM {_ENRICHED}
"""
ORACLE["margin_by_segment"] = f"""
{_with(financials=views.FINANCIALS, base=views.MARGIN_BASE)}, {_FINANCIALS}
SELECT service_region, industry, gas_type, round(avg(cm), 6) AS cm FROM {_ENRICHED}
WHERE gas_type IS NOT NULL GROUP BY service_region, industry, gas_type
"""

_HOURS = "CAST(CAST(start_hours AS BIGINT) AS VARCHAR) || CAST(CAST(end_hours AS BIGINT) AS VARCHAR) AS category"
ORACLE["cost_features_unit"] = f"""
{_with(operating=views.OPERATING, unit_costs=views.UNIT_COSTS)},
costs AS (
  SELECT unit_serial, sum(amount_eur) AS amount_eur FROM unit_costs
  WHERE cost_category = 'Unplanned' AND margin_class = 'Expense' AND unit_serial IS NOT NULL
  GROUP BY unit_serial
)
SELECT o.unit_serial, engine_type, gas_type, CAST(start_year AS VARCHAR) AS start_year, {_HOURS},
       CAST(year AS VARCHAR) AS year, date_diff('day', contract_start, DATE '2001-11-01') AS run_time,
       actual_hours, counter_value_max, round(amount_eur, 2) AS amount_eur
FROM operating o LEFT JOIN costs c ON o.unit_serial = c.unit_serial
WHERE c.unit_serial IS NOT NULL AND start_hours IS NOT NULL AND end_hours IS NOT NULL AND year = 1998
"""


def _asset_features(monthly: bool, end: str) -> str:
    costs = views.ASSET_COSTS_MONTH if monthly else views.ASSET_COSTS_YEAR
    month = "AND o.month = c.month" if monthly else ""
    month_text = "CAST(o.month AS VARCHAR) AS month," if monthly else ""
    return f"""
{_with(operating=views.OPERATING, costs=costs)}, {_TOP},
joined AS (
  SELECT o.*, c.amount_eur, date_diff('day', contract_start, CAST({end} AS DATE)) AS run_time
  FROM operating o LEFT JOIN costs c
    ON o.asset_id IS NOT DISTINCT FROM c.asset_id AND o.year = c.year {month}
  WHERE o.end_hours IN (SELECT end_hours FROM top) AND start_hours IS NOT NULL
)
SELECT round(counter_value_max / run_time * 365, 6) AS average_actual_hours, actual_hours, engine_type,
       engine_version, gas_type_formatted, industry, subregion, CAST(o.year AS VARCHAR) AS year, {month_text}
       CAST(start_year AS VARCHAR) AS start_year, {_HOURS}, round(amount_eur, 2) AS amount_eur
FROM joined o WHERE run_time > 0 AND amount_eur IS NOT NULL AND gas_type_formatted IS NOT NULL
"""


_YEAR_END = "make_date(o.year, 12, 31)"
ORACLE["cost_features_asset"] = _asset_features(False, _YEAR_END)
ORACLE["cost_features_month"] = _asset_features(True, _YEAR_END)
ORACLE["cost_features_to_month_end"] = _asset_features(True, "last_day(make_date(o.year, o.month, 1))")

# --- reshaping --------------------------------------------------------------------------------


def _cells(column: str, values: list, aggregate: str, prefix: str) -> str:
    """One filtered aggregate per cell; a cell without rows stays null."""
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {column} = {q}) > 0 THEN {aggregate.format(f'FILTER (WHERE {column} = {q})')} "
        f"END AS {prefix}_{v}"
        for q, v in zip(quoted, values)
    )


_FLAG_VALUES, _LINE_VALUES = ["A", "N", "R"], ["F", "O"]


def _matrix(y: str, aggregate: str) -> str:
    cells = _cells("l_returnflag", _FLAG_VALUES, aggregate, "l_returnflag")
    return f"SELECT {y}, {cells} FROM lineitem GROUP BY {y}"


ORACLE["comparison_matrix"] = _matrix("l_suppkey", "avg(l_quantity) {0}")
ORACLE["matrix_median"] = _matrix("l_linestatus", "round(median(l_extendedprice) {0}, 4)")
ORACLE["matrix_nunique"] = _matrix("l_linenumber", "count(DISTINCT l_partkey) {0}")
ORACLE["matrix_first"] = """
WITH ranked AS (
  SELECT l_suppkey, l_returnflag, l_quantity, row_number() OVER (
    PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) AS place
  FROM lineitem
)
SELECT l_suppkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS l_returnflag_A,
       max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS l_returnflag_N,
       max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS l_returnflag_R
FROM ranked WHERE place = 1 GROUP BY l_suppkey
"""
ORACLE["matrix_last"] = ORACLE["matrix_first"].replace(
    "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity",
    "ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC",
)
for _name in ("min", "max", "count"):
    ORACLE[f"matrix_{_name}"] = _matrix("l_suppkey", f"{_name}(l_quantity) {{0}}")
ORACLE["matrix_var"] = _matrix("l_suppkey", "round(var_samp(l_quantity) {0}, 5)")
_SHARES = ["0.25", "0.5", "0.75", "1", "1.25", "1.5", "1.75"]
ORACLE["matrix_of_types"] = f"""
SELECT l_suppkey, {", ".join(
    f'nullif(count(l_quantity) FILTER (WHERE (l_linenumber > 3) = {v}), 0) AS late_{v}' for v in ("false", "true")
)}, {", ".join(
    f'nullif(count(l_quantity) FILTER (WHERE l_linenumber / 4.0 = {v}), 0) AS "share_{v}"' for v in _SHARES
)}
FROM lineitem GROUP BY l_suppkey
"""
ORACLE["comparison_matrices"] = f"""
WITH rows_in AS (
  SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag, l_linenumber AS line,
         CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS quantity
  FROM lineitem
)
SELECT l_suppkey, {_cells('flag', _FLAG_VALUES, 'coalesce(sum(quantity) {0}, 0)', 'flag')},
       {_cells('line', [1, 2, 3, 4, 5, 6, 7], 'coalesce(sum(quantity) {0}, 0)', 'line')}
FROM rows_in GROUP BY l_suppkey
"""
ORACLE["matrices_std"] = f"""
SELECT l_suppkey, {_cells('l_returnflag', _FLAG_VALUES, 'round(stddev_samp(l_quantity) {0}, 5)', 'l_returnflag')},
       {_cells('l_linestatus', _LINE_VALUES, 'round(stddev_samp(l_quantity) {0}, 5)', 'l_linestatus')}
FROM lineitem GROUP BY l_suppkey
"""


def _grid(variable: str) -> str:
    cells = ", ".join(
        f"max(CAST({variable} AS DOUBLE)) FILTER (WHERE industry = '{i}' AND gas_type = '{g}') AS \"{i}{g}\""
        for i in ("BUILDING", "MACHINERY")
        for g in ("F", "O")
    )
    return (
        f"SELECT region, {cells}, '{variable}' AS variable FROM predictions "
        "WHERE industry IN ('BUILDING', 'MACHINERY') AND region IN ('R0', 'R1', 'R2', 'R3') GROUP BY region"
    )


ORACLE["display_grids"] = (
    f"{_with(predictions=views.PREDICTIONS)} {_grid('amount')} UNION ALL {_grid('n_orders')}"
)
ORACLE["unpivot_metrics"] = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, '{v}' AS variable, {x} AS \"value\" FROM lineitem"
    for v, x in {
        "l_quantity": "l_quantity",
        "l_discount": "l_discount",
        "l_tax": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END",
    }.items()
)


def _indicators(column: str, values: list, prefix: str) -> str:
    return ", ".join(
        f"CASE WHEN {column} = {repr(v)} THEN 1 ELSE 0 END AS \"{prefix}_{v}\"" for v in values
    )


_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ORACLE["one_hot"] = f"""
WITH rows_in AS (
  SELECT p_partkey, p_type, CASE WHEN p_size > 20 THEN NULL ELSE p_size % 3 END AS size_class FROM part
)
SELECT p_partkey, {_indicators('p_type', _PART_TYPES, 'p_type')},
       {_indicators('size_class', [0, 1, 2], 'size_class')}
FROM rows_in
"""
ORACLE["explode_combinations"] = """
WITH words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_brand, p_type FROM part)
SELECT p_partkey, word, p_brand AS attribute FROM words
UNION ALL SELECT p_partkey, word, p_type FROM words
"""
ORACLE["interaction_terms"] = "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE l_returnflag = '{g}' AND l_linestatus = '{s}') AS dummies_constline_{s}_gas_{g}"
    for g in _FLAG_VALUES
    for s in _LINE_VALUES
) + " FROM lineitem"

ORACLE["interaction_terms_long"] = """
SELECT 'dummies_constline_' || l_linestatus || '_gas_' || l_returnflag AS term, count(*) AS total
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL
"""

# --- models -----------------------------------------------------------------------------------


def _gram(source: str, terms: dict[str, str]) -> str:
    """Every cell as its own sum of products; cells of two terms that never meet are left out."""
    cells = []
    names = sorted(terms)
    for i, a in enumerate(names):
        for b in names[i:]:
            cells.append(
                f"SELECT '{a}' AS row_term, '{b}' AS col_term, "
                f"sum(CAST({terms[a]} AS DOUBLE) * CAST({terms[b]} AS DOUBLE)) AS \"value\" "
                f"FROM {source}"
            )
    return f"SELECT * FROM ({' UNION ALL '.join(cells)}) WHERE \"value\" <> 0"


def _indicator(column: str, value: str) -> str:
    return f"(CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END)"


ORACLE["gram_stats"] = f"""
WITH rows_in AS (
  SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag FROM lineitem
)
{_gram('rows_in', {
    **{f'flag_{v}': _indicator('flag', v) for v in _FLAG_VALUES},
    **{f'l_linestatus_{v}': _indicator('l_linestatus', v) for v in _LINE_VALUES},
    'const': '1', 'l_quantity': 'l_quantity', 'l_linenumber': 'l_linenumber',
})}
"""
ORACLE["gram_stats_wide"] = _gram(
    "lineitem",
    {
        "gas_A": _indicator("l_returnflag", "A"),
        "gas_N": _indicator("l_returnflag", "N"),
        "const": "1",
        "l_quantity": "l_quantity",
        "l_linenumber": "l_linenumber",
    },
)
# One factor with k levels next to a constant: const = sum of group means / (k + 1), the rest follows.
ORACLE["ols_factor"] = """
WITH g AS (
  SELECT l_returnflag AS level, avg(l_extendedprice) AS m, CAST(count(*) AS DOUBLE) AS n,
         var_pop(l_extendedprice) * count(*) AS sse
  FROM lineitem GROUP BY l_returnflag
),
s AS (
  SELECT CAST(count(*) AS DOUBLE) AS k, sum(m) / (count(*) + 1) AS const, sum(1 / n) AS inv,
         sum(sse) / (sum(n) - count(*)) AS s2, CAST(sum(n) AS BIGINT) AS total
  FROM g
),
fit AS (
  SELECT 'const' AS term, const AS coef, sqrt(s2 * inv) / (k + 1) AS std_err, total AS n FROM s
  UNION ALL
  SELECT 'l_returnflag_' || level, m - const,
         sqrt(s2 * (power(k / (k + 1), 2) / g.n + (inv - 1 / g.n) / power(k + 1, 2))), total
  FROM g, s
)
SELECT term, round(coef, 3) AS coef, round(std_err, 3) AS std_err, round(coef / std_err, 3) AS t, n FROM fit
"""
ORACLE["ols_cg_customers"] = """
WITH g AS (
  SELECT CAST(o_custkey AS VARCHAR) AS level, avg(o_totalprice) AS m FROM orders
  WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL GROUP BY o_custkey
),
s AS (SELECT sum(m) / (count(*) + 1) AS const FROM g),
c AS (SELECT count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT 'const' AS term, round(const, 0) AS coef, c.n FROM s, c
UNION ALL
SELECT 'o_custkey_' || level, round(m - const, 0), c.n FROM g, s, c
"""
ORACLE["ols_predict"] = """
WITH g AS (
  SELECT l_returnflag, avg(l_discount) AS mx, avg(l_quantity) AS my FROM lineitem
  WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_returnflag
),
b AS (
  SELECT sum((l.l_discount - g.mx) * (l.l_quantity - g.my)) / sum((l.l_discount - g.mx) * (l.l_discount - g.mx)) AS b
  FROM lineitem l JOIN g ON l.l_returnflag = g.l_returnflag
  WHERE l.l_discount IS NOT NULL AND l.l_quantity IS NOT NULL
)
SELECT l.l_orderkey, l.l_linenumber, round(g.my + b.b * (l.l_discount - g.mx), 3) AS prediction
FROM lineitem l JOIN g ON l.l_returnflag = g.l_returnflag CROSS JOIN b
"""
_LINE_FIT = """
SELECT 'const' AS term, round(regr_intercept(l_extendedprice, {0}), 4) AS coef,
       round(regr_r2(l_extendedprice, {0}), 8) AS r2 FROM lineitem
UNION ALL
SELECT '{0}', round(regr_slope(l_extendedprice, {0}), 4), round(regr_r2(l_extendedprice, {0}), 8) FROM lineitem
"""
ORACLE["ols_simple"] = _LINE_FIT.format("l_quantity")
ORACLE["ols_wide"] = _LINE_FIT.format("l_discount")
ORACLE["ridge_simple"] = """
WITH m AS (
  SELECT regr_sxy(l_extendedprice, l_discount) AS sxy, regr_sxx(l_extendedprice, l_discount) AS sxx,
         regr_syy(l_extendedprice, l_discount) AS syy, avg(l_extendedprice) AS y, avg(l_discount) AS x
  FROM lineitem
),
fit AS (SELECT *, sxy / (sxx + 1) AS w FROM m),
r AS (SELECT *, 1 - (syy - 2 * w * sxy + w * w * sxx) / syy AS r2 FROM fit)
SELECT 'l_discount' AS term, round(w, 4) AS coef, round(r2, 8) AS r2 FROM r
UNION ALL
SELECT 'const', round(y - w * x, 4), round(r2, 8) FROM r
"""



def _level_totals(features: str, categories: list[str]) -> str:
    parts = ["SELECT 'const' AS term, round(sum(amount_eur), 2) AS target_total, 1.0::DOUBLE AS explained FROM f"]
    parts += [
        f"SELECT '{c}_' || {c}, round(sum(amount_eur), 2), 1.0::DOUBLE FROM f GROUP BY {c}" for c in categories
    ]
    return f"WITH f AS (SELECT * FROM ({features})) {' UNION ALL '.join(parts)}"


_ASSET_LEVELS = ["engine_type", "engine_version", "gas_type_formatted", "industry", "subregion", "year"]
_ASSET_LEVELS += ["start_year", "category"]
ORACLE["cost_model_asset"] = _level_totals(ORACLE["cost_features_asset"], _ASSET_LEVELS)
_FITTED = [f"SELECT '{c}_' || {c} AS term, count(*) AS n, 1.0::DOUBLE AS explained FROM f WHERE {c} IS NOT NULL GROUP BY {c}" for c in _ASSET_LEVELS]
_FITTED += [f"SELECT '{c}', count(*), 1.0::DOUBLE FROM f" for c in ("average_actual_hours", "actual_hours")]
ORACLE["cost_model_scores"] = f"WITH f AS (SELECT * FROM ({ORACLE['cost_features_asset']})) {' UNION ALL '.join(_FITTED)}"
ORACLE["probit_probabilities"] = """
SELECT CASE WHEN lang <> 'es' THEN lang END AS lang, round(avg(quality), 5) AS probability
FROM labels JOIN documents USING (doc_id) GROUP BY 1
"""
ORACLE["cost_model_month"] = _level_totals(ORACLE["cost_features_month"], [*_ASSET_LEVELS, "month"])
ORACLE["cost_model_unit"] = _level_totals(
    ORACLE["cost_features_unit"], ["engine_type", "gas_type", "start_year", "category", "year"]
)

_SEGMENTS = _with(cells=views.SEGMENT_ROWS)
_PRICE = "round(avg(price), 2)"
ORACLE["score_segments"] = f"""
{_SEGMENTS},
r AS (SELECT region, {_PRICE} AS w FROM cells GROUP BY region),
g AS (SELECT gas, {_PRICE} AS w FROM cells GROUP BY gas),
i AS (SELECT industry, {_PRICE} AS w FROM cells WHERE industry <> 'I1' GROUP BY industry),
base AS (SELECT {_PRICE} AS w FROM cells)
SELECT s.region, s.gas, s.industry, round(base.w + r.w + g.w + i.w, 2) AS prediction
FROM (SELECT DISTINCT region, gas, industry FROM cells) s
JOIN r ON r.region = s.region JOIN g ON g.gas = s.gas LEFT JOIN i ON i.industry = s.industry CROSS JOIN base
"""
ORACLE["segment_effects"] = f"""
{_SEGMENTS} SELECT region, gas, industry, {_PRICE} AS "value" FROM cells GROUP BY region, gas, industry
"""
ORACLE["segment_effects_long"] = ORACLE["segment_effects"]


def _lattice() -> str:
    dims = ["region", "gas", "industry"]
    subsets = [[d for k, d in enumerate(dims) if mask >> k & 1] for mask in range(1, 8)]
    ctes = [
        f"c{n} AS (SELECT {', '.join(s)}, {_PRICE} AS w FROM cells GROUP BY {', '.join(s)})"
        for n, s in enumerate(subsets)
    ]
    joins = " ".join(
        f"LEFT JOIN c{n} ON " + " AND ".join(f"c{n}.{d} = s.{d}" for d in subset)
        for n, subset in enumerate(subsets)
    )
    total = " + ".join(f"coalesce(c{n}.w, 0)" for n in range(len(subsets)))
    return f"""
{_SEGMENTS}, {', '.join(ctes)}
SELECT s.region, s.gas, s.industry, round({total} + (SELECT {_PRICE} FROM cells), 2) AS effect
FROM (SELECT DISTINCT region, gas, industry FROM cells) s {joins}
"""


ORACLE["lattice_effects"] = _lattice()
ORACLE["sum_or_zero"] = f"""
{_with(financials=views.FINANCIALS)}
SELECT unit_serial,
       round(coalesce(sum(CASE WHEN unit_period < DATE '2001-01-01' THEN NULL ELSE cost END), 0), 4) AS cost
FROM financials WHERE unit_serial IS NOT NULL GROUP BY unit_serial
"""
