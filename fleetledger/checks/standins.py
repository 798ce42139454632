"""Stand-in views: the business tables derived from the available test tables.

Each view is one SQL text that both engines read, so both sides of a check start from the same rows.
A name in braces is an input table. Everything is a function of the given rows.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LANDSCAPE = """
SELECT cast(o_orderkey AS string)
         || CASE WHEN o_orderkey % 5 = 0 THEN '_EXP3' WHEN o_orderkey % 7 = 0 THEN '_REP' ELSE '' END
         AS contract_number,
       cast(o_custkey AS string) AS quote_number,
       o_orderpriority AS contract_type,
       c_mktsegment AS contract_type2,
       CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' ELSE 'CLOSED' END AS contract_status,
       p_name AS contract_name,
       c_name AS customer_name,
       n_name AS country,
       CASE l_linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'ENDED' END AS unit_status,
       CASE l_returnflag WHEN 'N' THEN 'Active' WHEN 'A' THEN 'Standby' ELSE 'Retired' END AS ib_status,
       CASE WHEN l_partkey % 97 = 0 THEN NULL
            WHEN l_partkey % 89 = 0 THEN 'Dummy ' || cast(l_partkey AS string)
            WHEN l_partkey % 11 = 0 THEN 'A_' || cast(l_partkey AS string)
            ELSE 'JEN-' || cast(l_partkey AS string) END AS unit_serial_raw,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS unit_serial,
       CASE WHEN l_suppkey % 19 = 0 THEN 'none' ELSE 'GEJ-' || cast(l_suppkey AS string) || 'x' END
         AS engine_serial_raw,
       cast(o_orderdate AS date) AS eot_date,
       CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE cast(l_shipdate AS date) END AS commissioning
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
     JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey
     JOIN {part} ON l_partkey = p_partkey
"""

# Reading times are cut to the hour, which makes ties at the bounds of a period.
COUNTERS = """
SELECT user_id AS asset_id, date_trunc('hour', ts) AS ts, value AS counter_value, event_type AS counter_type,
       CASE WHEN event_id % 2 = 0 THEN 'HISTORY' ELSE 'LIVE' END AS source
FROM {events}
"""

CASES = """
SELECT cast(o_orderkey AS string) AS case_id,
       CASE WHEN o_orderkey % 50 = 0 THEN 'Training Center' ELSE 'Site ' || cast(o_custkey AS string) END
         AS site_name,
       CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE 'C' || cast(o_custkey AS string) END AS site_customer,
       'CN' || cast(o_orderkey AS string) AS case_number,
       o_orderdate AS created, o_orderdate AS closed, o_orderdate AS incident,
       o_orderpriority AS segment, 'link' || cast(o_orderkey AS string) AS event_link
FROM {orders}
"""

SUBCASES = """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS subcase_id,
       cast(l_orderkey AS string) AS main_case_id, l_shipdate AS created
FROM {lineitem}
"""

MAINTENANCE = """
SELECT event_id, event_id - event_id % 10 AS main_event_id, cast(event_id AS string) AS case_number,
       1577836800000 + event_id * 8639123 AS approval_ms, 1577836800999 + event_id * 8640007 AS engine_ready_ms
FROM {events}
"""

COUNTERS_IN_MILLIS = """
SELECT event_id % 50 AS asset_id, 1577836800999 + event_id * 8640007 AS ts_ms, value AS counter_value
FROM {events}
"""

TRANSACTIONS = """
SELECT CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE 'SR' || cast(o_custkey % 500 AS string) END
         AS service_request_number,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey END AS service_request_ref,
       l_returnflag AS sub_division, o_orderpriority AS cost_category,
       CASE l_linestatus WHEN 'F' THEN 'P1' ELSE 'P2' END AS project_code,
       cast(month(l_shipdate) AS string) || '-' || substr(cast(year(l_shipdate) AS string), 3, 2)
         AS fiscal_period,
       o_orderstatus AS ledger, cast(l_suppkey AS string) AS account,
       'acc' || cast(l_suppkey % 10 AS string) AS account_dd,
       CASE WHEN l_linenumber <= 5 THEN 'Services' ELSE 'Equipment' END AS business_segment,
       l_extendedprice AS amount_eur, l_orderkey AS order_key, l_partkey AS part_key, l_linenumber AS line
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

ACCOUNTS = """
SELECT cast(s_suppkey AS string) AS account, 'h' || cast(s_nationkey % 3 AS string) AS hierarchy_1,
       'n' || cast(s_nationkey AS string) AS hierarchy_2, 's' || cast(s_suppkey % 7 AS string) AS hierarchy_3,
       'g' || cast(s_nationkey % 5 AS string) AS alt_hierarchy,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Revenue' ELSE 'Expense' END AS account_type
FROM {supplier}
"""

FINANCIALS = """
SELECT cast(l_shipdate AS date) AS unit_period,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS unit_serial,
       cast(l_suppkey AS string) AS contract_number,
       l_extendedprice * l_tax AS cost, l_extendedprice * l_discount AS billings,
       l_extendedprice * 0.01 AS ic_cost
FROM {lineitem}
"""

MARGIN_BASE = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS unit_serial,
       cast(l_suppkey AS string) AS contract_number, year(l_shipdate) AS year,
       l_returnflag AS service_region, p_type AS industry,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS gas_type
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

OPERATING = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END AS asset_id,
       cast(l_partkey AS string) AS unit_serial,
       year(l_shipdate) AS year, month(l_shipdate) AS month,
       p_type AS engine_type, p_brand AS engine_version, l_returnflag AS gas_type,
       CASE l_returnflag WHEN 'N' THEN 'Natural' WHEN 'A' THEN 'Bio' ELSE NULL END AS gas_type_formatted,
       'I' || cast(l_suppkey % 4 AS string) AS industry, 'S' || cast(l_suppkey % 6 AS string) AS subregion,
       1995 + l_linenumber % 4 AS start_year,
       cast(cast(1995 + l_linenumber % 4 AS string) || '-06-15' AS date) AS contract_start,
       CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE cast(l_linenumber * 1000 AS double) END AS start_hours,
       CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_quantity * 1200 END AS end_hours,
       l_extendedprice / 100 AS actual_hours, l_extendedprice AS counter_value_max
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

UNIT_COSTS = """
SELECT CASE l_linestatus WHEN 'F' THEN 'Unplanned' ELSE 'Planned' END AS cost_category,
       CASE l_returnflag WHEN 'R' THEN 'Revenue' ELSE 'Expense' END AS margin_class,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS unit_serial,
       l_extendedprice AS amount_eur
FROM {lineitem}
"""

ASSET_COSTS_YEAR = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END AS asset_id, year(l_shipdate) AS year,
       sum(l_extendedprice) AS amount_eur
FROM {lineitem}
GROUP BY CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END, year(l_shipdate)
"""

ASSET_COSTS_MONTH = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END AS asset_id, year(l_shipdate) AS year,
       month(l_shipdate) AS month, sum(l_extendedprice) AS amount_eur
FROM {lineitem}
GROUP BY CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END, year(l_shipdate), month(l_shipdate)
"""

SEGMENT_ROWS = """
SELECT l_linestatus AS region, l_returnflag AS gas, 'I' || cast(l_suppkey % 3 AS string) AS industry,
       l_extendedprice AS price
FROM {lineitem}
"""

PREDICTIONS = """
SELECT c_mktsegment AS industry, o_orderstatus AS gas_type, 'R' || cast(n_regionkey AS string) AS region,
       round(sum(o_totalprice), 2) AS amount, count(*) AS n_orders
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY c_mktsegment, o_orderstatus, n_regionkey
"""


def inputs_of(text: str) -> list[str]:
    """The input tables a view text names."""
    return sorted({name for _, name, _, _ in Formatter().parse(text) if name})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view as a Spark table over the parquet files of one folder."""
    tables = {name: table(spark, sf_dir, name) for name in inputs_of(text)}
    rows = spark.sql(text, **tables)
    zoned = [name for name, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned}) if zoned else rows


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its schema is looked up in the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def sql_view(text: str) -> str:
    """The view as plain SQL over tables of the same names."""
    return text.format(**{name: name for name in inputs_of(text)})
