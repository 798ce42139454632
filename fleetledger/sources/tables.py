"""Table scans. A catalog entry says where a logical table lives; plans only know its name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetledger.functions.text import strip_contract_suffix

# Logical tables of the service business. Each is read in full; Spark prunes columns and rows.
LOGICAL_TABLES = (
    "contract_landscape",
    "contract_definition",
    "unit_definition",
    "unit_definition_billings",
    "opportunity_definition",
    "counter_readings",
    "maintenance_events",
    "service_case",
    "service_subcase",
    "gl_transactions",
    "gl_accounts",
    "geo_metadata",
)

FINANCIALS_SCHEMA = T.StructType(
    [
        T.StructField("unit_period", T.DateType()),
        T.StructField("unit_serial", T.StringType()),
        T.StructField("contract_number", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("billings", T.DoubleType()),
        T.StructField("ic_cost", T.DoubleType()),
    ]
)


def load_table(spark: SparkSession, name: str, catalog: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Full scan of a logical table.

    A catalog entry is ``{"table": "db.name"}`` for a metastore table, or a data source format with
    its path and options: ``{"format": "parquet", "path": ...}``, ``{"format": "jdbc", "options":
    {...}}``. Give JDBC reads ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``
    for a parallel scan.
    """
    if name not in catalog:
        raise KeyError(f"{name!r} is not in the catalog; the logical tables are {', '.join(LOGICAL_TABLES)}")
    entry = catalog[name]
    if "table" in entry:
        return spark.read.table(entry["table"])
    reader = spark.read.format(entry.get("format", "parquet")).options(**entry.get("options", {}))
    if "schema" in entry:
        reader = reader.schema(entry["schema"])
    return reader.load(entry["path"]) if "path" in entry else reader.load()


# The counter type and source the cost models read.
OPERATING_HOURS, HISTORY = "OPH", "HISTORY"


def load_counter_readings(
    df: DataFrame, counter_type: str = OPERATING_HOURS, source: str = HISTORY
) -> DataFrame:
    """Readings of one counter type from one source."""
    return df.where((F.col("counter_type") == counter_type) & (F.col("source") == source))


def head_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return df.orderBy(*order_by).limit(n)


def clean_landscape(df: DataFrame) -> DataFrame:
    """The short landscape extract: contract number without version suffixes, status as its type."""
    return df.select(
        strip_contract_suffix("contract_number").alias("oracle_contract_number"),
        F.col("quote_number"),
        F.col("contract_type"),
        F.col("contract_status").alias("oracle_contract_type"),
        F.col("customer_name"),
        F.col("unit_status").alias("oracle_unit_status"),
        F.col("unit_serial_raw"),
        F.col("engine_serial_raw"),
        F.col("eot_date"),
    )


def load_financials_csv(
    spark: SparkSession, path: str, schema: T.StructType = FINANCIALS_SCHEMA, names: Mapping[str, str] | None = None
) -> DataFrame:
    """Unit financials from CSV files with a header line, found by the names in it and typed by the schema.

    ``names`` maps our column names to those of the header where they differ. Other columns are left out; a missing one, a value of another
    type, and a file with another header than the first are errors.
    """
    names = {field.name: (names or {}).get(field.name, field.name) for field in schema}
    header = spark.read.option("header", True).csv(path).columns
    missing = [ours for ours, theirs in names.items() if theirs not in header]
    if missing:
        raise ValueError(f"the header has no column for {', '.join(missing)}")
    types = {names[field.name]: field.dataType for field in schema}
    stored = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = spark.read.schema(stored).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    return reader.csv(path).select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in names.items()])
