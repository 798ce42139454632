"""Wide and long forms: comparison matrices, display grids, indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetledger.functions.aggregates import aggregate_by_name
from fleetledger.functions.text import as_label
from fleetledger.operators.grouping import known_keys, median_by


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def header_values(df: DataFrame, column: str, limit: int | None = None) -> list:
    """The sorted distinct values that become column names.

    Column names live in the plan, so their number is bounded: by ``limit``, or by Spark's own
    pivot limit. Beyond it this raises rather than dropping columns.
    """
    bound = limit or int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{column!r} has more than {bound} values: too many for columns")
    return sorted(r[0] for r in rows)


def comparison_matrix(
    df: DataFrame,
    target: str,
    y: str,
    x: str,
    operation: str,
    x_values: Sequence | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per ``y``, one column ``<x>_<value>`` per value of ``x``, each cell an aggregate of
    ``target``. A combination without rows is null, also for counts and sums."""
    values = None if x_values is None else {x: x_values}
    return comparison_matrices(df, target, y, [x], operation, values, order_by)


def comparison_matrices(
    df: DataFrame,
    target: str,
    y: str,
    xs: Sequence[str],
    operation: str,
    x_values: Mapping[str, Sequence] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Comparison matrices for several ``x`` columns side by side.

    All of them come from one aggregation over grouping sets and one pivot; no joins.
    """
    rows, types = known_keys(df, [y]), _types(df)
    x_values = {x: (x_values or {}).get(x) for x in xs}
    x_values = {x: header_values(rows, x) if v is None else v for x, v in x_values.items()}

    if operation == "median":
        parts = [median_by(rows, [y, x], target, "__cell").withColumn("__x", F.lit(x)) for x in xs]
        parts = [p.select(y, "__x", as_label(x, types[x]).alias("__v"), "__cell") for p, x in zip(parts, xs)]
        cells = parts[0]
        for part in parts[1:]:
            cells = cells.unionByName(part)
    else:
        grouped = rows.groupingSets([[y, x] for x in xs], y, *xs).agg(
            aggregate_by_name(operation, target, order_by).alias("__cell"),
            *[F.grouping(x).alias(f"__out_{i}") for i, x in enumerate(xs)],
        )
        of_set = [F.col(f"__out_{i}") == 0 for i in range(len(xs))]
        cells = grouped.select(
            y,
            F.coalesce(*[F.when(here, F.lit(x)) for here, x in zip(of_set, xs)]).alias("__x"),
            F.coalesce(*[F.when(here, as_label(x, types[x])) for here, x in zip(of_set, xs)]).alias("__v"),
            "__cell",
        ).where("__v IS NOT NULL")

    names = [f"{x}_{label}" for x in xs for label in _labels(df.sparkSession, x_values[x], df.schema[x].dataType)]
    header = F.concat(F.col("__x"), F.lit("_"), F.col("__v"))
    wide = cells.select(y, header.alias("__header"), "__cell")
    # A y value stays when any of its x values is known, whether or not that one became a column.
    return wide.groupBy(y).pivot("__header", names).agg(F.first("__cell"))


def _labels(spark: SparkSession, values: Sequence, data_type: T.DataType) -> list[str]:
    """Texts of values, made by the same expression as the texts of the cells they head."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", data_type)])
    rows = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in rows.orderBy("i").select(as_label("v", data_type.simpleString())).collect()]


def display_grids(
    df: DataFrame,
    header_dims: Sequence[str],
    row_dim: str,
    variables: Sequence[str],
    filters: Mapping[str, Sequence] | None = None,
    strict: bool = True,
    headers: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """One grid per variable: rows by ``row_dim``, columns by the joined header dimensions.

    Nothing is aggregated: in strict mode two rows for one cell fail the query, otherwise the
    smallest value is shown. ``filters`` keeps listed values of chosen dimensions.
    """
    rows = df
    for name, allowed in (filters or {}).items():
        rows = rows.where(F.col(name).isin(list(allowed)))
    header = F.concat(*[F.col(c).cast("string") for c in header_dims])
    rows = rows.withColumn("__header", header).where("__header IS NOT NULL")
    names = list(headers) if headers is not None else header_values(rows, "__header")

    def grid(variable: str) -> DataFrame:
        cell = F.min(variable)
        if strict:
            message = F.concat(F.lit("more than one row for cell "), F.col("__header"))
            cell = F.when(F.count("*") > 1, F.raise_error(message)).otherwise(cell)
        cells = rows.groupBy(row_dim, "__header").agg(cell.alias("__cell"))
        return cells.groupBy(row_dim).pivot("__header", names).agg(F.first("__cell"))

    return {variable: grid(variable) for variable in variables}


def unpivot_metrics(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
    variable: str = "variable", value: str = "value",
) -> DataFrame:
    """Wide to long; null cells are kept."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, variable, value)


def one_hot(
    df: DataFrame, columns: Sequence[str], vocabulary: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<value>``, no level left out; null gives all zero."""
    vocabulary = dict(vocabulary or {})
    flags: list[Column] = []
    for name in columns:
        levels = vocabulary[name] if name in vocabulary else header_values(df, name)
        kind = df.schema[name].dataType
        for level, label in zip(levels, _labels(df.sparkSession, levels, kind)):
            flag = F.when(F.col(name) == F.lit(level).cast(kind), 1).otherwise(0)
            flags.append(flag.alias(f"{name}_{label}"))
    return df.select(*[F.col(c) for c in df.columns if c not in columns], *flags)


def interaction_terms(
    df: DataFrame, prefixes: Sequence[str], marker: str = "dummies_const", long: bool = False, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the products of every two indicator columns from different groups.

    A group is all columns that start with one of the prefixes; a product column is named
    ``<marker><second>_<first>``, so the marker count of a name tells the order of the interaction.

    With ``long`` the result is sparse instead: one row (``keep`` columns, term, value) for every product of a row that is not zero
    (a null cell counts as not zero, its product is null), built from the row's active levels; no zero cell is ever written, so
    thousands of terms make no wide row. A row without any such product gives one row with a null term, so that it stays known.
    """
    groups = [[c for c in df.columns if c.startswith(p)] for p in prefixes]
    if long:
        actives = [active_cells(g) for g in groups]
        pairs = [cross_cells(a, b, marker) for a, b in combinations(actives, 2)]
        cells = F.flatten(F.array(*pairs)) if pairs else F.array().cast(CELLS)
        return df.select(*[F.col(f"`{c}`") for c in keep or []], F.inline_outer(cells))
    products = {
        f"{marker}{b}_{a}": F.col(f"`{a}`") * F.col(f"`{b}`")
        for left, right in combinations(groups, 2)
        for a in left
        for b in right
    }
    return df.withColumns(products) if products else df


#: Type of the sparse cells of a row.
CELLS = "array<struct<term:string,value:double>>"


def active_cells(columns: Sequence[str]) -> Column:
    """The row's cells of these indicator columns that are not zero, as (term, value); a null cell counts as not zero."""
    if not columns:
        return F.array().cast(CELLS)
    every = F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return F.filter(every, lambda x: F.coalesce(x["value"] != 0, F.lit(True)))


def cross_cells(left: Column, right: Column, marker: str = "dummies_const") -> Column:
    """Products of every cell of ``left`` with every cell of ``right``, named ``<marker><right>_<left>`` like the wide columns."""
    return F.flatten(
        F.transform(
            left,
            lambda a: F.transform(
                right, lambda b: F.struct(F.concat(F.lit(marker), b["term"], F.lit("_"), a["term"]).alias("term"), (a["value"] * b["value"]).alias("value"))
            ),
        )
    )


def explode_combinations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per combination of the elements of the list columns; an empty or null list gives none."""
    for name in columns:
        df = df.withColumn(name, F.explode(F.col(name)))
    return df
