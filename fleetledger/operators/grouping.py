"""Grouped statistics. Every operator drops rows with a null group key first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.operators.joins import key_join, semi

# One over the greatest error of an approximate percentile's rank, as a share of the group.
_RANK_ACCURACY = 10_000


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose group keys are all present."""
    return df.dropna(how="any", subset=list(keys))


def mean_by(df: DataFrame, keys: Sequence[str], column: str, alias: str | None = None) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(F.avg(column).alias(alias or f"mean_{column}"))


def range_profile(df: DataFrame, keys: Sequence[str], column: str, where: Column | None = None) -> DataFrame:
    """Smallest and largest value per group, optionally on a selection of the rows."""
    rows = df if where is None else df.where(where)
    return (
        known_keys(rows, keys)
        .groupBy(*keys)
        .agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))
    )


def count_by(df: DataFrame, keys: Sequence[str], column: str, alias: str = "n") -> DataFrame:
    """Number of rows with a value in ``column``, per group."""
    return known_keys(df, keys).groupBy(*keys).agg(F.count(column).alias(alias))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their row counts; equal counts go by value."""
    return (
        known_keys(df, [column])
        .groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.asc(column))
        .limit(n)
    )


def keep_top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows whose value is among the ``n`` most frequent ones."""
    return semi(df, top_values(df, column, n), column)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key (null is a key too): the least in ``order_by``, then in the other columns.

    An aggregate rather than a ranking window, so a hot key is combined on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in order_by if c not in keys] + [c for c in rest if c not in order_by]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def median_by(df: DataFrame, keys: Sequence[str], column: str, alias: str = "median") -> DataFrame:
    """Exact median per group; missing values and NaN do not count, infinite values do.

    A first aggregate counts the values and brackets the middle by approximate percentiles, whose rank error is bounded. A second one
    counts the values below the bracket and those in it, value by value, and the middle ranks are read from these counts: about one value
    in 700 of a large group, and no step holds the whole group.
    """
    keys = list(keys)
    value = F.col(column).cast("double")
    rows = known_keys(df, keys).select(*keys, F.when(~F.isnan(value), value).alias("__v"))
    margin = 7 / _RANK_ACCURACY
    bracket = F.percentile_approx("__v", [0.5 - margin, 0.5 + margin], _RANK_ACCURACY)
    groups = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), bracket.alias("__q"))
    near = key_join(rows.where("__v IS NOT NULL"), groups, keys, "inner", null_safe=False).where("__v <= __q[1]")
    slot = F.when(F.col("__v") >= F.col("__q")[0], F.col("__v"))
    counts = near.groupBy(*keys, "__n", slot.alias("__slot")).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__slot")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__c").over(line))

    def at(rank: Column) -> Column:
        # the first entry that passes the rank; "below the bracket" (null) sorts first and is never it
        return F.min(F.when(F.col("__upto") > rank, F.struct("__upto", "__slot")))["__slot"]

    lower, upper = at(F.floor((F.col("__n") - 1) / 2)), at(F.floor(F.col("__n") / 2))
    middle = F.coalesce(lower / 2 + upper / 2, F.raise_error(F.lit("the middle ranks are outside their bracket")))
    found = ranked.groupBy(*keys).agg(middle.alias(alias))
    return found.unionByName(groups.where("__n = 0").select(*keys, F.lit(None).cast("double").alias(alias)))
