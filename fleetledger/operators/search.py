"""Searching text across columns and tagging rows by keyword."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.text import first_match


def _hit(name: str, pattern: str) -> Column:
    return F.col(f"`{name}`").cast("string").rlike(f"(?i){pattern}")


def search_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Which columns hold the pattern (regular expression, any case), and in how many rows.

    One pass over the table: a counter per column, then one row per column that was hit.
    """
    counted = df.agg(*[F.count_if(_hit(c, pattern)).alias(c) for c in df.columns])
    names = [F.col(f"`{c}`") for c in df.columns]
    return counted.unpivot([], names, "column_name", "n_matches").where("n_matches > 0")


def matching_rows(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any of the columns holds the pattern."""
    return df.where(reduce(or_, [F.coalesce(_hit(c, pattern), F.lit(False)) for c in columns or df.columns]))


def first_keyword(df: DataFrame, column: str, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """One new column per entry: the first of its keywords that occurs in the text, else null."""
    return df.withColumns({name: first_match(column, words) for name, words in keywords.items()})


def _pieces(text: Column, length: int) -> Column:
    """Every substring of ``length`` characters (one empty string for 0)."""
    if length == 0:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, length))


def first_keyword_table(df: DataFrame, column: str, keywords: DataFrame, names: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """``first_keyword`` with the lists held as a table (name, keyword, priority): per name, the keyword of smallest priority (then the
    smallest keyword) that occurs in the text, else null; one new column per name, replacing a column of that name.

    The keywords never enter the plan as literals. Each is keyed by its first ``k`` characters (a shorter one by itself); each distinct
    text gives its substrings of 0 to ``k`` characters, so a text that holds a keyword holds its key. One equi join of the keys makes the
    candidates, an exact ``contains`` check follows, and the smallest (priority, keyword) per text and name is kept; the result joins
    back to the rows on the text. Texts add about (k + 1) keys a character: meant for names and titles, not documents. A null text
    matches nothing; an empty keyword matches every other text; rows with a null name or keyword are ignored. ``names`` fixes the new
    columns (default: the names in the table, at most ``spark.sql.pivotMaxValues``).
    """
    words = keywords.select(
        F.col("name").cast("string").alias("__name"), F.col("keyword").cast("string").alias("__kw"), F.col("priority").alias("__prio")
    ).where(F.col("__name").isNotNull() & F.col("__kw").isNotNull())
    if names is None:
        bound = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        names = sorted(r[0] for r in words.select("__name").distinct().limit(bound + 1).collect())
        if len(names) > bound:
            raise ValueError(f"more than {bound} keyword lists")
    words = words.withColumn("__key", F.substring("__kw", 1, k))
    texts = df.select(F.col(column).cast("string").alias("__text")).where(F.col("__text").isNotNull()).distinct()
    keys = F.array_distinct(F.flatten(F.array(*[_pieces(F.col("__text"), n) for n in range(k + 1)])))
    keyed = texts.select("__text", F.explode(keys).alias("__key"))
    found = keyed.join(words, "__key").where(F.contains(F.col("__text"), F.col("__kw")))
    first = found.groupBy("__text", "__name").agg(F.min(F.struct("__prio", "__kw"))["__kw"].alias("__first"))
    wide = first.groupBy("__text").pivot("__name", list(names)).agg(F.first("__first"))
    rest = [c for c in df.columns if c not in names]
    joined = df.select(*[F.col(f"`{c}`") for c in rest], F.col(column).cast("string").alias("__text")).join(wide, "__text", "left")
    return joined.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{n}`") for n in names])
