"""Model designs and their Gram statistics, computed as aggregations over the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.text import as_label
from fleetledger.session import written_once

CONST = "const"


@dataclass(frozen=True)
class Design:
    """Complete rows of categories (one 0/1 term per level), numbers and a target.

    A null category is allowed: it has no term, so all indicators of that column are zero. ``profile`` is the table of ``profiled``.
    """

    frame: DataFrame
    categories: tuple[str, ...]
    numbers: tuple[str, ...]
    target: str
    profile: DataFrame | None = None


def build_design(
    df: DataFrame,
    categories: Sequence[str],
    numbers: Sequence[str],
    target: str,
    missing: str = "drop",
) -> Design:
    """Project to the model columns; rows without a number or target are dropped, or fail the query."""
    types = dict(df.dtypes)
    numeric = [*numbers, target]
    if missing == "drop":
        rows, values = df.dropna(how="any", subset=numeric), [F.col(c).cast("double").alias(c) for c in numeric]
    elif missing == "raise":
        rows = df
        values = [
            F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing value in {c}")))
            .otherwise(F.col(c).cast("double"))
            .alias(c)
            for c in numeric
        ]
    else:
        raise ValueError(f"unknown rule for missing values: {missing}")
    labels = [as_label(c, types[c]).alias(c) for c in categories]
    return Design(rows.select(*labels, *values), tuple(categories), tuple(numbers), target)


def _entry(a: Column, b: Column, value: Column) -> Column:
    """One Gram cell; the two names in alphabetical order, as the matrix is symmetric."""
    return F.struct(
        F.least(a, b).alias("row_term"), F.greatest(a, b).alias("col_term"), value.cast("double").alias("value")
    )


def gram_stats(design: Design) -> DataFrame:
    """Cells of [terms, numbers, const, target]' [terms, numbers, const, target], upper triangle.

    Rows with the same levels have the same indicators, so the table is first reduced to one row per
    combination of levels with counts, sums and sums of products. The cells then come from grouping
    sets over that: one level (diagonal), two levels (co-occurrence), none (numbers). Nothing leaves
    the JVM and no vocabulary is collected.
    """
    cats, values = list(design.categories), [*design.numbers, design.target]
    products = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    profile = design.profile
    if profile is None:
        profile = design.frame.groupBy(*cats).agg(F.count("*").alias("n"), *_sums(values, products))
    return _profile_cells(profile, cats, values, products)


def _sums(values: list[str], products: list[tuple[str, str]]) -> list[Column]:
    sums = {f"s{i}": F.col(v) for i, v in enumerate(values)}
    sums |= {f"p{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(products)}
    return [F.sum(v).alias(name) for name, v in sums.items()]


def _moments(values: list[str], products: list[tuple[str, str]]) -> list[Column]:
    means = [F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]
    return means + [(F.covar_pop(a, b) * F.count("*")).alias(f"c{k}") for k, (a, b) in enumerate(products)]


def profiled(design: Design) -> Design:
    """The design with its table of level combinations, which serves ``gram_stats`` and the fits: counts, sums and sums of products,
    means and central co-moments of ``level_moments``, from one scan of the rows, written once.

    For rows that are costly to build and read by more than one of them.
    """
    cats, values = list(design.categories), [*design.numbers, design.target]
    products = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    profile = design.frame.groupBy(*cats).agg(F.count("*").alias("n"), *_sums(values, products), *_moments(values, products))
    return replace(design, profile=written_once(profile, "level-profile"))


def level_moments(design: Design) -> DataFrame:
    """One row per combination of levels with its count ``n``, the means ``m{i}`` of the numbers and the target, and their central
    co-moments ``c{k}`` (sum of products of deviations from the combination's means) for every pair, in one scan of the rows.

    Spark's mean and covariance aggregates merge partial results by the parallel update rule, so the partial aggregation before the
    shuffle keeps its digits for numbers far from zero.
    """
    cats, values = list(design.categories), [*design.numbers, design.target]
    products = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    return design.frame.groupBy(*cats).agg(F.count("*").alias("n"), *_moments(values, products))


def centred_gram_stats(design: Design, moments: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The cells of ``gram_stats`` with the numbers and the target centred at their overall means, from ``level_moments``.

    The overall means come from the (small) moments table; a combination's centred sums follow from its own moments:
    sum(a - mu_a) = n (m_a - mu_a) and sum((a - mu_a)(b - mu_b)) = c_ab + n (m_a - mu_a)(m_b - mu_b). The rows are read once.
    """
    cats, values = list(design.categories), [*design.numbers, design.target]
    products = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    found = moments.agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"m{i}")).alias(f"t{i}") for i in range(len(values))]
    ).first()
    total = found["n"] or 0
    means = {v: (found[f"t{i}"] / total if total else 0.0) for i, v in enumerate(values)}
    off = {v: F.col(f"m{i}") - F.lit(means[v]) for i, v in enumerate(values)}
    sums = {f"s{i}": F.col("n") * off[v] for i, v in enumerate(values)}
    sums |= {f"p{k}": F.col(f"c{k}") + F.col("n") * off[a] * off[b] for k, (a, b) in enumerate(products)}
    profile = moments.select(*cats, "n", *[v.alias(name) for name, v in sums.items()])
    return _profile_cells(profile, cats, values, products), means


def _profile_cells(profile: DataFrame, cats: list[str], values: list[str], products: list[tuple[str, str]]) -> DataFrame:
    """Gram cells from a table of level combinations with counts ``n``, sums ``s{i}`` and sums of products ``p{k}``."""
    sums = [f"s{i}" for i in range(len(values))] + [f"p{k}" for k in range(len(products))]
    # grouping() tells a column outside the set from a null level; both give no term name.
    terms = [F.when(F.grouping(c) == 0, F.concat(F.lit(f"{c}_"), F.col(c))) for c in cats]
    used = sum((1 - F.grouping(c).cast("int") for c in cats), F.lit(0))
    sets = [[], *[[c] for c in cats], *[list(p) for p in combinations(cats, 2)]]
    totals = [F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums]]
    if cats:
        grouped = profile.groupingSets(sets, *cats).agg(
            *totals, used.alias("used"), F.array_compact(F.array(*terms)).alias("terms")
        )
    else:
        no_terms = F.array().cast("array<string>")
        grouped = profile.agg(*totals).withColumns({"used": F.lit(0), "terms": no_terms})

    n, const = F.col("n"), F.lit(CONST)
    first, second = F.get("terms", F.lit(0)), F.get("terms", F.lit(1))
    of_none = [
        _entry(const, const, n),
        *[_entry(const, F.lit(v), F.col(f"s{i}")) for i, v in enumerate(values)],
        *[_entry(F.lit(a), F.lit(b), F.col(f"p{i}")) for i, (a, b) in enumerate(products)],
    ]
    of_one = [
        _entry(first, first, n),
        _entry(const, first, n),
        *[_entry(F.lit(v), first, F.col(f"s{i}")) for i, v in enumerate(values)],
    ]
    cells = (
        F.when(F.col("used") == 0, F.array(*of_none))
        .when(F.col("used") == 1, F.array(*of_one))
        .otherwise(F.array(_entry(first, second, n)))
    )
    return grouped.where(F.size("terms") == F.col("used")).select(F.inline(cells))


def gram_stats_wide(df: DataFrame, terms: Sequence[str], target: str) -> DataFrame:
    """The same cells for a design that is already wide: numeric or 0/1 columns, one per term.

    Each task multiplies its Arrow batches into one small matrix; the matrices are added by a
    grouped sum. For many columns, where a SQL sum per pair would not fit one plan. A missing value
    fails the query.
    """
    columns = [*terms, CONST, target]
    size = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((size, size))
        for batch in batches:
            if any(column.null_count for column in batch.columns):
                raise ValueError("missing value in a model column")
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            gram += x.T @ x
        row, col = np.nonzero(np.triu(gram))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(gram[row, col], pa.float64())],
            names=["i", "j", "value"],
        )

    parts = [F.col(f"`{c}`").cast("double") for c in terms]
    wide = df.select(
        *[p.alias(f"x{i}") for i, p in enumerate(parts)],
        F.lit(1.0).alias("one"),
        F.col(f"`{target}`").cast("double").alias("y"),
    )
    cells = wide.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("v"))
    names = F.array(*[F.lit(c) for c in columns])
    named = _entry(F.get(names, F.col("i")), F.get(names, F.col("j")), F.col("v"))
    return cells.select(F.inline(F.array(named)))
