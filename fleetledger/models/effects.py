"""From interaction coefficients to effects per segment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.text import as_label, count_token
from fleetledger.operators.grouping import known_keys
from fleetledger.operators.joins import left_join
from fleetledger.session import written_once

# How interaction terms and the base term of the sensitivity are named.
MARKER = "dummies_const"
FLAG_TERM = "minimumoperatinghours"


def segment_effects(
    base: DataFrame, coefs: DataFrame, dims: Sequence[str], marker: str = MARKER, order: int = 3, long: bool = False
) -> DataFrame:
    """Sum of the interaction coefficients that apply to each segment.

    ``base`` holds the dimensions and the design columns. A coefficient applies to a segment when
    any of its rows has a non-zero cell (a missing cell is one), and counts once; a segment without any has effect zero.
    Numeric columns that are neither add each of their distinct values once.

    The cells of all terms become rows, of which the distinct ones meet the coefficients in a join; so the number of terms only
    makes the table longer. A term of that order without a design column is an error.
    """
    weights = coefs.where(count_token("term", marker) == order).select(F.col("term").alias("__term"), F.col("coef").alias("__coef"))
    if long:
        return _long_effects(base, weights, dims)
    terms = [c for c in base.columns if c not in dims and marker in c]
    extra = [c for c in base.columns if c not in dims and marker not in c]
    rows = known_keys(base, dims)
    absent = [r[0] for r in weights.where(~F.col("__term").isin(terms)).select("__term").limit(5).collect()]
    if absent:
        raise ValueError(f"terms without a design column: {sorted(absent)}")
    segments = rows.select(*dims).distinct()
    parts = []
    if terms:
        cells = [F.struct(F.lit(t).alias("__term"), F.coalesce(F.col(f"`{t}`") != 0, F.lit(True)).alias("__on")) for t in terms]
        lit = rows.select(*dims, F.inline(F.array(*cells))).where("__on").select(*dims, "__term").distinct()
        parts.append(lit.join(weights, "__term").select(*dims, F.col("__coef").alias("value")))
    if extra:
        long = rows.unpivot(list(dims), [F.col(f"`{c}`").cast("double").alias(c) for c in extra], "variable", "value")
        parts.append(long.distinct().select(*dims, "value"))
    parts.append(segments.withColumn("value", F.lit(0.0)))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*dims).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def _long_effects(cells: DataFrame, weights: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``segment_effects`` on sparse cells (dims, term, value) such as ``interaction_terms(..., long=True)`` makes.

    Only non-zero cells exist, so a (segment, term) pair applies when it is there at all; the pairs are made distinct with a map-side
    partial distinct before one shuffle, meet the coefficients in a left join and are summed per segment: one pass over the cells, in
    which every segment with a known key appears (rows without a cell carry a null term). Segments whose cells meet no
    coefficient have effect zero. A coefficient whose term no row holds adds nothing (the wide form's missing-column error has no
    counterpart: a term absent from every row is a term whose cells are all zero).
    """
    cells = known_keys(cells, dims).select(*dims, F.col("term").alias("__term")).distinct()
    applied = cells.join(weights, "__term", "left").groupBy(*dims).agg(F.sum("__coef").alias("__value"))
    return applied.select(*dims, F.coalesce(F.col("__value"), F.lit(0.0)).alias("value"))


def _substrings(text: Column, longest: Column) -> Column:
    """All distinct substrings of a term name up to a length."""
    starts = F.sequence(F.lit(1), F.length(text))

    def from_start(i):
        ends = F.sequence(F.lit(1), F.least(longest, F.length(text) - i + 1))
        return F.transform(ends, lambda n: F.substring(text, i, n))

    return F.array_distinct(F.flatten(F.transform(starts, from_start)))


def tag_terms(coefs: DataFrame, segments: DataFrame, dims: Sequence[str], prefixes: dict[str, str]) -> DataFrame:
    """Per dimension, the first of its values (in sorted order) that occurs in the term name.

    A value of a dimension with a prefix only counts where the prefix stands before it. The lookup
    is an equi join of the substrings of the few term names with the values, so the list of values
    may be of any size and no term is compared with every value.
    """
    tagged, types = coefs, dict(segments.dtypes)
    for dim in dims:
        prefix = prefixes.get(dim, "")
        value = F.concat(F.lit(prefix), as_label(dim, types[dim]))
        known = segments.where(F.col(dim).isNotNull()).select(value.alias("__value"), F.col(dim).alias("__dim"))
        known = known.where("__value <> ''").distinct()
        longest = F.coalesce(known.select(F.max(F.length("__value"))).scalar(), F.lit(0))
        terms = coefs.select("term").distinct().withColumn("__longest", longest)
        pieces = terms.where("term <> '' AND __longest > 0").select(
            "term", F.explode(_substrings(F.col("term"), F.col("__longest"))).alias("__value")
        )
        found = pieces.join(known, "__value").groupBy("term").agg(F.min("__dim").alias(dim))
        tagged = left_join(tagged, found, ["term"], null_safe=False)
    return tagged


def lattice_effects(
    coefs: DataFrame,
    segments: DataFrame,
    dims: Sequence[str],
    flag_term: str = FLAG_TERM,
    marker: str = MARKER,
    prefixes: dict[str, str] | None = None,
) -> DataFrame:
    """Effect of the flag term on each segment: its own coefficient plus those of its interactions.

    A term with k markers is an interaction of k dimensions; it applies to a segment when the values
    tagged in its name agree with the segment on a subset of k dimensions (null agrees with null),
    whatever it is tagged with elsewhere. Several terms for one subset give several rows.

    One equi join does the matching: each segment is dealt to every subset of the dimensions (2^d - 1 rows, keyed by the subset's
    mask and its values with the rest null), each term to every subset of its order, and null-safe keys meet once; the matches are
    gathered per segment and summed in one aggregation.
    """
    segments = written_once(segments.select(*dims).distinct(), "segments")
    coefs = written_once(coefs.select("term", "coef"), "coefficients")
    flagged = coefs.where(F.col("term").contains(flag_term) & (F.col("term") != flag_term))
    tagged = tag_terms(flagged, segments, dims, prefixes or {}).withColumn("__order", count_token("term", marker))
    # Written once: the tagging joins are not run again by the plan below.
    params = written_once(tagged.where("__order > 0"), "tagged-terms")

    any_tag = reduce(or_, [F.col(d).isNotNull() for d in dims])
    # Subsets of the dimensions as bit masks, by size and then in the order of combinations: the order in which effects add up.
    masks = [sum(1 << i for i in subset) for size in range(1, len(dims) + 1) for subset in combinations(range(len(dims)), size)]

    def keys(mask: Column, prefix: str) -> list[Column]:
        """The dimensions inside the subset, null outside it: a segment and a term of one subset meet on these."""
        return [F.when(mask.bitwiseAND(1 << i) != 0, F.col(dim)).alias(f"{prefix}{i}") for i, dim in enumerate(dims)]

    every = F.array(*[F.lit(m) for m in masks])
    # Each segment stands once for each subset; each term for each subset of as many dimensions as it has markers.
    seg = segments.select(*dims, F.explode(every).alias("__mask"))
    seg = seg.select(*dims, "__mask", *keys(F.col("__mask"), "__k"))
    sized = F.filter(every, lambda m: F.bit_count(m) == F.col("__order"))
    term = params.where(any_tag).select(*dims, F.col("coef").cast("double").alias("__coef"), F.explode(sized).alias("__tmask"))
    # Equal coefficients of one subset give equal rows, which count once.
    term = term.select("__tmask", *keys(F.col("__tmask"), "__t"), "__coef").distinct()
    on = [F.col("__mask") == F.col("__tmask")] + [F.col(f"__k{i}").eqNullSafe(F.col(f"__t{i}")) for i in range(len(dims))]
    met = seg.join(term, on, "left").groupBy(*dims).agg(F.collect_list(F.struct("__mask", "__coef")).alias("__met"))

    def applying(mask: int) -> Column:
        """The distinct coefficients of one subset that apply to the segment; none is one null (adding nothing)."""
        found = F.array_distinct(F.transform(F.filter("__met", lambda p: (p["__mask"] == mask) & p["__coef"].isNotNull()), lambda p: p["__coef"]))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("double")))

    # Several coefficients of one subset give several rows: every choice of one coefficient a subset, as the stacked joins gave.
    def extend(choices: Column, options: Column) -> Column:
        return F.flatten(F.transform(choices, lambda chosen: F.transform(options, lambda c: F.concat(chosen, F.array(c)))))

    choices = reduce(extend, [applying(mask) for mask in masks], F.array(F.array().cast("array<double>")))
    rows = met.select(*dims, F.explode(choices).alias("__chosen")).distinct()
    total = F.aggregate("__chosen", F.lit(0.0), lambda acc, c: acc + F.coalesce(c, F.lit(0.0)))
    missing = F.raise_error(F.lit(f"there is no coefficient of {flag_term}"))
    base = F.coalesce(coefs.where(F.col("term") == flag_term).select("coef").scalar(), missing)
    return rows.select(*dims, (total + base).alias("effect"))
