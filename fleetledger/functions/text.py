"""Text predicates and cleanups as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Version suffixes that may be attached to a contract number.
CONTRACT_SUFFIXES = r"(_EXP[1-6]|_EXP|_REP|_OLD)"
# Prefixes stripped from serial numbers.
SERIAL_PREFIXES = ("GEJ-", "JEN-")



def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def any_term(col: Column | str, terms: Sequence[str], case: str | None = None) -> Column:
    """True where the text holds any of the literal terms; null text gives null.

    ``case`` is ``"lower"``, ``"upper"`` (fold both sides) or ``None`` (compare as written).
    """
    if not terms:
        return F.lit(False)
    text = _column(col)
    if case == "lower":
        text, terms = F.lower(text), [t.lower() for t in terms]
    elif case == "upper":
        text, terms = F.upper(text), [t.upper() for t in terms]
    elif case is not None:
        raise ValueError(f"unknown case rule: {case}")
    return reduce(or_, [text.contains(F.lit(t)) for t in terms])


def text_class(
    col: Column | str, include: Sequence[str], exclude: Sequence[str], case: str | None = "upper"
) -> Column:
    """True where an include term occurs and no exclude term does; null text is not in the class."""
    hit = any_term(col, include, case) & ~any_term(col, exclude, case)
    return F.coalesce(hit, F.lit(False))


def lacks_marker(col: Column | str, marker: str) -> Column:
    """True where the marker is absent; a null text does not hold the marker."""
    return ~F.coalesce(_column(col).contains(F.lit(marker)), F.lit(False))


def normalize_serial(col: Column | str) -> Column:
    """Serials with an underscore stay as they are, others keep their digits; nothing left is null."""
    text = _column(col).cast("string")
    digits = F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))
    return F.when(text.contains("_"), text).otherwise(digits)


def strip_contract_suffix(col: Column | str) -> Column:
    """Remove version suffixes wherever they occur in a contract number."""
    return F.regexp_replace(_column(col), CONTRACT_SUFFIXES, "")


def strip_literals(col: Column | str, literals: Sequence[str]) -> Column:
    """Remove each literal, in the given order."""
    return reduce(lambda text, item: F.replace(text, F.lit(item), F.lit("")), literals, _column(col))


def first_match(col: Column | str, keywords: Sequence[str]) -> Column:
    """The first keyword of the list (list order is the priority) that occurs in the text, else null."""
    text = _column(col)
    if not keywords:
        return F.lit(None).cast("string")
    listed = F.array(*[F.lit(k) for k in keywords])
    return F.get(F.filter(listed, lambda k: F.contains(text, k)), F.lit(0))


def count_token(col: Column | str, token: str) -> Column:
    """How often the literal token occurs in the text, without overlaps."""
    return F.regexp_count(_column(col), F.lit(rf"\Q{token}\E"))


def as_label(col: Column | str, data_type: str) -> Column:
    """Text form of a value; whole floating-point numbers print as integers at any magnitude."""
    value = _column(col)
    if data_type in ("double", "float"):
        whole = value == F.floor(value)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")
