"""Equi joins with the null rules the reports rely on.

No side is hinted as broadcast: whether a side is small is decided by Spark from its measured
size, and a hot key of a large side is split by the adaptive skew-join rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str]


def _pairs(keys: Sequence[Key]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in keys]


def _prepared(right: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """The right side with its keys under private names, so both sides can share column names."""
    private = [f"__key{i}" for i in range(len(pairs))]
    kept = [F.col(f"`{c}`") for c in right.columns if c not in {r for _, r in pairs}]
    return right.select(*kept, *[F.col(f"`{r}`").alias(p) for (_, r), p in zip(pairs, private)]), private


def _matches(pairs: list[tuple[str, str]], private: list[str], null_safe: bool) -> Column:
    def one(left: str, key: str) -> Column:
        a, b = F.col(f"`{left}`"), F.col(key)
        return a.eqNullSafe(b) if null_safe else a == b

    return reduce(and_, [one(left, key) for (left, _), key in zip(pairs, private)])


def key_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[Key],
    how: str = "left",
    null_safe: bool = True,
    keep_right_keys: bool = False,
) -> DataFrame:
    """Equi join on one or more keys; a key is a name or a ``(left, right)`` pair of names.

    With ``null_safe`` a null key meets a null key. The right keys are dropped unless
    ``keep_right_keys`` asks for them (only possible where their names differ from the left ones).
    """
    pairs = _pairs(keys)
    side, private = _prepared(right, pairs)
    clash = sorted((set(side.columns) - set(private)) & set(left.columns))
    if clash:
        raise ValueError(f"both sides have the columns {clash}")
    joined = left.join(side, _matches(pairs, private, null_safe), how)
    if not keep_right_keys:
        return joined.drop(*private)
    return joined.withColumnsRenamed({p: r for (_, r), p in zip(pairs, private)})


def left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[Key], null_safe: bool = True, keep_right_keys: bool = False
) -> DataFrame:
    """Every left row, with the matching right columns or nulls."""
    return key_join(left, right, keys, "left", null_safe, keep_right_keys)


def _membership(df: DataFrame, members: DataFrame, key: Key, how: str) -> DataFrame:
    pairs = _pairs([key])
    side, private = _prepared(members.select(pairs[0][1]).distinct(), pairs)
    return df.join(side, _matches(pairs, private, True), how)


def semi(df: DataFrame, members: DataFrame, key: Key) -> DataFrame:
    """Rows whose key is in the set; a null key is in it when the set holds null."""
    return _membership(df, members, key, "left_semi")


def anti(df: DataFrame, members: DataFrame, key: Key) -> DataFrame:
    """Rows whose key is not in the set; a null key stays unless the set holds null."""
    return _membership(df, members, key, "left_anti")
