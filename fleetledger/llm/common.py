"""Expressions and helpers that several operators use."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case; no word for a null or blank text."""
    lowered = F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase + _SPACES, string.ascii_lowercase + " " * len(_SPACES)
    )
    return F.array_remove(F.split(lowered, " "), "")


def held_out_fold(doc_id: Column, folds: int, which: int) -> Column:
    """Whether a document's crc32 puts it into the fold; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == which, F.lit(False))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(ws: Column, size: int) -> Column:
    """XXH64 of every run of ``size`` words joined by a space; of the whole sequence if it is shorter, none if empty."""

    def of(w: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [w[i]]
            for k in range(1, size):
                parts += [F.lit(" "), w[i + k]]
            return F.xxhash64(F.concat(*parts))

        whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), one)
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) == 0, none).when(F.size(w) <= size, whole).otherwise(runs)

    return bind(ws, of)


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column without null elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets, column.values.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: many groups in each, none cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts(groups: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the groups of a sorted table begin, and its length at the end."""
    change = np.ones(groups.num_rows, bool)
    change[1:] = False
    for k in keys:
        column = groups.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), groups.num_rows)
