"""Sorted hash arrays in the shared folder, written by Spark tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm.common import runs, starts
from fleetledger.session import scratch_path

_TYPES = {"bigint": "<i8", "int": "<i4", "double": "<f8", "float": "<f4"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def put(store: fs.FileSystem, path: str, values: np.ndarray) -> None:
    """Written beside its place and moved there, so that a repeated task leaves one whole file."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    store.move(beside, path)


def shard_bits(spark: SparkSession) -> int:
    """Leading bits of a hash that name its shard: about twice as many shards as shuffle partitions."""
    return max(1, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def new_folder(spark: SparkSession, name: str) -> str:
    folder = scratch_path(spark, name)
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    return folder


def write_arrays(df: DataFrame, name: str) -> HashArrays:
    """Store a table with a column ``key`` (64-bit hashes, signed; they may repeat) and numeric columns as sorted arrays.

    The memory of a task, which holds one shard, follows the number of shuffle partitions. Each column of a shard is a file of
    raw little-endian numbers under the shared folder; a repeated task writes the same files. The returned handle is small and
    can be sent to tasks.
    """
    spark = df.sparkSession
    folder, bits = new_folder(spark, name), shard_bits(spark)
    kinds = {c: _TYPES[t] for c, t in df.dtypes if c != "key"}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = place(folder)
        for groups in runs(batches, ["shard"]):
            cut, shard = starts(groups, ["shard"]), groups.column("shard").to_numpy()
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                rows = groups.slice(i, j - i)
                for c, kind in ({"key": "<i8"} | kinds).items():
                    put(disk, f"{root}/{shard[i]}.{c}", rows.column(c).to_numpy().astype(kind))
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["shard"])

    dealt = df.withColumn("shard", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "key")
    dealt.mapInArrow(write, "shard int").collect()  # no rows: the files are the result
    return HashArrays(folder, bits, kinds)


@lru_cache(maxsize=4096)
def _mapped(folder: str, file: str, kind: str) -> np.ndarray | None:
    """The array of a file; None if no key fell into its shard."""
    store, root = place(folder)
    path = f"{root}/{file}"
    if not store.get_file_info(path).size:  # no file, or an empty one, which can't be mapped
        return None
    if not isinstance(store, fs.LocalFileSystem):
        path = _fetched(store, path)
    return np.memmap(path, dtype=kind, mode="r")


def _fetched(store: fs.FileSystem, path: str) -> str:
    """A copy in the worker's own folder of a file that can't be mapped where it is."""
    own = os.path.join(tempfile.gettempdir(), path.strip("/").replace("/", "_"))
    if not os.path.exists(own):
        beside = f"{own}.{uuid.uuid4().hex}"
        fs.copy_files(path, beside, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        os.replace(beside, own)
    return own


class HashArrays:
    """Handle of stored arrays; workers map the shards that they look into."""

    def __init__(self, folder: str, bits: int, kinds: dict[str, str]):
        self.folder, self.bits, self.kinds = folder, bits, kinds

    def _column(self, shard: int, name: str) -> np.ndarray | None:
        return _mapped(self.folder, f"{shard}.{name}", "<i8" if name == "key" else self.kinds[name])

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _stored(self, shard: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(shard, from, to, stored keys) of ordered shard numbers."""
        cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            keys = self._column(int(shard[i]), "key")
            if keys is not None:
                yield int(shard[i]), i, j, keys

    def lookup(self, keys: np.ndarray, columns: list[str], shard: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each signed key whether it is stored, and the columns of its first row (0 where it is not).

        Distinct keys are looked up in order, so the pages of the arrays are touched one after another. ``shard`` is given where it does not
        follow from the key.
        """
        distinct, first, back = np.unique(keys.view(np.uint64), return_index=True, return_inverse=True)
        distinct = distinct.view(np.int64)
        if shard is None:
            shard, order = self.shard(distinct), slice(None)
        else:
            shard = shard[first]
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
        known = np.zeros(len(distinct), bool)
        values = [np.zeros(len(distinct), self.kinds[c]) for c in columns]
        wanted = distinct[order]
        found, got = np.zeros(len(distinct), bool), [np.zeros_like(v) for v in values]
        for number, i, j, stored in self._stored(shard):
            at = np.minimum(np.searchsorted(stored, wanted[i:j]), len(stored) - 1)
            hit = stored[at] == wanted[i:j]
            found[i:j] = hit
            for c, out in zip(columns, got):
                out[i:j][hit] = self._column(number, c)[at[hit]]
        known[order] = found
        for v, g in zip(values, got):
            v[order] = g
        return known[back], [v[back] for v in values]

    def matches(self, keys: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """All rows stored under the keys: for each the index of the key that it answers, and its columns."""
        order = np.argsort(keys.view(np.uint64), kind="stable")
        ordered = keys[order]
        owners, values = [np.zeros(0, np.int64)], [[np.zeros(0, self.kinds[c])] for c in columns]
        for number, i, j, stored in self._stored(self.shard(ordered)):
            lo, hi = np.searchsorted(stored, ordered[i:j], "left"), np.searchsorted(stored, ordered[i:j], "right")
            n = hi - lo
            rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            owners.append(np.repeat(order[i:j], n))
            for c, out in zip(columns, values):
                out.append(self._column(number, c)[rows])
        return np.concatenate(owners), [np.concatenate(v) for v in values]
