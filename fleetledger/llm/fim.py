"""Fill-in-the-middle: cut each text at two token boundaries and move the middle to the end.

The token ends of a text form a Roaring-style set: offsets split into 65,536-wide containers by their high bits, each held as a sorted array,
a bitmap or a list of runs, whichever is smallest, with the cumulative cardinality of the containers before it. The k-th boundary is found
by a binary search over the cumulative cardinalities and a select inside one container; both cut offsets of a text come from it.

Rows are independent, so the work is an Arrow-batched pandas UDF over the documents as they are read: no shuffle, and a lost executor recomputes its
partitions only. The draws are hashes of the document id computed in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: the sentinels between the parts, and the white space that separates tokens.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE_POINTS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_ARRAY_MAX = 4096
_BITMAP_BYTES = 8192


class Boundaries:
    """A set of distinct offsets below 2**32 in Roaring-style containers.

    ``keys`` are the high 16 bits of each container, ``cumulative[i]`` the number of offsets in containers 0..i. A container is
    ``("array", uint16 values)``, ``("bitmap", uint64[1024] words, cumulative popcount of the words)`` or
    ``("run", starts, cumulative run lengths)``; the kind is the one with the fewest bytes (an array holds at most 4,096 values).
    """

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, dtype=np.uint32)
        high = offsets >> 16
        low = (offsets & 0xFFFF).astype(np.int32)
        keys, first = np.unique(high, return_index=True)
        ends = np.append(first[1:], len(offsets))
        self.keys = keys
        self.cumulative = ends.astype(np.int64)
        self.containers = [self._container(low[a:b]) for a, b in zip(first, ends)]

    @staticmethod
    def _container(values: np.ndarray) -> tuple:
        steps = np.flatnonzero(np.diff(values) != 1) + 1
        run_starts = np.concatenate(([0], steps))
        sizes = {"bitmap": _BITMAP_BYTES, "run": 2 + 4 * len(run_starts)}
        if len(values) <= _ARRAY_MAX:
            sizes["array"] = 2 * len(values)
        kind = min(sizes, key=lambda k: (sizes[k], k))
        if kind == "array":
            return ("array", values.astype(np.uint16))
        if kind == "run":
            lengths = np.diff(np.append(run_starts, len(values)))
            return ("run", values[run_starts].astype(np.int64), np.cumsum(lengths))
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[values] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=1)
        return ("bitmap", words, np.cumsum(counts))

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    @property
    def kinds(self) -> list[str]:
        return [c[0] for c in self.containers]

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones (0-based)."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.cumulative, rank, side="right"))
        local = rank - (int(self.cumulative[at - 1]) if at else 0)
        return (int(self.keys[at]) << 16) | self._local(self.containers[at], local)

    @staticmethod
    def _local(container: tuple, rank: int) -> int:
        kind = container[0]
        if kind == "array":
            return int(container[1][rank])
        if kind == "run":
            starts, through = container[1], container[2]
            run = int(np.searchsorted(through, rank, side="right"))
            return int(starts[run]) + rank - (int(through[run - 1]) if run else 0)
        words, through = container[1], container[2]
        word = int(np.searchsorted(through, rank, side="right"))
        inside = rank - (int(through[word - 1]) if word else 0)
        bits = np.flatnonzero(np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(bits[inside])

    def cut(self, units: int) -> int:
        """The offset after the first ``units`` members: 0 for none."""
        return self.select(units - 1) if units else 0


def token_ends(text: str) -> np.ndarray:
    """Code-point offsets at which the tokens ``[ws]*[^ws]+`` or ``[ws]+`` end, matched left to right (ws: space, tab to CR)."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = np.isin(points, _SPACE_POINTS)
    word_end = ~space & np.append(space[1:], True)
    ends = np.flatnonzero(word_end) + 1
    if space[-1]:
        ends = np.append(ends, len(points))
    return ends.astype(np.uint32)


def arrange(text: str, h: tuple[int, int, int, int], *, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text.

    ``n`` tokens; the prefix ends after min(h1, h2) mod (n+1) tokens and the middle after the larger. The form is ``plain`` for an empty
    text, one holding a sentinel, or h3 mod 100 >= ``rate``; else ``spm`` if h4 mod 100 < ``spm``, otherwise ``psm``.
    """
    bounds = Boundaries(token_ends(text))
    n = len(bounds)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = bounds.cut(lo), bounds.cut(hi)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1..h4: the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id`` as unsigned integers (a null id hashes ``seed:``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"_h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row a document: id, ``n`` tokens, ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars`` (code points; null when
    plain) and the ``output`` text.

    A null text is empty (n 0, plain). A null id draws from ``seed:``. Repeated rows give repeated, equal results; other columns of
    ``docs`` are left out, so their names cannot clash. Long texts are cut whole: the containers hold every boundary.
    """
    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    @F.pandas_udf(schema)
    def arranged(text: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        out = [arrange(t, h, rate=rate, spm=spm) for t, *h in zip(text, h1, h2, h3, h4)]
        frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"], index=text.index)
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), arranged(text, *draws(F.col(id_col), seed)).alias("_fim")).select(id_col, "_fim.*")

def restored(output: Column, form: Column) -> Column:
    """The text again from a FIM output and its form: prefix, middle and suffix between the sentinels put back in order."""
    body = F.substring(output, 4, 1 << 30)
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substring(body, F.length(first) + 4, 1 << 30)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(second) + 4, 1 << 30)
    whole = F.when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
    return F.when(form == "plain", output).otherwise(whole)
