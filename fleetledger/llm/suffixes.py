"""Removal of byte strings that repeat across documents, with suffixes ordered by deep-shallow sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import runs
from fleetledger.llm.hasharrays import HashArrays, write_arrays
from fleetledger.session import written_once

_GRAM = 24  # bytes of an anchor
_CHUNK = 1 << 16  # bytes whose anchors are computed at a time
_SLICE = 4 << 20  # bytes of text that are worked on at a time where no rows are combined
_OUTSIDE = 0xFF  # no byte of UTF-8: stands for what lies outside a document
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _ODD1
    h ^= h >> np.uint64(29)
    h *= _ODD2
    h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, width: int, best: np.ufunc, pad: int) -> np.ndarray:
    """Of each run of ``width`` values from a position on, the ``best``: block-wise prefix and suffix scans."""
    n = len(values)
    rows = np.full((-(-n // width) + 1) * width, pad, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : n + width - 1])


class Texts:
    """The UTF-8 bytes of a batch's texts, end to end, with the place of each document."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("text")
        _, offsets, data = column.buffers()
        n = batch.num_rows
        at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        self.at = at - at[0]
        size = int(self.at[-1])
        self.data = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
        self._wide: np.ndarray | None = None

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram hashes of the anchors: in every window of ``length`` bytes within a document, the starts of
        the grams with the smallest hash.

        Equal windows have equal anchors at equal places, wherever they stand. Long documents are cut into pieces that overlap by
        more than a window on either side, which leaves the anchors as they are.
        """
        found = [self._chunk(lo, hi, length) for lo, hi in self._pieces(length)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([p for p, _ in found]), np.concatenate([g for _, g in found])

    def _pieces(self, length: int) -> Iterator[tuple[int, int]]:
        size, lo = len(self.data), 0
        while lo < size:
            hi = min(lo + _CHUNK, size)
            yield lo, hi
            lo = hi

    def _chunk(self, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = max(0, lo - 2 * length), min(len(self.data), hi + 2 * length)
        n, width = last - first, length - _GRAM + 1
        piece = np.zeros(n + _GRAM, np.uint8)
        piece[:n] = self.data[first:last]
        words = np.ndarray((n + _GRAM - 8,), "<u8", piece, strides=(1,))
        grams = np.zeros(n, np.uint64)
        for i in range(0, _GRAM, 8):
            grams = _mix(grams, words[i : n + i])
        grams |= np.uint64(1)
        inside = np.ones(n, bool)
        ends = self.at[1:]
        for end in np.unique(ends[np.searchsorted(ends, first, "right") : np.searchsorted(ends, last + length, "right")]) - first:
            inside[max(0, end - length + 1) : max(0, end)] = False
        inside[max(0, n - length + 1) :] = False
        least = np.where(inside, _sliding(grams, width, np.minimum, 2**64 - 1), np.uint64(0))
        before = np.concatenate([np.zeros(width - 1, np.uint64), least])
        chosen = np.flatnonzero(_sliding(before, width, np.maximum, 0)[:n] == grams)
        chosen = chosen[(chosen >= lo - first) & (chosen < hi - first)]
        return chosen + first, grams[chosen]

    def contexts(self, positions: np.ndarray, length: int) -> np.ndarray:
        """Rows of the bytes that windows over each anchor can cover, those outside its document marked."""
        if self._wide is None:
            margin = np.full(2 * length, _OUTSIDE, np.uint8)
            self._wide = np.concatenate([margin, self.data, margin])
        width = 2 * length - _GRAM
        rows = np.lib.stride_tricks.sliding_window_view(self._wide, width)[positions + (length + _GRAM)]
        doc = self.owners(positions)
        before, after = self.at[doc] - positions, self.at[doc + 1] - positions
        edge = np.flatnonzero((before > _GRAM - length) | (after < length))
        reach = np.arange(_GRAM - length, length)
        part = rows[edge]
        part[(reach < before[edge, None]) | (reach >= after[edge, None])] = _OUTSIDE
        rows[edge] = part
        return rows

    def owners(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1


def hash_rows(rows: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = _mix(h, words[:, i])
    return h.view(np.int64)


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Groups of equal strings (all of one length), in order, by a blind trie.

    A node is (depth, {byte: child}), a leaf a list of string numbers. A string is brought in by going down on the bytes at the
    nodes' depths only, comparing it once with the leaf reached, and branching at the first byte that differs.
    """
    top: list | tuple = [0]
    for number in range(1, len(strings)):
        s, node = strings[number], top
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth]) or next(iter(children.values()))
        other = strings[node[0]]
        if other == s:
            node.append(number)
            continue
        depth = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        above, node = None, top
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [number]
            continue
        branch = (depth, {s[depth]: [number], other[depth]: node})
        if above is None:
            top = branch
        else:
            above[1][s[above[0]]] = branch
    out: list[list[int]] = []
    todo = [top]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo.extend(child for _, child in sorted(node[1].items(), reverse=True))
        else:
            out.append(node)
    return out


def deep_shallow(data: np.ndarray, positions: np.ndarray, length: int, shallow: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at ``positions``, compared on ``length`` bytes, and for each in this order
    whether it equals the one before.

    Down to the ``shallow`` depth by multikey quicksort: groups equal so far are parted by their next eight bytes, all groups of a
    depth in one call. The groups left share a long prefix and are ordered by a blind trie on the rest; where all are equal, that
    trie is a single leaf.
    """
    n = len(positions)
    order, fresh = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, fresh
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    fresh[0] = True
    for depth in range(0, shallow, 8):
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        char = words[positions[order[open_]] + depth].astype(np.uint64)
        by = np.lexsort((char, group[open_]))
        order[open_] = order[open_][by]
        char = char[by]
        fresh[open_[1:]] |= (char[1:] != char[:-1]) | (np.diff(open_) != 1)
    if shallow >= length:
        return order, ~fresh
    cut = np.append(np.flatnonzero(fresh), n)
    size = np.diff(cut)
    group = np.repeat(np.arange(len(size)), size)
    open_ = np.flatnonzero(size[group] > 1)
    rest = data[positions[order[open_]][:, None] + np.arange(shallow, length)]
    differs = np.zeros(n, bool)
    differs[open_[1:]] = (rest[1:] != rest[:-1]).any(1) & (group[open_[1:]] == group[open_[:-1]])
    place = np.full(n, -1, np.int64)
    place[open_] = np.arange(len(open_))
    for g in np.unique(group[differs]):
        i, j = int(cut[g]), int(cut[g + 1])
        strings = [r.tobytes() for r in rest[place[i] : place[i] + j - i]]
        leaves = blind_trie(strings)
        members = order[i:j].copy()
        order[i:j] = members[[m for leaf in leaves for m in leaf]]
        at = i
        for leaf in leaves:
            fresh[at] = True
            at += len(leaf)
    return order, ~fresh


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about 4 MB of text."""
    for batch in batches:
        at, first = Texts(batch).at, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + _SLICE, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _grouped_min_max(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the smallest document for each distinct key, and the smallest and the largest document."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)) if len(k) else np.zeros(1, np.int64)
    return order[cut[:-1]], d[cut[:-1]], d[cut[1:] - 1] if len(k) else d


def _gram_rows(length: int):
    """The smallest and the largest document that a batch has for each gram, as a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch)
            positions, grams = texts.anchors(length)
            docs = batch.column("doc_id").to_numpy()[texts.owners(positions)]
            row, lo, hi = _grouped_min_max(grams, docs)
            keys, more = grams[row].view(np.int64), lo != hi
            columns = [pa.array(np.append(keys, keys[more])), pa.array(np.append(lo, hi[more]))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id"])

    return run


def _shared_anchors(batch: pa.RecordBatch, length: int, shared: HashArrays) -> tuple[Texts, np.ndarray, ...]:
    """The texts of a batch, and of each anchor with a shared gram its position, gram, context hash and document."""
    texts = Texts(batch)
    positions, grams = texts.anchors(length)
    known, _ = shared.lookup(grams.view(np.int64), [])
    positions, grams = positions[known], grams[known].view(np.int64)
    parts = [hash_rows(texts.contexts(positions[i : i + 50_000], length)) for i in range(0, len(positions), 50_000)]
    hashes = np.concatenate([np.zeros(0, np.int64), *parts])
    return texts, positions, grams, hashes, texts.owners(positions)


def _context_rows(length: int, shared: HashArrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # whole batches: equal contexts become one row
            _, _, grams, hashes, owner = _shared_anchors(batch, length, shared)
            row, lo, hi = _grouped_min_max(hashes, batch.column("doc_id").to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams[row], hashes[row], lo, hi)], ["gram", "key", "lo", "hi"])

    return run


def _context_bytes(length: int, shared: HashArrays, mixed: HashArrays):
    """Each context to compare, once, with its bytes: from the first document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, positions, grams, hashes, owner = _shared_anchors(batch, length, shared)
            wanted, (lo, hi, n) = mixed.lookup(hashes, ["lo", "hi", "n"])
            mine = np.flatnonzero(wanted & (batch.column("doc_id").to_numpy()[owner] == lo))
            mine = mine[np.unique(hashes[mine], return_index=True)[1]]
            for i in range(0, len(mine), 20_000):
                own = mine[i : i + 20_000]
                around = pa.array([r.tobytes() for r in texts.contexts(positions[own], length)], pa.binary())
                columns = [pa.array(x[own]) for x in (grams, hashes, lo, hi, n)]
                yield pa.RecordBatch.from_arrays([*columns, around], ["gram", "key", "lo", "hi", "n", "around"])

    return run


def _decided(length: int):
    """For contexts in whole groups: which windows of a context stand in a document, and in which at the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in runs(batches, ["gram", "salt"]):
            key, lo, hi, gram = (groups.column(c).to_numpy() for c in ("key", "lo", "hi", "gram"))
            first, salt = groups.column("first").to_numpy(), groups.column("salt").to_numpy()
            around = groups.column("around").to_pylist()
            # one row for each context and part of it
            order = np.lexsort((lo, first, key))
            fresh = np.append(True, (np.diff(key[order]) != 0) | (np.diff(first[order]) != 0))
            cut = np.flatnonzero(fresh)
            last = np.maximum.reduceat(hi[order], cut)
            rows = order[cut]
            key, lo, first, gram, salt = key[rows], lo[rows], first[rows].astype(np.int64), gram[rows], salt[rows]
            sizes = np.array([len(around[r]) for r in rows], np.int64)
            data = np.frombuffer(b"".join(around[r] for r in rows), np.uint8)
            base = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            owner = np.repeat(np.arange(len(rows)), windows)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            outside = np.cumsum(np.append(0, data == _OUTSIDE))
            start = base[owner] + offset
            whole = outside[start + length] == outside[start]
            owner, offset, start = owner[whole], offset[whole], start[whole]
            earliest = lo[owner].copy()
            # only contexts that are not alone in their group can share a window with another one
            pair = np.lexsort((salt, gram))
            same = np.append(False, (np.diff(gram[pair]) == 0) & (np.diff(salt[pair]) == 0))
            together = np.zeros(len(rows), bool)
            together[pair] = same | np.append(same[1:], False)
            mixed = np.flatnonzero(together[owner])
            by, equal = deep_shallow(data, start[mixed], length)
            by = mixed[by]
            if len(by):
                heads = np.flatnonzero(~equal)
                low = np.minimum.reduceat(earliest[by], heads)
                earliest[by] = np.repeat(low, np.diff(np.append(heads, len(by))))
            useful = (earliest < lo[owner]) | (last[owner] > lo[owner])
            owner, offset, earliest = owner[useful], offset[useful], earliest[useful]
            order = np.lexsort((earliest, owner))
            if not len(order):
                continue
            owner, earliest = owner[order], earliest[order]
            bit = np.int64(1) << (offset[order] + first[owner])
            cut = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(earliest) != 0)))
            columns = (key[owner[cut]], earliest[cut], np.bitwise_or.reduceat(bit, cut))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "source", "mask"])

    return run


def _spread(contexts: DataFrame, length: int, group_limit: int) -> DataFrame:
    """Contexts with the group they are compared in. A gram with over ``group_limit`` contexts is dealt out window by window,
    by the window's hash, so equal windows still meet and no task gets the whole group."""
    hot = F.col("n") > group_limit
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("around").alias("part")))
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(length - _GRAM)),
        lambda i: F.struct(i.alias("first"), F.substring(F.col("around"), i + 1, F.lit(length)).alias("part")),
    )
    parts = contexts.withColumn("w", F.explode(F.when(hot, windows).otherwise(whole)))
    slices = F.ceil(F.col("n") * (length - _GRAM + 1) / group_limit)
    salt = F.when(hot, F.pmod(F.xxhash64("w.part"), slices)).otherwise(-1).cast("int")
    return parts.select("gram", salt.alias("salt"), "key", "lo", "hi", F.col("w.first").alias("first"), F.col("w.part").alias("around"))


def _cut(length: int, shared: HashArrays, decided: HashArrays, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, positions, _, hashes, owner = _shared_anchors(batch, length, shared)
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()[owner]
            begins = np.zeros(len(texts.data), bool)
            for i in range(0, len(positions), 50_000):
                at, (source, mask) = decided.matches(hashes[i : i + 50_000], ["source", "mask"])
                earlier = source < ids[i + at]
                at, mask = i + at[earlier], mask[earlier]
                lowest, highest = texts.at[owner[at]], texts.at[owner[at] + 1] - length
                for bit in range(length - _GRAM + 1):
                    start = positions[at] - (length - _GRAM) + bit
                    begins[start[(mask >> bit & 1 == 1) & (start >= lowest) & (start <= highest)]] = True
            n = len(begins)
            count = np.cumsum(np.append(False, begins), dtype=np.int32)
            edge = min(length - 1, n)
            gone = np.append(count[1 : edge + 1] > 0, count[edge + 1 :] != count[: n - edge])
            kept, spans, removed = [], [], []
            for i, j in zip(texts.at[:-1].tolist(), texts.at[1:].tolist()):
                mask = gone[i:j]
                removed.append(int(np.count_nonzero(mask)))
                if not removed[-1]:
                    kept.append(texts.data[i:j].tobytes())
                    spans.append([])
                    continue
                kept.append(texts.data[i:j][~mask].tobytes())
                change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"first": a, "last": b} for a, b in change.reshape(-1, 2).tolist()])
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            columns = [
                batch.column("row"), batch.column("doc_id"), pa.array(np.diff(texts.at)), pa.array(removed, pa.int64()),
                pa.array(spans, span),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    group_limit: int = 20_000,
    as_text: bool = False,
) -> DataFrame:
    """Every document without the bytes that a ``length``-byte string covers which also starts in a document with a
    smaller id; strings are judged on the texts as given, as UTF-8, and do not cross documents.

    Returns (row, doc_id, n_bytes, n_removed, spans, kept): ``row`` is a struct of all other columns of the document, ``spans`` are the
    maximal removed runs [first, last), ``kept`` the remaining bytes, or with ``as_text`` their text, without the bytes left of a
    character that is cut in two. A null text is empty. A document with a null id neither gives nor loses bytes;
    rows with equal ids do not take from each other. An empty table gives no rows.

    1. Anchors: of the 24-byte grams in each window those with the smallest hash; equal windows have equal anchors. Grams
       that two documents have are stored as sorted hash arrays.
    2. Around each such anchor the bytes that a window over it can cover are one context, known by its hash. Where all documents
       have the same context for a gram, all but the first have its windows from the first.
    3. Otherwise the gram's different contexts meet in a task with their bytes. Their windows, as suffixes, are put in order by
       deep-shallow sorting, and equal neighbours tell the earliest document of each window.
    4. A last pass looks up its contexts and marks the windows that an earlier document has.

    Texts are not shuffled. Contexts are identified by 64-bit hashes, windows within a group by their bytes. ``length`` may be 25 to 86.
    """
    if not _GRAM < length < _GRAM + 63:
        raise ValueError("length must be 25 to 86")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    named = rows.select("doc_id", "text").where("doc_id IS NOT NULL")
    grams = named.mapInArrow(_gram_rows(length), "key bigint, doc_id bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a batch's grams hardly repeat in another one of its task, so they are dealt out as they are
    both = grams.repartition(parts, "key").groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    shared = write_arrays(both.select("key"), "shared-grams")
    found = named.mapInArrow(_context_rows(length, shared), "gram bigint, key bigint, lo bigint, hi bigint")
    contexts = written_once(found.groupBy("gram", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "contexts")
    groups = contexts.groupBy("gram").agg(
        F.count("*").alias("n"), F.min("key").alias("key"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    alone = groups.where("n = 1 AND lo < hi").select("key", F.col("lo").alias("source"), F.lit((1 << length - _GRAM + 1) - 1).cast("bigint").alias("mask"))
    several = contexts.join(groups.where("n > 1").select("gram", "n"), "gram").select("key", "lo", "hi", "n")
    mixed = write_arrays(several, "mixed-contexts")
    schema = "gram bigint, key bigint, lo bigint, hi bigint, n bigint, around binary"
    compared = _spread(named.mapInArrow(_context_bytes(length, shared, mixed), schema), length, group_limit)
    dealt = compared.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt")
    sorted_ = dealt.mapInArrow(_decided(length), "key bigint, source bigint, mask bigint")
    decided = write_arrays(sorted_.union(alone), "windows")
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept {'string' if as_text else 'binary'}"
    return rows.mapInArrow(_cut(length, shared, decided, as_text), schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """The documents with their columns in place, the text cut to what is kept, and ``n_chars``, if there is one, its length.

    No row is dropped, and a text that loses nothing stays as it is, null included.
    """
    found = remove_repeats(docs.withColumn("__none", F.col(text_col).isNull()), id_col, text_col, length, as_text=True)
    text = F.when(~F.col("row.__none"), F.col("kept"))
    new = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: text}
    if "n_chars" in docs.columns:
        cut = F.col("n_removed") > 0
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
