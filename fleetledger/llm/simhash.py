"""Near duplicates by SimHash: fingerprints, and links found with BK-trees over shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import lists, runs, shingle_hashes, starts, words
from fleetledger.llm.graph import components
from fleetledger.session import written_once

_BLOCK = 1 << 16  # hashes whose bits are counted at a time
_SHARD = ["combo", "part", "lo", "hi"]


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those set in over half of ``hashes``; 0 for none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[i : i + _BLOCK])
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, values = lists(batch.column("hashes"))
        prints = [majority(values[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64()), batch.column("hash")], ["doc_id", "fp", "hash"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of each text over its word shingles, repeats counted, as a signed 64-bit number.

    Words are separated by ASCII white space with A-Z in lower case. A null or blank text has fingerprint zero, a text with fewer
    words than a shingle is one shingle. Rows are kept one to one: repeated rows and null ids stay; other columns
    are ignored.
    """
    return _hashed_prints(docs, id_col, text_col, shingle, F.lit(None)).select("doc_id", "fp")


def _hashed_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, mark: Column) -> DataFrame:
    """``simhash`` with ``mark`` of each row as column ``hash``."""
    hashed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), shingle_hashes(words(F.col(text_col)), shingle).alias("hashes"), mark.cast("string").alias("hash")
    )
    return hashed.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, hash string")


class BKTree:
    """Numbers under their Hamming distance: the children of a node are keyed by their distance to it."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self._add(v)

    def _add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the values at most ``radius`` away; only edges that the triangle inequality allows are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                todo.extend(i for k, i in children.items() if d - radius <= k <= d + radius)
        return found


def _linked(tree: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """Star-shaped links that connect what links inside a shard: a spanning set, not all pairs."""
    index = BKTree(tree)
    parent = list(range(len(tree) + len(others)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    queries = others or tree
    shift = len(tree) if others else 0
    for q, value in enumerate(queries):
        mine = root(q + shift)
        for i in index.within(value, radius):
            r = root(i)
            if r != mine:
                parent[max(r, mine)] = mine = min(r, mine)
    values = tree + others
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in runs(batches, _SHARD):
            cut = starts(groups, _SHARD)
            fps, own, lo, hi = (groups.column(c).to_numpy() for c in ("fp", "own", "lo", "hi"))
            links: list[tuple[int, int]] = []
            for i, j in zip(cut[:-1], cut[1:]):
                if j - i < 2:
                    continue
                member, side = fps[i:j], own[i:j] == lo[i]
                if lo[i] == hi[i]:
                    links += _linked(member.tolist(), [], radius)
                else:
                    links += _linked(member[side].tolist(), member[~side].tolist(), radius)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*links)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())])
                )

    return search


def _masks(radius: int) -> list[int]:
    """Bit masks of every two of radius + 2 blocks: numbers at most ``radius`` bits apart agree on one of them at least."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def near_links(prints: DataFrame, radius: int = 4, tree_size: int = 1024) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` at most ``radius`` bits apart, directly or through others.

    Fingerprints that agree on two of radius + 2 blocks form a shard; by the pigeonhole principle any two within the radius share
    a shard, so nothing is lost. A BK-tree is built for each shard and sent with the shard's queries to a task of
    its own. A Spark broadcast variable would have to hold all fingerprints, which has no bound. A shard of over ``tree_size``
    fingerprints is cut into trees of that size, each paired with each slice of the queries in a task group of its own.
    """
    combos = [F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(_signed(m)).alias("part")) for i, m in enumerate(_masks(radius))]
    keyed = prints.select("fp", F.explode(F.array(*combos)).alias("k")).select("fp", "k.combo", "k.part")
    sizes = keyed.groupBy("combo", "part").agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / tree_size).cast("int")
    placed = keyed.join(sizes, ["combo", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), slices).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = placed.select("fp", "own", "combo", "part", lo.alias("lo"), hi.alias("hi"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *_SHARD).sortWithinPartitions(*_SHARD)
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id) for every document: documents whose fingerprints differ in at most ``radius`` bits
    link, and component_id is the smallest doc_id reachable over links, the document's own included.

    Equal fingerprints, as those of copies or of all empty texts, become one node before any search. Documents with a null id
    are fingerprinted and pass links on, but a null is never the smallest id unless no other is in reach.
    Repeated rows come back repeated. An empty table gives no rows.
    """
    prints = written_once(simhash(docs, id_col, text_col, shingle), "simhash")
    return _labelled(prints, radius).select("doc_id", "fp", "component_id")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` with the smallest fingerprint and the smallest doc_id of the component: columns ``root`` and ``component_id``."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents that stay, with all their columns: of each component the document with the smallest id.

    Of repeated rows with that id, or of all rows of a component of null ids only, one stays: that with the smallest fingerprint and text.
    """
    text = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    rows = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__text": text})
    prints = written_once(_hashed_prints(docs, id_col, text_col, shingle, text), "simhash")
    firsts = _labelled(prints, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # the component is told by its root fingerprint: those of null ids only have the same component_id
    kept = firsts.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "hash")).alias("k"), F.count("*").alias("count"))
    kept = written_once(kept.select(F.col("k.doc_id").alias("__i"), F.col("k.hash").alias("__h"), "count"), "kept")
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__text").eqNullSafe(F.col("__h"))
    stay = rows.join(kept.select("__i", "__h"), same, "left_semi")
    if not kept.where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["__id", "__text"])
    return stay.drop("__id", "__text")
