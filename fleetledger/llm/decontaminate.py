"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check of the candidates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import bind
from fleetledger.session import written_once

SHINGLE = 5
_BLOCKS, _FLIPS = 8, 2  # bytes of a fingerprint, and the differing bits that are looked up in each
RADIUS = _BLOCKS * (_FLIPS + 1) - 1
_BROADCAST_ROWS = 500_000  # benchmark shingles of 20 bytes each

#: A SimHash over a column ``hashes``: how often each bit is set, then the bits set in over half.
_SIMHASH = """
transform(
  array(aggregate(hashes, array_repeat(0, 64), (n, h) -> transform(n, (c, i) -> c + cast(shiftright(h, i) & 1 AS int)))),
  n -> aggregate(sequence(0, 63), 0L, (f, i) -> f | if(2 * n[i] > size(hashes), shiftleft(1L, i), 0L))
)[0]
"""


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case: punctuation and line breaks don't hide a passage."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(ws: Column) -> Column:
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))

    return bind(ws, of)


def _shingles(ws: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ws) - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice(ws, i, SHINGLE)))


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = plain_words(F.col(text_col))
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), words.alias("words")).where(F.size("words") >= SHINGLE)
    items = items.distinct().withColumn("hashes", _hashes(F.col("words"))).withColumn("size", F.size("words"))
    return items.withColumn("fp", F.expr(_SIMHASH))


def _mark(text_col: str) -> Column:
    """Tells the texts of rows with equal ids apart."""
    return F.xxhash64(F.col(text_col))


def _windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, mark, spans): all item-sized windows [first, first + size) of each document that can be like an item of that size.

    For ``similarity`` s a window of m shingles must share s / (1 + s) * (m + those of the item) places with items of its size, at one
    shingle at least; wherever these places lie, in whatever order, each start from which all of them are inside is a window. Fewer
    places can't reach s, so none of interest is left out. Benchmark shingles are broadcast when a count shows that they are few;
    otherwise the join is a shuffled one.
    """
    places = items.select("size", F.explode("hashes").alias("h")).distinct()
    places = written_once(places, "benchmark-shingles")
    small = places.count() <= _BROADCAST_ROWS
    spread = docs.select("doc_id", "mark", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    hits = spread.join(F.broadcast(places) if small else places, "h")
    held = hits.groupBy("doc_id", "mark", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    whole = F.col("size") - (SHINGLE - 1)
    share = similarity / (1 + similarity)
    least = F.greatest(F.ceil(F.lit(share) * (F.least("n", whole) + whole) - F.lit(1e-9)), F.lit(1)).cast("int")
    held = held.withColumn("least", least).where(F.size("at") >= F.col("least")).withColumn("last", F.greatest(F.col("n") - whole, F.lit(0)))

    def runs(at: Column) -> Column:
        """Ranges of starts from which ``least`` places in a row are inside; both ends ascend."""
        every = F.sequence(F.lit(0), F.size(at) - F.col("least"))
        low = lambda i: F.greatest(F.get(at, i + F.col("least") - 1) - whole + 1, F.lit(0))
        return F.filter(F.transform(every, lambda i: F.struct(low(i).alias("low"), F.least(F.get(at, i), F.col("last")).alias("high"))), lambda x: x["low"] <= x["high"])

    def spreads(r: Column) -> Column:
        """All starts in the ranges, each once."""
        new = lambda x, i: F.greatest(x["low"], F.coalesce(F.get(r, i - 1)["high"] + 1, F.lit(0)))
        fresh = F.transform(r, lambda x, i: F.struct(new(x, i).alias("low"), x["high"].alias("high")))
        return F.flatten(F.transform(F.filter(fresh, lambda x: x["low"] <= x["high"]), lambda x: F.sequence(x["low"], x["high"])))

    firsts = bind(bind(F.col("at"), runs), spreads)
    distinct = held.select("doc_id", "mark", "size", F.explode(firsts).alias("first"))
    return distinct.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "size")).alias("spans"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    by_text: bool = False,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): documents with a window like a benchmark item, and the best such window.

    With ``by_text`` a ``mark`` column (xxhash64 of the text) follows the id, and rows with equal ids but different texts are reported
    apart; a stage that removes leaks anti-joins on both, so that a clean document never goes because it shares an id with a leak.

    A window has as many words as the item, or is the whole document if that is shorter. Its SimHash over five-word shingles is
    compared with the items of that size: each byte of a fingerprint is looked up with up to two bits flipped, which finds every pair
    at most 23 bits apart, as one of eight bytes then differs in two bits at most. Candidates are checked on their shingles'
    texts: the sum over all shingles of the smaller count, over that of the larger count, must reach ``similarity``.

    Null and empty texts have no window. Items of fewer than five words are not looked for. Documents with a null id are judged under
    that id; rows with equal ids count as one document. Other columns are ignored.
    """
    items = written_once(_items(benchmark, item_col, item_text_col), "items")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    hashed = texts.select("doc_id", "mark", _hashes(plain_words(F.col("text"))).alias("hashes"))
    spans = _windows(hashed, items, similarity).withColumnsRenamed({"doc_id": "id", "mark": "text_mark"})
    spans = written_once(spans, "windows")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text_mark"))
    found = texts.join(spans, same).select("doc_id", "mark", "spans", plain_words(F.col("text")).alias("all"))
    found = found.select(
        "doc_id",
        "mark",
        F.explode(
            bind(F.col("all"), lambda w: F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["size"].alias("size"), F.slice(w, s["first"] + 1, s["size"]).alias("words"))))
        ).alias("s"),
    )
    found = found.select("doc_id", "mark", "s.first", "s.size", "s.words").where(F.size("words") >= SHINGLE)
    found = written_once(found.withColumn("hashes", _hashes(F.col("words"))).withColumn("fp", F.expr(_SIMHASH)), "fingerprints")

    masks = [0, *(sum(1 << b for b in c) for k in range(1, _FLIPS + 1) for c in combinations(range(8), k))]
    keys = [F.struct(F.lit(i).alias("block"), _byte(i).bitwiseXOR(F.lit(m)).alias("value")) for i in range(_BLOCKS) for m in masks]
    index = items.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(F.array(*keys)).alias("k"))
    index = index.select("item_id", "size", "item_fp", "k.block", "k.value")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), _byte(i).alias("value")) for i in range(_BLOCKS)])
    probes = found.select("doc_id", "mark", "first", "size", "fp", F.explode(blocks).alias("k"))
    pairs = probes.select("doc_id", "mark", "first", "size", "fp", "k.block", "k.value").join(index, ["size", "block", "value"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = pairs.where(near).select("doc_id", "mark", "first", "size", "fp", "item_id").distinct()

    window = ["doc_id", "mark", "first", "size", "fp"]
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in window]
    named = pairs.alias("p").join(found.distinct().alias("w"), on).select("p.*", "w.words")
    counted = named.select(*window, "item_id", F.explode(_shingles(F.col("words"))).alias("shingle"))
    counted = counted.groupBy(*window, "item_id", "shingle").agg(F.count("*").alias("here"))
    wanted = items.select("item_id", "size", F.explode(_shingles(F.col("words"))).alias("shingle"))
    wanted = wanted.groupBy("item_id", "size", "shingle").agg(F.count("*").alias("there"))
    wanted = wanted.withColumnRenamed("size", "item_size").withColumnRenamed("item_id", "item")
    both = counted.join(
        wanted,
        F.col("item_id").eqNullSafe(F.col("item")) & (counted.shingle == wanted.shingle) & (F.col("size") == F.col("item_size")),
        "left",
    ).drop(wanted.shingle)
    totals = both.groupBy(*window, "item_id").agg(
        F.sum(F.least("here", F.coalesce("there", F.lit(0)))).alias("common"), F.sum("here").alias("n")
    )
    alike = F.col("common") / (F.col("n") + F.col("size") - (SHINGLE - 1) - F.col("common"))
    kept = totals.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("first", "size"), F.struct("similarity", -F.col("first"))).alias("best")
    key = ["doc_id", "mark"] if by_text else ["doc_id"]
    result = kept.groupBy(*key, "item_id").agg(F.max("similarity").alias("similarity"), best)
    return result.select(
        *key, "item_id", "similarity", F.col("best.first").cast("bigint").alias("first_word"), F.col("best.size").cast("bigint").alias("n_words")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The documents, with their columns, that hold no window like a benchmark item.

    A row goes only if its own text leaks: leaks are matched on the id (null-safe) and the hash of the text, so rows that share an id,
    a null one included, with a leak but hold another text stay.
    """
    found = contamination(docs, benchmark, id_col, text_col, similarity=similarity, by_text=True)
    leaks = written_once(found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "leaks")
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (_mark(text_col) == F.col("__mark"))
    return docs.join(leaks, same, "left_anti")
