"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays that workers map."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import lists, runs, starts, words
from fleetledger.llm.hasharrays import HashArrays, new_folder, place, put, shard_bits, write_arrays
from fleetledger.session import written_once


def _mark(name: str) -> int:
    """The number of a token that is no word: words hold no space."""
    return xxhash.xxh64_intdigest(f" {name}", seed=42) - (1 << 63)


START, END = _mark("start"), _mark("end")
_COMBINED = 1 << 21  # tokens whose counts are combined before they are shuffled
_SCORED = 1 << 18  # tokens that are looked up at a time
_SMALL = 255  # a pair count from here on is stored apart
_STATS = ["total", "n1", "n2", "n3", "exactly3", "exactly4", "cont"]


def _parts(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch in slices of about ``limit`` tokens at most, at least one document each: the slice, the token before,
    the token, and where each document's tokens begin (with the number of all at the end)."""
    at, tokens = lists(batch.column("tokens"))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        n = np.diff(at[first : last + 1])
        begin = np.append(0, np.cumsum(n + 1))
        before, token = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
        inner = np.ones(begin[-1], bool)
        inner[begin[1:] - 1] = False
        token[inner], token[~inner] = tokens[at[first] : at[last]], END
        before[1:] = token[:-1]
        before[begin[:-1]] = START
        yield slice(first, last), before, token, begin
        first = last


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h ^ token.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, token, begin in _parts(batch, _COMBINED):
            word, n = np.unique(token, return_counts=True)
            columns = [pa.array(np.append(word, START)), pa.array(np.append(n, len(begin) - 1))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


def _shards(before: np.ndarray, keys: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Pairs are stored by their first token, those of a hot one by the whole pair."""
    by = np.where(np.isin(before, hot), keys, before).view(np.uint64)
    return (by >> np.uint64(64 - bits)).astype(np.int64)


def _pair_counts(bits: int, hot: np.ndarray):
    """Pairs of a batch with their counts, ordered so that rows of a first token follow one another and compress well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, before, token, _ in _parts(batch, _COMBINED):
                order = np.lexsort((token, before))
                before, token = before[order], token[order]
                cut = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (token[1:] != token[:-1])))
                n = np.diff(np.append(cut, len(order)))
                before, token = before[cut], token[cut]
                for i in range(0, len(cut), 200_000):
                    v, w = before[i : i + 200_000], token[i : i + 200_000]
                    shard = _shards(v, pair_keys(v, w), bits, hot).astype(np.int32)
                    columns = [pa.array(x) for x in (shard, v, w, n[i : i + 200_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "before", "token", "n"])

    return run


def _stored(folder: str, apart: str):
    """Writes the pair counts of whole shards and returns what they add to the statistics of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(folder)
        _, beside = place(apart)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for groups in runs(batches, ["shard"]):
            cut, shard = starts(groups, ["shard"]), groups.column("shard").to_numpy()
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                rows = groups.slice(i, j - i)
                before, token, n = (rows.column(c).to_numpy() for c in ("before", "token", "n"))
                keys = pair_keys(before, token)
                order = np.argsort(keys)
                keys = keys[order]
                heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n, keys = np.add.reduceat(n[order], heads), keys[heads]
                before, token = before[order[heads]], token[order[heads]]
                large = n >= _SMALL
                put(store, f"{beside}/{shard[i]}.n", n[large].astype("<i8"))
                put(store, f"{beside}/{shard[i]}.key", keys[large])
                put(store, f"{root}/{shard[i]}.n", np.minimum(n, _SMALL).astype("<u1"))
                put(store, f"{root}/{shard[i]}.key", keys)
                word, of = np.unique(before, return_inverse=True)
                sums = [np.bincount(of, x, len(word)) for x in (n, n == 1, n == 2, n > 2, n == 3, n == 4)]
                yield _stats(word, [*sums, np.zeros(len(word))])
                seen.append(np.unique(token, return_counts=True))
                if sum(len(w) for w, _ in seen) > _COMBINED:
                    seen = [_merged(seen)]
        if seen:
            word, cont = _merged(seen)
            yield _stats(word, [np.zeros(len(word))] * 6 + [cont])

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, of = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return word, np.bincount(of, np.concatenate([n for _, n in parts]), len(word)).astype(np.int64)


def _stats(word: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(word), *(pa.array(c.astype(np.int64)) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, ["word", *_STATS])


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and over 2, from the numbers of things counted 1 to 4 times.

    Each is kept within 0.1 and its count, so that every context gives some mass to words not seen after it.
    """
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a else float(k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.1), float(k)) for k, d in enumerate(raw, 1)]


def _discounted(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(n - np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])), 0.0)


@dataclass
class Model:
    """Handle of a stored model, small enough to be sent to tasks."""

    words: HashArrays
    pairs: HashArrays
    large: HashArrays
    hot: np.ndarray
    tokens: int
    vocabulary: int
    unknown: float
    discount: list[float]

    def log10(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token after another: log10 of its probability, and its count in training (0: unknown).

        p(w|v) = max(c(vw) - D, 0) / c(v) + gamma(v) p(w), where p(w) counts the different words before w, discounted in turn
        and interpolated with a uniform choice among all words and one unknown word.
        """
        known, (count, alone) = self.words.lookup(token, ["n", "alone"])
        alone = np.where(known, alone, self.unknown)
        seen, (total, gamma) = self.words.lookup(before, ["total", "gamma"])
        keys = pair_keys(before, token)
        shard = _shards(before, keys, self.pairs.bits, self.hot)
        pair, (n,) = self.pairs.lookup(keys, ["n"], shard)
        n = n.astype(np.float64)
        large = np.flatnonzero(n == _SMALL)
        n[large] = self.large.lookup(keys[large], ["n"], shard[large])[1][0]
        seen &= total > 0
        high = np.where(pair, _discounted(n, self.discount), 0.0) / np.where(seen, total, 1)
        return np.log10(np.where(seen, high + gamma * alone, alone)), count


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hashed = F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), hashed.alias("tokens"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count all given texts into a model. A null text is an empty one: just an end. No text at all gives a uniform model.

    Words and pairs are combined within each task before they are shuffled, so a frequent word or pair is one row a task. Pairs are dealt
    out by their first word. A first word with more tokens than a partition's share is dealt out by the whole pair; there are at
    most as many such words as partitions, and only they are brought to the driver.
    """
    spark = docs.sparkSession
    parts, bits = int(spark.conf.get("spark.sql.shuffle.partitions")), shard_bits(spark)
    tokens = _tokens(docs, id_col, text_col)
    partial = tokens.mapInArrow(_word_counts, "word bigint, n bigint")
    counts = written_once(partial.groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = counts.where(F.col("word") != START).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = np.array([r.word for r in counts.where(F.col("n") > max(size.n // parts, 1000)).select("word").collect()], np.int64)
    folder, apart = new_folder(spark, "pairs"), new_folder(spark, "large-pairs")
    pairs = tokens.mapInArrow(_pair_counts(bits, hot), "shard int, before bigint, token bigint, n bigint")
    pairs = pairs.repartition(parts, "shard").sortWithinPartitions("shard")
    stats = pairs.mapInArrow(_stored(folder, apart), ", ".join(f"{c} bigint" for c in ("word", *_STATS)))
    zero = [F.lit(0).cast("bigint").alias(c) for c in _STATS]
    every = stats.withColumn("n", F.lit(0).cast("bigint")).unionByName(counts.select("word", "n", *zero))
    merged = every.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *_STATS)])
    merged = written_once(merged, "word-statistics")
    cont = [F.count_if(F.col("cont") == k) for k in (1, 2, 3, 4)] + [F.count_if(F.col("cont") > 2), F.sum("cont")]
    found = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "exactly3", "exactly4")], *cont).first()
    high, low = discounts(list(found[:4])), discounts(list(found[4:8]))
    different = found[9] or 0
    spare = (low[0] * found[4] + low[1] * found[5] + low[2] * found[8]) / different if different else 1.0
    unknown = spare / (size.v + 1)
    d = F.when(F.col("cont") == 1, low[0]).when(F.col("cont") == 2, low[1]).otherwise(low[2])
    kept = F.greatest(F.col("cont") - d, F.lit(0.0)) / F.lit(float(max(different, 1)))
    gamma = (high[0] * F.col("n1") + high[1] * F.col("n2") + high[2] * F.col("n3")) / F.greatest("total", F.lit(1))
    n = F.when(F.col("word") == START, 0).otherwise(F.col("n"))
    rows = merged.select(
        F.col("word").alias("key"), n.cast("bigint").alias("n"), "total",
        gamma.cast("double").alias("gamma"), (kept + F.lit(unknown)).cast("double").alias("alone"),
    )
    pairs, large = HashArrays(folder, bits, {"n": "<u1"}), HashArrays(apart, bits, {"n": "<i8"})
    return Model(write_arrays(rows, "model-words"), pairs, large, hot, size.n, size.v, unknown, high)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every text, all its words and one end being its tokens.

    ``score`` is the model's log10 probability, ``base_score`` that of single tokens with 0.1 added to each count. A null text is an
    empty one. Repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.log10(model.tokens + 0.1 * (model.vocabulary + 1))
        for batch in batches:
            for rows, before, token, begin in _parts(batch, _SCORED):
                logs, count = model.log10(before, token)
                n = np.diff(begin)
                known = np.add.reduceat((count > 0).astype(np.int64), begin[:-1])
                base = np.add.reduceat(np.log10(count + 0.1) - whole, begin[:-1])
                total = np.add.reduceat(logs, begin[:-1])
                ids = batch.column("doc_id")[rows.start : rows.stop]
                columns = [ids, *map(pa.array, (n, known, base, total, 10 ** (-total / n)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return _tokens(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    )
