"""Phrase collocations: frequent n-grams found by mergeable Misra-Gries summaries, then counted exactly.

Every input partition is cut into pieces and words by numpy on its UTF-8 bytes, and each n-gram of 1 to 3 words gets two 64-bit keys: word hashes
chained by a mixing function, with the language and the order mixed in. Pass one counts the first key per partition and sums the counts
of each hash bucket: the bucket's mass m. Pass two deals the local counts by bucket; a Misra-Gries summary of capacity
k = floor(m / threshold) + 1 > m / threshold absorbs the bucket's batches one by one by the mergeable rule (add the counters, subtract the
(k+1)-th largest, keep what stays positive). A key's true count lies between its counter and the counter plus everything the bucket
subtracted, which is below m / (k+1) < threshold; keys whose upper bound reaches the threshold survive, so no frequent n-gram is lost.

Pass three counts exactly: the documents are read again, the occurrences of surviving keys are counted per partition by both keys and
named by their text, and Spark sums them by (language, phrase). The parts of a frequent phrase are frequent themselves, so the counts of
all cuts come from the same pass. Scores, containment and ranks are SQL over these counts.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.llm.hasharrays import HashArrays, write_arrays
from fleetledger.session import written_once

#: Fixed values of the method: piece breaks and word separators.
PIECE_BREAKS = ".,;:!?\x0a\x0b\x0c\x0d"
#: Survivors that may be sent to every task whole; beyond, the text pass looks them up in sorted arrays in the shared folder.
BROADCAST_ROWS = 2_000_000
#: Bytes of text tokenised at once: bounds a task's Python memory whatever the batch size (a longer single text is one slice).
SLICE_BYTES = 1 << 20
#: The same for the text pass: a phrase repeated in a slice is written out once, so larger slices mean fewer rows.
TEXT_SLICE_BYTES = 4 << 20
#: n-gram keys counted together before a task sends them on: bounds that buffer (64 MB of keys) whatever the partition's size.
LOCAL_KEYS = 8 << 20
#: Keys of one bucket that travel in one row of the shuffle: 10,000 such rows, an Arrow batch, hold 80 MB at most.
ROW_KEYS = 512
#: Words of up to this many bytes are hashed in vectors, eight bytes a step; longer ones one by one.
LONG_WORD = 64
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair (a splitmix finaliser over a combination of both)."""
    with np.errstate(over="ignore"):
        x = a ^ (b + _GOLD + (a << np.uint64(6)) + (a >> np.uint64(2)))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _byte_classes() -> np.ndarray:
    """0 for a byte of a word, 1 for a separator (space, tab), 2 for a piece break."""
    classes = np.zeros(256, np.int8)
    classes[[0x20, 0x09]] = 1
    classes[[ord(c) for c in PIECE_BREAKS]] = 2
    return classes


_CLASSES = _byte_classes()
_CLASS_BYTES = _CLASSES.tobytes()
_LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Per seed, a random 64-bit value for every word length, drawn from a fixed generator: where a word's hash begins.
_LENGTHS = {seed: np.random.default_rng(seed).integers(0, 2**64, LONG_WORD + 1, dtype=np.uint64) for seed in (1, 2)}
#: Masks of the first n of eight bytes.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Grams:
    """The words of a batch of documents and the two keys of each of their n-grams, computed on the UTF-8 bytes with numpy.

    Pieces end at a break byte and at the end of a document; words are runs of other bytes than separators and breaks, all of them
    ASCII, so a word never splits a multi-byte character. A word's key starts from its length and absorbs its bytes eight at a time;
    for a given start each step is one to one in those eight bytes. The second keys are computed only for the n-grams asked for.
    """

    def __init__(self, texts: list, langs: list, max_words: int):
        raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        # a break before and after every text, and so many at the end that eight bytes can be read at any word's last byte
        self.data = b"\n".join([b"", *raw, b"\n" * 8]).translate(_LOWER_BYTES)
        self.buf = np.frombuffer(self.data, np.uint8)
        kind = np.frombuffer(self.data.translate(_CLASS_BYTES), np.int8)
        word = kind == 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.starts_at, self.ends_at = edges[::2], edges[1::2]
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.doc = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(self.starts_at, bounds)))
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts_at]
        self.langs = ["und" if lang is None else lang for lang in langs]
        names = sorted(set(self.langs))
        code = {x: i for i, x in enumerate(names)}
        self.names, self.lang_code = pa.array(names, pa.string()), np.array([code[x] for x in self.langs], np.int64)
        self.orders = list(range(1, max_words + 1))
        words, lang = self._words(1), self._lang_keys(1)
        self.keys, self.starts = [], []
        chain = words
        for order in self.orders:
            if order > 1:
                chain = _mix(chain[:-1], words[order - 1 :])
            at = np.flatnonzero(piece[: len(chain)] == piece[order - 1 :])
            self.keys.append(_mix(chain[at], lang[at] ^ np.uint64(order)))
            self.starts.append(at)

    def _words(self, seed: int) -> np.ndarray:
        """A key of every word."""
        size = self.ends_at - self.starts_at
        eight = np.ndarray(max(len(self.data) - 7, 0), "<u8", self.data, strides=(1,))  # the eight bytes at every place
        keys = _mix(_LENGTHS[seed][np.minimum(size, LONG_WORD)], eight[self.starts_at] & _FIRST_BYTES[np.minimum(size, 8)])
        rest = np.flatnonzero(size > 8)
        for k in range(8, LONG_WORD, 8):
            rest = rest[size[rest] > k]
            if not len(rest):
                break
            keys[rest] = _mix(keys[rest], eight[self.starts_at[rest] + k] & _FIRST_BYTES[np.minimum(size[rest] - k, 8)])
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            keys[i] = xxhash.xxh64_intdigest(self.data[self.starts_at[i] : self.ends_at[i]], seed)
        return keys

    def _lang_keys(self, seed: int) -> np.ndarray:
        """A key of the language of every word."""
        table = np.array([xxhash.xxh64_intdigest(x.encode(), seed + 2) for x in self.names.to_pylist()], np.uint64)
        return table[self.lang_code[self.doc]]

    def texts(self, firsts: np.ndarray, order: int) -> pa.Array:
        """The phrases of ``order`` words beginning at each word of ``firsts``, as one string array built from the bytes.

        A phrase's bytes run from its first word's start to its last word's end; inside, only separators lie between the words
        (a break would end the piece), so each run of them becomes one space. A phrase never begins with a separator.
        """
        begin, end = self.starts_at[firsts], self.ends_at[firsts + order - 1]
        size = end - begin
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw = self.buf[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - begin, size)]
        sep = _CLASSES[raw] == 1
        again = np.zeros(len(raw), bool)
        again[1:] = sep[1:] & sep[:-1]
        owner = np.repeat(np.arange(len(firsts)), size)
        raw = np.where(sep, np.uint8(0x20), raw)[~again]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~again], minlength=len(firsts)))]).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
        return out.cast(pa.string())

    def first(self) -> np.ndarray:
        return np.concatenate(self.keys).view(np.int64)

    def phrases(self, wanted: Wanted | None) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """(lang, phrase, count, first key) of the n-grams whose first key is in ``wanted`` (all for None).

        Hits are sorted by the first key alone; a row ends where either key changes. Two phrases sharing a first key thus never share a
        row, and if their hits interleave one phrase gives several rows, which the grouping by text afterwards adds up.
        """
        langs, texts, counts, firsts = [], [], [], []
        words, lang = self._words(2), self._lang_keys(2)
        for keys, starts, order in zip(self.keys, self.starts, self.orders):
            a, at = keys.view(np.int64), starts
            if wanted is not None:
                likely = wanted.likely(keys)
                a, at = a[likely], at[likely]
            order_ = np.argsort(a)
            a, at = a[order_], at[order_]
            if wanted is not None:
                hit = wanted.among(a)
                a, at = a[hit], at[hit]
            if not len(a):
                continue
            b = words[at]
            for k in range(1, order):
                b = _mix(b, words[at + k])
            b = _mix(b, lang[at] ^ np.uint64(order))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            langs.append(self.names.take(pa.array(self.lang_code[self.doc[at[first]]])))
            texts.append(self.texts(at[first], order))
            counts.append(np.diff(np.append(first, len(a))).astype(np.int64))
            firsts.append(a[first])
        if not firsts:
            return pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return pa.concat_arrays(langs), pa.concat_arrays(texts), np.concatenate(counts), np.concatenate(firsts)


class Wanted:
    """Sorted keys, and a table of their leading bits that rules out most others before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(24, max(10, (8 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self._place(keys.view(np.uint64))] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).view(np.int64)

    def likely(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be wanted."""
        return np.flatnonzero(self.table[self._place(keys)])

    def _known(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(distinct), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)] == distinct

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Which of ``keys`` (sorted) are wanted."""
        if not len(keys):
            return np.zeros(0, bool)
        first = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        return np.repeat(self._known(keys[first[:-1]]), np.diff(first))


class StoredWanted(Wanted):
    """The same for keys in sorted arrays of the shared folder, whose files a task maps shard by shard."""

    def __init__(self, arrays: HashArrays):
        self.arrays = arrays

    def likely(self, keys: np.ndarray) -> np.ndarray:
        return np.arange(len(keys))

    def _known(self, distinct: np.ndarray) -> np.ndarray:
        return self.arrays.lookup(distinct, [])[0]


def _grams(max_words: int, slice_bytes: int = SLICE_BYTES):
    """Grams of the slices of a batch, each holding at most ``slice_bytes`` of text (or one longer text)."""

    def part(batch: pa.RecordBatch) -> Grams:
        return Grams(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_lang").to_pylist(), max_words)

    def of(batch: pa.RecordBatch) -> Iterator[Grams]:
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > slice_bytes:
                yield part(batch.slice(start, i - start))
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield part(batch.slice(start))

    return of


def _counted(held: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """The counts of the keys in ``held``, which is emptied: rows of up to ``ROW_KEYS`` keys of one bucket and their counts, as little-endian
    64-bit numbers end to end."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    bucket = np.mod(keys, parts)
    order = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(bucket)))
    rows = -(-sizes // ROW_KEYS)
    cuts = np.repeat(begins, rows) + ROW_KEYS * (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows))
    offsets = pa.py_buffer((8 * np.append(cuts, len(keys))).astype(np.int64))
    packed = [pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, offsets, pa.py_buffer(x.astype("<i8", copy=False))]) for x in (keys, counts)]
    buckets = pa.array(bucket[cuts].astype(np.int32))
    for i in range(0, len(cuts), 2048):
        yield pa.RecordBatch.from_arrays([buckets.slice(i, 2048), *(x.slice(i, 2048).cast(pa.binary()) for x in packed)], ["bucket", "keys", "counts"])


def _merge(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate([counts, weights]), minlength=len(unique)).astype(np.int64)


def misra_gries(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge a weighted batch into a summary of at most ``capacity`` counters: add, subtract the (capacity+1)-th largest, keep positives.

    Returns the keys, their counters and the amount subtracted from each (0 if nothing was).
    """
    keys, counts = _merge(keys, counts, more, weights)
    if len(counts) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    counts = counts - cut
    keep = counts > 0
    return keys[keep], counts[keep], cut


def _summaries(capacity: dict[int, int], threshold: int, buffer_rows: int = 1 << 20):
    """Misra-Gries summaries of the buckets of a partition. Batches are buffered per bucket and merged once the buffer holds as many
    rows as the summary may (at least ``buffer_rows``), so a merge's sort is paid once per capacity's worth of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def absorb(key: int) -> None:
            keys, counts, lost = held.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
            more = waiting.pop(key, [])
            sizes.pop(key, None)
            if more:
                keys, counts, cut = misra_gries(keys, counts, np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more]), capacity[key])
                held[key] = (keys, counts, lost + cut)

        for batch in batches:
            for key, h, cnt in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
                waiting.setdefault(key, []).append((np.frombuffer(h, "<i8"), np.frombuffer(cnt, "<i8")))
                sizes[key] = sizes.get(key, 0) + len(h) // 8
                if sizes[key] >= max(capacity[key], buffer_rows):
                    absorb(key)
        for key in list(waiting):
            absorb(key)
        for keys, counts, lost in held.values():
            # The true count is at most the counter plus all that was subtracted.
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts + lost >= threshold])], ["h"])

    return run


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_words: int = 3, threshold: int = 10) -> DataFrame:
    """Exact counts (lang, phrase, words, f) of every phrase of 1 to ``max_words`` words with f >= ``threshold`` in its language.

    A null language is ``und``, a null text empty. Every occurrence counts, repeated rows and overlaps included. Phrases are told apart
    by their text within the rows of a partition that share a pair of 64-bit keys (a 128-bit key).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams, texts_of = _grams(max_words), _grams(max_words, TEXT_SLICE_BYTES)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pass one needs only how many keys fall in each bucket.
        held = np.zeros(parts, np.int64)
        for batch in batches:
            for g in grams(batch):
                held += np.bincount(np.mod(g.first(), parts), minlength=parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(held)], ["bucket", "m"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys of several slices are counted together, up to LOCAL_KEYS at once: repeats across a task's slices leave as one row.
        held, size = [], 0
        for batch in batches:
            for g in grams(batch):
                held.append(g.first())
                size += len(held[-1])
                if size >= LOCAL_KEYS:
                    yield from _counted(held, parts)
                    size = 0
        if held:
            yield from _counted(held, parts)

    masses_of = rows.mapInArrow(masses, "bucket int, m bigint").groupBy("bucket").agg(F.sum("m").alias("m"))
    capacity = {r["bucket"]: r["m"] // threshold + 1 for r in masses_of.collect()}
    # A bucket is the key modulo ``parts``; all of a bucket's rows meet in one task, where its summary is built.
    counted = rows.mapInArrow(local, "bucket int, keys binary, counts binary")
    survivors = counted.repartition(parts, "bucket").mapInArrow(_summaries(capacity, threshold), "h bigint")
    keys = written_once(survivors, "frequent-keys")
    n_keys = keys.count()
    wanted = stored = None
    if n_keys <= BROADCAST_ROWS:
        wanted = spark.sparkContext.broadcast(np.sort(keys.toArrow().column("h").to_numpy()))
    else:
        stored = write_arrays(keys.withColumnRenamed("h", "key"), "frequent-arrays")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = StoredWanted(stored) if wanted is None else Wanted(wanted.value)
        for batch in batches:
            for g in texts_of(batch):
                langs, texts, counts, firsts = g.phrases(among)
                columns = [langs, texts, pa.array(counts), pa.array(firsts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "cnt", "h"])

    found = rows.mapInArrow(named, "lang string, phrase string, cnt bigint, h bigint")
    total = found.groupBy("lang", "phrase").agg(F.sum("cnt").alias("f")).where(F.col("f") >= threshold)
    return total.withColumn("words", F.size(F.split("phrase", " ")))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_words: int = 2, max_words: int = 3,
                 threshold: int = 10, keep_share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of ``min_words`` to ``max_words`` words by association score.

    A candidate has a = f(phrase) >= ``threshold``. Each cut after k words gives l and r (the counts of both sides) and
    floor(1e6 a^2 / (l r)) in exact decimal arithmetic; the lowest score counts, ties to the smallest k. A candidate inside a longer one
    (dropped or not) with 100 f(longer) >= ``keep_share`` a is dropped. Ranked by score, a (both descending) and phrase (UTF-8 byte order).
    Returns lang, rank, phrase, a, l, r, n (all word occurrences of the language), score. Empty input gives no rows.
    """
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    counts = written_once(frequent(docs, text_col, lang_col, max_words=max_words, threshold=threshold), "phrase-counts")
    words = F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09.,;:!?\x0A-\x0D]+", -1), "")
    totals = docs.select(lang.alias("lang"), F.size(words).cast("bigint").alias("w"))
    totals = totals.groupBy("lang").agg(F.sum("w").alias("n"))
    cands = counts.where(F.col("words").between(min_words, max_words)).select("lang", "phrase", F.col("f").alias("a"), "words")
    ws = F.split("phrase", " ")
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.array_join(F.slice(ws, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(ws, F.col("k") + 1, 1 << 20), " ").alias("right")
    )
    side = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("c"))
    cuts = cuts.join(side.withColumnsRenamed({"part": "left", "c": "l"}), ["lang", "left"]).join(
        side.withColumnsRenamed({"part": "right", "c": "r"}), ["lang", "right"]
    )
    score = F.expr("(CAST(a AS DECIMAL(38,0)) * a * 1000000) div (CAST(l AS DECIMAL(38,0)) * r)")
    cuts = cuts.withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "words", "b.score", "b.l", "b.r"
    )
    inner = F.flatten(F.transform(
        F.sequence(F.lit(min_words), F.col("words") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " ")),
    ))
    longer = cands.where(F.col("words") > min_words).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("fl"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("fl").alias("fl"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("fl").isNull() | (F.col("fl") * 100 < F.col("a") * keep_share))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))))
    out = ranked.where(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("bigint"), "phrase", *[F.col(c).cast("bigint") for c in ("a", "l", "r", "n", "score")])
