"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.llm.common import bind, words

BINS, BITS, SHINGLE = 256, 8, 5
_PROBES = 32  # bins that an empty one asks in an order of its own, before it asks its neighbours in turn
_NO_ID = -(1 << 63)


def _shingle_hashes(ws: Column) -> Column:
    """One hash of every five words; of the whole sequence if it is shorter, also if it is empty."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w))))

    return bind(ws, of)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS.bit_length() - 1)).cast("int")


def _minima(hashes: Column) -> Column:
    """The smallest hash of each bin that has one: bins are told by the leading bits, so they follow in order."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    return bind(F.sort_array(hashes), firsts)


def _dense(minima: Column) -> Column:
    """Low-order bits by bin, null for an empty bin."""
    kept = F.transform(minima, lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << BITS - 1)).cast("tinyint"))
    filled = F.map_from_arrays(F.transform(minima, _bin), kept)
    return bind(filled, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(m, b)))


def _densified(dense: Column) -> Column:
    def full(d: Column) -> Column:
        def one(value: Column, b: Column) -> Column:
            asked = [F.get(d, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(_PROBES)]
            turn = F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda k: F.get(d, (b + k) % BINS))
            return F.coalesce(value, *asked, F.get(F.filter(turn, lambda v: v.isNotNull()), F.lit(0)))

        return F.transform(d, one)

    return bind(dense, full)


def minhash(text: Column) -> Column:
    """Of each bin the low-order bits of its smallest shingle hash, shifted to a signed byte: ``BINS`` numbers.

    Every shingle is hashed once; the leading bits choose the bin, so there is one permutation instead of one a bin. An empty bin takes the
    value of the first bin with one in a fixed random order of its own (optimal densification); what is still empty after 32
    questions asks its neighbours in turn. A null or blank text is one empty shingle.
    """
    return _densified(_dense(_minima(_shingle_hashes(words(text)))))


def likeness(a: Column, b: Column) -> Column:
    """Similarity that two fingerprints estimate, 0 to 1, free of the bias from bits that agree by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(BINS)
    chance = 2.0**-BITS
    return F.greatest((same - chance) / (1 - chance), F.lit(0.0))


def packed(prints: Column) -> Column:
    """The fingerprint as text: two hexadecimal digits a bin."""
    shift = 1 << BITS - 1
    return F.lower(F.array_join(F.transform(prints, lambda v: F.lpad(F.hex(v.cast("int") + shift), 2, "0")), ""))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, prints) with the ``next_text`` and ``next_prints`` of the next row by ascending id, of the first after the last.

    Null ids come first; rows with equal ids are ordered by text. Rows are dealt out by ranges of ids; the row that begins a
    range is also sent to the end of the range before it, so neighbours meet without a sort of all rows in one place. Only the ids at which
    ranges begin come to the driver, four a shuffle partition.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    shares = [i / parts for i in range(1, parts)]
    ids = rows.select(key.alias("k")).agg(F.min("k"), F.percentile_approx("k", shares, 10 * parts)).first()
    begins = sorted({ids[0], *ids[1]}) if ids[0] is not None else [0]
    cuts = F.lit(begins).cast("array<bigint>")
    own = F.size(F.filter(cuts, lambda c: c <= F.col("k"))) - 1
    after = F.struct(F.pmod(F.col("own") - 1, F.lit(len(begins))).alias("range"), F.lit(True).alias("guest"))
    home = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    places = F.when(F.array_contains(cuts, F.col("k")), F.array(home, after)).otherwise(F.array(home))
    dealt = rows.withColumn("k", key).withColumn("own", own).withColumn("p", F.explode(places))
    line = Window.partitionBy("p.range").orderBy("p.guest", "k", "text")
    following = F.lead(F.struct("text", "prints")).over(line)
    return dealt.withColumn("next", following).where("NOT p.guest").select(
        "doc_id", "text", "prints", F.col("next.text").alias("next_text"), F.col("next.prints").alias("next_prints")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, prints) of every document. A null text is an empty one. Repeated rows and null ids are kept; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.withColumn("prints", minhash(F.col("text")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, whose last half is replaced by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Empty tables give no rows; a single
    document is followed by itself.
    """
    rows = with_next(fingerprints(docs, id_col, text_col)).withColumn("n", F.char_length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n", "prints", "next_prints", edited.alias("edited"))
    rows = rows.withColumn("edited_prints", minhash(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("prints")).alias("fingerprint"),
        packed(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
