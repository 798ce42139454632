"""URL filter rules by a sort-merge range join of reversed-host keys, with a stack of the rules that are open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.session import written_once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SAMPLE_A_RANGE = 40
_SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of an address: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path
    from there up to ``?``, ``#`` or the end. Both are empty for a null and without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(whole.contains("://"), F.regexp_replace(whole, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a NUL, so that a host and its subdomains share a prefix and nothing else has it."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "\0"), F.lit("\0")))


def _cuts(keys: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Keys at which ranges begin, with the number of ranges of which each is the beginning: over 1 for a key with more rows than a range.

    They come from a sample of at most ``_SAMPLE_A_RANGE`` keys a range, which decides how rows are dealt out but not what is returned.
    """
    n = keys.count()
    share = min(1.0, _SAMPLE_A_RANGE * parts / max(n, 1))
    chosen = keys.where(F.pmod(F.xxhash64("page_id", "place"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted(r.place for r in chosen.select("place").limit(2 * _SAMPLE_A_RANGE * parts).collect())
    heads = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    counted: dict[str, int] = {}
    for h in heads:
        counted[h] = counted.get(h, 0) + 1
    return sorted(counted.items())


def _sweep(default: str):
    """Rows of a range in key order: rules open and close as a stack, each page takes the longest open rule whose path fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("range", "key", "page_id", "host", "path", "verdict")}
            out: list[tuple] = []
            for number, key, page, host, path, verdict in zip(*rows.values()):
                if number != part:
                    part, stack = number, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    stack.append((key, host, path, verdict))
                    continue
                best = None
                for rule in stack:  # nested rules: a later one is for a longer or equal host
                    if path.startswith(rule[2]) and (best is None or len(rule[1]) + len(rule[2]) >= len(best[1]) + len(best[2])):
                        best = rule
                out.append((page, host, path, best[1] + best[2] if best else None, best[3] if best else default))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "host", "path", "rule", "verdict"]
            )

    return run


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, by rules (host, path, verdict).

    A rule fits its host and all subdomains if the address's path starts with the rule's. The longest rule (host and path together) wins, of
    equally long ones that with the longer host, then ``block``. Without a fitting rule ``rule`` is null and the verdict ``default``.

    A rule's host is a prefix of the keys it fits, that is an interval. Pages and rules are sorted by key within ranges, and a rule is sent
    to every range that its interval meets. The addresses of a key with more rows than a range are spread over several. A rule with a
    null is left out, a null address has an empty host, which only a rule without a host fits. Repeated pages and rules are kept
    apart; other columns are ignored. Rules without any page, and pages without any rule, give their plain results.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = written_once(split.withColumn("key", host_key(F.col("host"))), "page-keys")
    place = F.concat("key", F.lit("\0"), "path")
    cuts = _cuts(keyed.select("page_id", place.alias("place")), parts)
    starts = [k for k, _ in cuts]
    first = [sum(m for _, m in cuts[:i]) for i in range(len(cuts) + 1)]  # ranges before the i-th beginning
    begin = F.array(*[F.lit(k) for k in starts]) if starts else F.array().cast("array<string>")
    before = F.array(*[F.lit(n) for n in first])
    times = F.array(*[F.lit(m) for _, m in cuts]) if cuts else F.array(F.lit(1))

    below = F.size(F.filter(begin, lambda c: c <= F.col("place")))
    spread = F.when(
        F.array_contains(begin, F.col("place")),
        F.pmod(F.xxhash64("page_id"), F.get(times, F.col("below") - 1)).cast("int") + 1 + F.get(before, F.col("below") - 1),
    ).otherwise(F.get(before, F.col("below")))
    points = keyed.withColumn("place", place).withColumn("below", below).select(
        spread.alias("range"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )

    known = rules.select(
        F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.col("path"), F.col("verdict").cast("string").alias("verdict")
    ).na.drop()
    known = known.withColumn("key", host_key(F.col("host")))
    lowest = F.get(before, F.size(F.filter(begin, lambda c: c < F.col("key"))))
    highest = F.get(before, F.size(F.filter(begin, lambda c: (c <= F.col("key")) | c.startswith(F.col("key")))))
    intervals = known.withColumn("range", F.explode(F.sequence(lowest, highest))).select(
        "range", "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict"
    )
    rows = points.unionByName(intervals).repartition(parts, "range")
    rows = rows.sortWithinPartitions("range", "key", "kind", "verdict", "path")
    rows = rows.select("range", "key", "page_id", "host", "path", "verdict")
    return rows.mapInArrow(_sweep(default), _SCHEMA)
