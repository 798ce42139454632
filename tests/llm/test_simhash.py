"""SimHash near-dedup against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from fleetledger.llm import queries, simhash
from fleetledger.llm.graph import components


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(ws[i : i + 4]) for i in range(max(len(ws) - 3, 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_query_matches_brute_force(spark, sf_small):
    found = queries.QUERIES["op6_simhash_neardup"](spark, sf_small).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas().sort_values("doc_id")
    prints = [plain_print(t) for t in docs.text]
    assert found.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert found.component_id.tolist() == plain_components(docs.doc_id.tolist(), prints, 4)
    assert found.component_id.nunique() < len(found)


def test_odd_rows(spark, rows):
    data = [(3, None, "x"), (1, "", "y"), (None, "a b", "z"), (7, "A  b", "z"), (7, "A  b", "z"), (9, "word " * 70_000, "q")]
    docs = rows(data, "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id or 0, simhash_hex(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect())
    ab, many = f"{plain_print('a b'):016x}", f"{plain_print('word ' * 9):016x}"
    zero = "0" * 16
    assert got == [(0, ab, 7), (1, zero, 1), (3, zero, 1), (7, ab, 7), (7, ab, 7), (9, many, 9)]
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]


def test_ids_that_tell_no_rows_apart(spark, rows):
    """Null and repeated ids: every component keeps exactly one document, and no copy of a numbered one comes back."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(None, a, 1), (None, b, 1), (None, b, 1), (None, c, 1), (5, c, 1), (7, a + " a", 1), (8, d, 1), (8, "other text", 1), (8, d, 1), (None, None, 1), (None, "", 1)]
    docs = rows(data, "doc_id bigint, text string, fp int")
    parts = plain_components(list(range(len(data))), [plain_print(t) for _, t, _ in data], 4)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(parts)) == len({plain_print(t) for _, t in got})
    assert (None, b) in got and (5, c) in got and (None, c) not in got and (8, d) in got and (8, "other text") in got


def simhash_hex(fp):
    return f"{fp & (1 << 64) - 1:016x}"


def test_empty_table(spark, rows):
    docs = rows([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.deduplicated(docs).collect() == []


@pytest.mark.parametrize("tree_size", [4, 1000])
def test_links_of_split_shards_connect_all(spark, tree_size):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20)
    values = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (12, 2))})
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r.node: r.root for r in components(simhash.near_links(frame, 4, tree_size)).collect()}
    want = plain_components(values, values, 4)
    assert [found.get(v, v) for v in values] == want


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 1 << 20, 400)]
    tree = simhash.BKTree(values)
    for q in values[:50]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.where("a < 0")).collect() == []
