"""Fill-in-the-middle: the Roaring-style boundary set against plain lists, the query against its SQL, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from fleetledger.llm import fim, queries


def test_query_matches_sql(spark, sf_small):
    found = queries.QUERIES["op11_fim"](spark, sf_small)
    assert differences(found, connect(sf_small), queries.ORACLE["op11_fim"]) == []
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("seed", range(4))
def test_select_equals_a_sorted_list(seed):
    rng = np.random.default_rng(seed)
    dense = np.arange(70_000, 90_000)  # a run container
    sparse = rng.choice(1 << 20, 3000, replace=False)  # array containers
    middle = 200_000 + rng.choice(65_536, 20_000, replace=False)  # a bitmap container
    offsets = np.unique(np.concatenate([dense, sparse, middle]))
    bounds = fim.Boundaries(offsets)
    assert {"array", "bitmap", "run"} <= set(bounds.kinds)
    assert len(bounds) == len(offsets)
    for rank in rng.integers(0, len(offsets), 500):
        assert bounds.select(int(rank)) == offsets[rank]
    assert bounds.cut(0) == 0 and bounds.cut(len(offsets)) == offsets[-1]
    with pytest.raises(IndexError):
        bounds.select(len(offsets))


def plain_arrange(text, doc_id):
    import regex

    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    toks = regex.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(toks)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(toks[:lo]), "".join(toks[lo:hi]), "".join(toks[hi:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_random_and_odd_texts(spark):
    rng = random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\t", "\n", "é", "日本", "\x0b", "<", "P>", "x y", "😀"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "   ", "a<P>b", "<S>", "word " * 30_000, " lead", "trail \n"]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string").repartition(4)
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault((r.doc_id, r.back), []).append(r)
    for doc_id, text, _ in rows:
        want = plain_arrange(text or "", doc_id)
        found = by_key[(doc_id, text or "")][0]
        assert (found.n, found.form, found.prefix_chars, found.middle_chars, found.output) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.transform(empty).count() == 0
