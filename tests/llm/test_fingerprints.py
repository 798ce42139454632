"""Fingerprints: edited texts, agreement with the true similarity, and a plain version of the bins."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetledger.llm import fingerprints, queries


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))}


def test_query(spark, sf_small):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprints"](spark, sf_small).collect()}
    assert len(got) == len(docs)
    by_text, errors = {}, []
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            assert 0 <= value <= 1
            errors.append(value - len(a & b) / len(a | b))
    assert abs(sum(errors)) / len(errors) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


@pytest.mark.parametrize("n", [3, 40, 400])
def test_estimates_follow_the_similarity(spark, n):
    rng = random.Random(n)
    data, want = [], []
    for i in range(60):
        a = [f"w{rng.random()}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(n)] = "other"
        data.append((i, " ".join(a), " ".join(b)))
        x, y = shingles(data[-1][1]), shingles(data[-1][2])
        want.append(len(x & y) / len(x | y))
    near = fingerprints.likeness(fingerprints.minhash(F.col("a")), fingerprints.minhash(F.col("b")))
    frame = spark.createDataFrame(data, "i int, a string, b string").withColumn("near", near)
    got = [r.near for r in frame.orderBy("i").collect()]
    assert all(g == 1 for g, w in zip(got, want) if w == 1)
    assert sum(abs(g - w) for g, w in zip(got, want)) / len(got) < 0.05


def test_neighbours_over_ranges_and_odd_rows(spark, rows):
    data = [(i * 3 % 101, f"text {i}", i) for i in range(101)] + [(None, "first", 0), (50, "text 50 again", 0), (50, "text 50 again", 0), (7, None, 1)]
    docs = rows(data, "doc_id bigint, text string, prints int").repartition(7)
    found = fingerprints.with_next(fingerprints.fingerprints(docs)).collect()
    order = sorted((d is not None, d or 0, t or "") for d, t, _ in data)
    want = sorted((d or -1, t, order[(i + 1) % len(order)][2]) for i, (_, d, t) in enumerate([(k, d if k else None, t) for k, d, t in order]))
    assert sorted((-1 if r.doc_id is None else (r.doc_id or -1), r.text, r.next_text) for r in found) == want
    (alone,) = fingerprints.edited_fingerprints(docs.where("text = 'first'")).collect()
    assert (alone.near_next, alone.n_chars) == (1.0, 5)
    assert fingerprints.edited_fingerprints(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark, sf_small):
    plan = queries.QUERIES["op1_fingerprints"](spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
