"""Suffix-array dedup against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest

from fleetledger.llm import queries, suffixes


def plain(docs, length=50):
    """{doc_id: (n_bytes, n_removed, spans, kept)} for distinct ids."""
    first = {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out[d] = (len(b), int(gone.sum()), [tuple(e) for e in edges], kept)
    return out


def collected(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, [(s.first, s.last) for s in r.spans], bytes(r.kept)) for r in df.collect()}


def test_query_matches_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op10_suffix_dedup"](spark, sf_small).collect()}
    assert len(got) == len(docs)
    for d, (n, removed, spans, kept) in want.items():
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert any(removed for _, removed, _, _ in want.values())


@pytest.mark.parametrize("seed,limit", [(1, 20_000), (2, 20_000), (3, 5), (4, 1)])
def test_planted_passages(spark, seed, limit):
    """Passages of 49 bytes and more, edited copies, periodic text and multi-byte characters; also with hot grams dealt out."""
    rng = random.Random(seed)
    letters = "abcdeé \n" if seed % 2 else "ab"
    passages = ["".join(rng.choices(letters, k=rng.choice([30, 45, 49, 50, 51, 60, 90, 200]))) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("xyzuvw ", k=rng.randint(0, 80))) for _ in range(5)]
        text = list("".join(parts))
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = "q"
        docs.append((d * 7 % 60 - 5, "".join(text)))
    docs += [(100, "ab" * 300), (101, "ab" * 200), (102, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert collected(suffixes.remove_repeats(frame, group_limit=limit)) == plain(docs)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=20_000))
    docs = [(1, text), (2, text[5_000:9_000] + "#" + text[:60]), (3, "x" + text[19_900:])]
    want = [np.concatenate(x) for x in zip(*_anchors(docs))]
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    got = [np.concatenate(x) for x in zip(*_anchors(docs))]
    assert all((a == b).all() for a, b in zip(want, got))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert collected(suffixes.remove_repeats(frame)) == plain(docs)


def _anchors(docs):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], ["text"])
    yield suffixes.Texts(batch).anchors(50)


def test_sort_orders_suffixes():
    rng = random.Random(6)
    base = bytes(rng.choices(b"ab", k=60))
    data = np.frombuffer(b"".join(base[: rng.randint(40, 60)] + bytes(rng.choices(b"abc", k=40)) for _ in range(30)) + b"\0" * 60, np.uint8)
    positions = np.arange(len(data) - 60)
    order, equal = suffixes.deep_shallow(data, positions, 50)
    strings = [data[p : p + 50].tobytes() for p in positions[order]]
    assert strings == sorted(data[p : p + 50].tobytes() for p in positions)
    assert equal.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


def test_odd_rows(spark, rows):
    passage = "z" * 20 + "0123456789" * 4
    data = [(None, passage, "k"), (2, passage, "k"), (2, passage, None), (3, None, "k"), (4, "", "k"), (5, passage + "é", "k")]
    docs = rows(data, "doc_id bigint, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect())
    assert got == [(0, 60, 0), (2, 60, 0), (2, 60, 0), (3, 0, 0), (4, 0, 0), (5, 62, 60)]
    cut = suffixes.without_repeats(docs)
    assert cut.schema == docs.schema
    assert {(r.doc_id, r.text) for r in cut.collect()} >= {(5, "é"), (3, None), (4, ""), (2, passage)}
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []
