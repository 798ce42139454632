"""Decontamination against a brute-force version over all windows."""

import re
from collections import Counter

import pytest

from fleetledger.llm import decontaminate, queries


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def likeness(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def plain(docs, items):
    out = {}
    for d, text in docs:
        ws = plain_words(text)
        for item, wanted in items:
            want = plain_words(wanted)
            if len(want) < 5 or not set(grams(ws)) & set(grams(want)):
                continue
            best = max(likeness(grams(ws[i : i + len(want)]), grams(want)) for i in range(max(len(ws) - len(want), 0) + 1))
            if best >= 0.8:
                out[d, item] = max(best, out.get((d, item), 0))
    return out


def test_query_matches_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    want = plain(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.QUERIES["op3_decontamination"](spark, sf_small).collect()}
    assert want and got == pytest.approx(want)


def test_edited_and_odd_passages(spark, rows):
    item = " ".join(f"w{i}" for i in range(40))
    edited = item.replace("w39", "x")
    halves = " ".join(f"w{i}" for i in range(20))
    repeat = "a b c d e " * 8
    data = [
        (1, f"before {item.upper().replace(' ', ', ')}! after", 0), (2, f"{edited} tail", 0), (3, f"{halves} else " * 2, 0), (None, item, 0),
        (4, None, 0), (5, "", 0), (6, item.replace("w20", "y"), 0), (7, "q " * 3000 + item + " z" * 3000, 0), (7, "another", 0), (8, repeat + "f", 0),
        (9, item.split(" w37")[0], 0),
    ]
    docs = rows(data, "doc_id bigint, text string, similarity int")
    bench = rows([(1, item), (2, None), (3, "too few words"), (None, repeat), (1, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench).collect()}
    want = plain([(d, t) for d, t, _ in data], [(1, item), (None, repeat)])
    assert got == pytest.approx(want)
    assert {d for d, _ in got} == {1, 2, None, 7, 8, 9}
    kept = decontaminate.decontaminated(docs, bench)
    # The second row under id 7 ("another") is clean and stays although its id has a leak.
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id in (3, 4, 5, 6, 7))[-1] == (7, "another")
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert decontaminate.contamination(docs, bench.limit(0)).collect() == []


def test_swapped_parts_in_a_long_document(spark, rows):
    """The like window starts at no place that a shared shingle's offset in the item names."""
    ws = [f"w{i}" for i in range(60)]
    before, after = ([f"{c}{i}" for i in range(90)] for c in "yz")
    data = [
        (1, " ".join(before + ws[50:] + ws[:50] + after)), (2, " ".join(before + ws[55:] + ws[:55] + after)), (3, " ".join(before + ws[30:] + ws[:20] + after)),
        (4, " ".join(before + ws[:20] + ws[40:] + ws[20:40] + after)), (5, " ".join(ws[50:] + ws[:50])), (6, " ".join(before + ws[54:] + ["v"] + ws[:54] + after + ws)),
    ]
    items = [(1, " ".join(ws)), (2, " ".join(ws[:57]))]
    docs, bench = rows(data, "doc_id bigint, text string"), rows(items, "item_id bigint, text string")
    want = plain(data, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench).collect()}
    assert (1, 1) in want and (2, 1) in want and (3, 1) not in want and got == pytest.approx(want)


def test_no_python_in_the_plan(spark, sf_small):
    plan = queries.QUERIES["op3_decontamination"](spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_clean_rows_sharing_an_id_with_a_leak_stay(spark, rows):
    item = " ".join(f"w{i}" for i in range(40))
    data = [(None, item), (None, "a clean text of its own words here"), (5, f"x {item} y"), (5, "another clean text with other words"), (6, None)]
    docs = rows([(d, t, "c") for d, t in data], "doc_id bigint, text string, mark string")
    bench = rows([(1, item)], "item_id bigint, text string")
    kept = {(r.doc_id, r.text) for r in decontaminate.decontaminated(docs, bench).collect()}
    assert kept == {(None, data[1][1]), (5, data[3][1]), (6, None)}
