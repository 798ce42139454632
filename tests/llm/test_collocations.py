"""Collocations: Misra-Gries keeps every frequent item, the query equals its SQL and a brute-force count, odd rows are defined."""

import collections
import re

import numpy as np
import pytest
from compare import connect, differences

from fleetledger.llm import collocations, queries


def test_query_matches_sql(spark, sf_small):
    found = queries.QUERIES["op13_collocations"](spark, sf_small)
    assert differences(found, connect(sf_small), queries.ORACLE["op13_collocations"]) == []


@pytest.mark.parametrize("seed", range(5))
def test_misra_gries_keeps_every_frequent_item(seed):
    rng = np.random.default_rng(seed)
    stream = np.concatenate([rng.zipf(1.3, 50_000), np.full(3000, 7), rng.integers(0, 10**9, 20_000)]).astype(np.int64)
    rng.shuffle(stream)
    threshold = 25
    capacity = len(stream) // threshold + 1
    keys, counts, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for chunk in np.array_split(stream, 37):
        u, c = np.unique(chunk, return_counts=True)
        keys, counts, cut = collocations.misra_gries(keys, counts, u, c, capacity)
        lost += cut
        assert len(keys) <= capacity
    assert lost < threshold
    true = collections.Counter(stream.tolist())
    kept = dict(zip(keys.tolist(), counts.tolist()))
    for item, f in true.items():
        if f >= threshold:
            assert item in kept and kept[item] <= f <= kept[item] + lost


def brute(texts, threshold=10, top=2000):
    freq, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in texts:
        lang = lang or "und"
        t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", t):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(ws)
            for o in (1, 2, 3):
                for i in range(len(ws) - o + 1):
                    freq[lang][" ".join(ws[i : i + o])] += 1
    out = set()
    for lang, f in freq.items():
        cands = {p: a for p, a in f.items() if 2 <= len(p.split(" ")) <= 3 and a >= threshold}
        rows = []
        for p, a in cands.items():
            ws = p.split(" ")
            if len(ws) == 2 and any(
                (" ".join(lw[:2]) == p or " ".join(lw[1:]) == p) and 100 * la >= 50 * a for lp, la in cands.items() for lw in [lp.split(" ")] if len(lw) == 3
            ):
                continue
            cuts = [(1_000_000 * a * a // (f[" ".join(ws[:k])] * f[" ".join(ws[k:])]), k, f[" ".join(ws[:k])], f[" ".join(ws[k:])]) for k in range(1, len(ws))]
            score, _, l, r = min(cuts)
            rows.append((score, a, p, l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out |= {(lang, i + 1, p, a, l, r, totals[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top])}
    return out


def test_small_corpus_equals_brute_force(spark):
    base = ["New York is big. New York City hall", "the new york times; NEW YORK city", "a b c a b c a b c", "x\ty z", None, "", "...,,,"]
    texts = [(t, lang) for i in range(12) for t, lang in zip(base, ["en", "en", None, "fr", "en", "de", "en"])]
    texts += [("hot phrase here. " * 500, "en")] * 3 + [("rare words only once", "en"), ("long " * 20_000, "und")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string, f bigint")
    got = {tuple(r) for r in collocations.collocations(docs.repartition(3), top=4).collect()}
    assert got == brute(texts, top=4)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations.collocations(empty).count() == 0


def test_phrase_texts_collapse_separator_runs_and_keep_utf8():
    g = collocations.Grams(["Ärger  \t im   Büro. x", "ÄRGER im büro", None], ["de", None, "de"], 3)
    langs, texts, counts, _ = g.phrases(None)
    got = collections.Counter()
    for lang, text, c in zip(langs.to_pylist(), texts.to_pylist(), counts.tolist()):
        got[(lang, text)] += c
    assert got[("de", "Ärger im büro")] == 1 and got[("und", "Ärger im büro")] == 1
    assert got[("de", "x")] == 1 and got[("de", "Ärger im")] == 1 and got[("und", "im büro")] == 1
    assert sum(got.values()) == 6 + 1 + 6


def test_local_counts_travel_in_rows_of_one_bucket():
    keys = np.random.default_rng(4).integers(-20_000, 20_000, 60_000)
    held = [keys[:100], keys[100:]]
    got, rows = collections.Counter(), 0
    for batch in collocations._counted(held, 7):
        for bucket, h, cnt in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
            h, rows = np.frombuffer(h, "<i8"), rows + 1
            assert 0 < len(h) <= collocations.ROW_KEYS and (np.mod(h, 7) == bucket).all()
            got.update(dict(zip(h.tolist(), np.frombuffer(cnt, "<i8").tolist())))
    assert got == collections.Counter(keys.tolist()) and not held
    assert rows <= len(got) / collocations.ROW_KEYS + 7
    assert list(collocations._counted([keys[:0]], 7)) == []


def test_words_of_every_length_have_their_own_keys():
    """Around each step of eight bytes and the length from which words are hashed one by one; a wanted key finds its phrase only."""
    words = [c * n + end for c in "ab" for n in range(80) for end in ("x", "y", "é")]
    g = collocations.Grams([" . ".join(words), None, " . ".join(words[::-1])], ["en", "en", "en"], 2)
    assert len(set(g.first().tolist())) == len(set(words))
    for pick in ("ay", "a" * 70 + "x", "b" * 63 + "é"):
        (key,) = set(collocations.Grams([pick], ["en"], 1).first().tolist())
        langs, texts, counts, firsts = g.phrases(collocations.Wanted(np.array([key])))
        assert (texts.to_pylist(), counts.tolist(), firsts.tolist()) == ([pick], [2 * words.count(pick)], [key])
    assert len(g.phrases(collocations.Wanted(np.zeros(0, np.int64)))[0]) == 0


def test_more_survivors_than_are_sent_whole(spark, monkeypatch):
    """Beyond the bound only survivors' texts are written out, not every n-gram's, and the counts are the same."""
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    texts = [("New York is big. New York City hall", "en"), ("the new york times; NEW YORK city", None)] * 12 + [(f"once{i} only{i}", "en") for i in range(50)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert {tuple(r) for r in collocations.collocations(docs.repartition(3)).collect()} == brute(texts, top=2000)
    plan = collocations.frequent(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
