"""Kneser-Ney scores against a plain version."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fleetledger.llm import kneser, queries


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), " end"]


class Plain:
    def __init__(self, texts):
        self.pairs, self.single = Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            self.single.update(ts)
            self.pairs.update(zip([" start", *ts], ts))
        self.after, before = defaultdict(list), defaultdict(int)
        for (v, w), n in self.pairs.items():
            self.after[v].append(n)
            before[w] += 1
        self.before = dict(before)
        self.n, self.v = sum(self.single.values()), len(self.single)
        self.high = self.discount(self.pairs.values())
        self.low = self.discount(self.before.values())
        self.rest = self.spare(self.before.values(), self.low) / (self.v + 1) if self.pairs else 1.0
        self.gamma = {v: (sum(c), self.spare(c, self.high)) for v, c in self.after.items()}

    @staticmethod
    def discount(counts):
        n = Counter(counts)
        return kneser.discounts([n[1], n[2], n[3], n[4]])

    @staticmethod
    def spare(counts, d):
        return sum(d[min(c, 3) - 1] for c in counts) / sum(counts)

    def alone(self, w):
        total = len(self.pairs)
        c = self.before.get(w, 0)
        kept = max(c - self.low[min(c, 3) - 1], 0) / total if c else 0.0
        return kept + self.rest

    def probability(self, v, w):
        if v not in self.after:
            return self.alone(w)
        c, (total, gamma) = self.pairs.get((v, w), 0), self.gamma[v]
        kept = max(c - self.high[min(c, 3) - 1], 0) / total if c else 0.0
        return kept + gamma * self.alone(w)

    def score(self, text):
        ts = tokens(text)
        base = sum(math.log10((self.single[t] + 0.1) / (self.n + 0.1 * (self.v + 1))) for t in ts)
        logs = sum(math.log10(self.probability(v, w)) for v, w in zip([" start", *ts], ts))
        return len(ts), sum(t in self.single for t in ts), base, logs


def test_probabilities_sum_to_one():
    model = Plain(["a b c a b", "b c d", "a a a a", ""])
    for v in (" start", "a", "b", "never"):
        assert sum(model.probability(v, w) for w in [*model.single, "unknown"]) == pytest.approx(1)


def test_query_matches_plain_model(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    model = Plain([t for d, t in docs.items() if not held[d]])
    found = queries.QUERIES["op8_kneser_ney"](spark, sf_small).collect()
    assert len(found) == len(docs)
    better = 0
    for r in found:
        n, known, base, logs = model.score(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(logs, rel=1e-9)
        better += r.held_out and r.score > r.base_score
    assert better >= 0.8 * sum(held.values())


def test_odd_rows(spark, rows):
    data = [(1, "The cat", "x"), (None, "the  CAT\n", "x"), (2, None, "x"), (3, "", None), (3, "", None)]
    docs = rows(data, "doc_id bigint, text string, score string")
    plain = Plain([d[1] for d in data])
    model = kneser.fit(docs)
    got = sorted(((r.doc_id or 0), r.n_tokens, round(r.score, 9)) for r in kneser.score(model, docs).collect())
    want = sorted((d or 0, plain.score(t)[0], round(plain.score(t)[3], 9)) for d, t, _ in data)
    assert got == want
    (new,) = kneser.score(model, rows([(9, "dog the")], "doc_id bigint, text string")).collect()
    assert new.n_known == 2 and new.score == pytest.approx(plain.score("dog the")[3])


def test_nothing_to_learn_from(spark, rows):
    docs = rows([(1, "a b")], "doc_id bigint, text string")
    model = kneser.fit(docs.limit(0))
    (r,) = kneser.score(model, docs).collect()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert kneser.score(kneser.fit(docs), docs.limit(0)).collect() == []


def test_hot_first_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(kneser, "_COMBINED", 500)
    monkeypatch.setattr(kneser, "_SCORED", 300)
    texts = [(i, " ".join(f"the w{i * 40 + j}" for j in range(40))) for i in range(100)]
    texts.append((100, "the the " * 400))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model, plain = kneser.fit(docs), Plain([t for _, t in texts])
    assert len(model.hot)
    for r in kneser.score(model, docs).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id][1])[3], rel=1e-9)
