"""Language identification: gradients, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from fleetledger.llm import langid, queries


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.Network.random(3, 2, rng)
    for w in ("inputs", "state", "out", "bias"):
        setattr(net, w, getattr(net, w).astype(np.float64))
    x, y = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    grads, _ = net.gradients(x, y)
    for w, g in zip(net.weights(), grads):
        flat = w.reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:5]:
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = net.gradients(x, y)[1]
            flat[i] = old - eps
            down = net.gradients(x, y)[1]
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-4)


def test_pooling_of_batches_is_that_of_single_texts():
    net = langid.Network.random(4, 3, np.random.default_rng(2))
    model = langid.Model(net, ["a", "b", "c"])
    texts = ["x" * 300, "", "Hello", "é" * 128, "z" * 128]
    raw = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(r) for r in raw]))
    mean, share = model.pooled(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, r in enumerate(raw):
        if r:
            single = [net.positions(net.run(np.frombuffer(r[j : j + 128], np.uint8)[:, None], None))[:, 0] for j in range(0, len(r), 128)]
            assert mean[i] == pytest.approx(np.concatenate(single).mean(0), abs=1e-5)
            labels = model.label_bytes(texts[i])
            assert share[i].tolist() == [labels.count(k) / len(r) for k in model.languages]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op7_language_id"](spark, folder).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(spark, rows):
    data = [(1, "the and of the", "en", 1), (2, "der die das und", "de", 1), (None, "über", None, 2), (3, None, "en", 1), (4, " 12 !", "de", 3), (4, " 12 !", "de", 3)]
    docs = rows(data, "doc_id bigint, text string, lang string, score int")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(model, docs).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0)
    kept = langid.identified(docs, model)
    # Only und goes: every text with a letter stays, however unsure the network is.
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2]
    assert kept.count() == 3
    assert langid.identify(model, docs.limit(0)).collect() == []
    blank = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(blank, docs).collect()} == {"und"}
