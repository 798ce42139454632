"""Ordinal quality grades: gradients, held-out accuracy and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetledger.llm import quality, queries
from fleetledger.llm.common import held_out_fold


def test_training_finds_ordered_thresholds():
    rng = np.random.default_rng(1)
    traits = rng.integers(0, 30, (4000, 5))
    effect = np.linspace(-2, 2, 30)
    latent = effect[traits].sum(1) + rng.logistic(size=4000)
    grades = np.digitize(latent, [-1.5, 2.0])
    model = quality.train(np.arange(0, 20_001, 5), traits.ravel(), grades, 2, steps=600, ridge=1e-5)
    assert model.thresholds == pytest.approx([-1.5, 2.0], abs=0.35)
    assert model.weights[:30] - model.weights[:30].mean() == pytest.approx(effect, abs=0.35)
    tails = model.tails(np.array([0, 5, 5]), traits[0])
    assert (tails[:, 0] > tails[:, 1]).all() and tails.shape == (2, 2)


def test_held_out_grades(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out_fold(F.col("doc_id"), 4, 0)
    model = quality.fit(docs, quality.grades(labels.where(~held)), top=2)
    found = quality.grade(model, docs.where(held)).join(labels, "doc_id").toPandas()
    clean, junk = found[(found.quality == 1) & (found.toxic == 0)], found[found.quality == 0]
    toxic = found[(found.quality == 1) & (found.toxic == 1)]
    assert clean.keep.mean() > 0.95 and junk.keep.mean() < 0.1
    # about a third of the texts marked toxic have no word that others of them have
    assert toxic.keep.mean() < 0.45 and toxic.tail_probability.mean() < clean.tail_probability.mean() - 0.4
    assert junk.expected_grade.mean() < 1.2 < clean.expected_grade.mean()


def test_rare_telling_words_count():
    """Eight texts of 4,000 have a word that only low grades go with, beside words that tell nothing."""
    rng = np.random.default_rng(3)
    texts = [np.append(rng.choice(400, 30, replace=False), 500 if i < 8 else 501) for i in range(4000)]
    grades = np.where(np.arange(4000) < 8, 0, (rng.random(4000) > 0.05).astype(int))
    model = quality.train(np.append(0, np.cumsum([len(t) for t in texts])), np.concatenate(texts), grades, 1)
    new = [np.append(rng.choice(400, 30, replace=False), w) for w in [500] * 50 + [501] * 50]
    keep = model.tails(np.append(0, np.cumsum([len(t) for t in new])), np.concatenate(new))[:, 0] >= 0.5
    assert keep[:50].mean() < keep[50:].mean() - 0.5


def test_held_out_toxic_recall_by_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out_fold(F.col("doc_id"), 4, 0)
    model = quality.fit(docs, quality.grades(labels.where(~held)), top=2)
    rated = docs.select("doc_id", "text", "lang").join(labels.where("quality = 1 AND toxic = 1"), "doc_id")
    found = quality.grade(model, rated.where(held)).join(rated.select("doc_id", "lang"), "doc_id").toPandas()
    recall = 1 - found.groupby("lang").keep.mean()
    assert recall["en"] > 0.8 and (recall[["de", "fr", "es"]] >= 0.45).all() and 1 - found.keep.mean() > 0.7


def test_query_covers_all_documents(spark, sf_small):
    found = queries.QUERIES["op2_quality_grades"](spark, sf_small)
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id").collect())
    got = found.collect()
    assert sorted(r.doc_id for r in got) == ids
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability - 1e-9 <= r.expected_grade <= 2 for r in got)


def test_odd_rows(spark, rows):
    docs = rows([(1, "good text", 0), (None, "bad bad", 1), (2, None, 1), (3, "", 1), (3, "", 1)], "doc_id bigint, text string, grade int")
    ratings = rows([(1, 1), (2, 0), (2, None), (3, 7), (None, 1), (9, 1)], "doc_id bigint, grade int")
    got = quality.grade(quality.fit(docs, ratings, 1), docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3]
    even = quality.grade(quality.fit(docs, ratings.limit(0), 1), docs).collect()
    assert {r.tail_probability for r in even} == {0.5}
    assert quality.grade(quality.fit(docs, ratings, 1), docs.limit(0)).collect() == []
