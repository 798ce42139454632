"""The corpus pipeline against brute-force versions of its stages, each on its own input."""

import hashlib

import numpy as np
import public_tokenizers
from test_decontaminate import plain as plain_leaks
from test_simhash import plain_components, plain_print
from test_suffixes import plain as plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_do_what_they_say(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names = docs.columns
    steps = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written_once(stage(spark, docs, sf_small), name)
        assert docs.columns == names
        steps.append(docs.collect())
    start, known, single, cut, clean = ({r.doc_id: r for r in s} for s in steps)
    assert known.keys() >= {d for d, r in start.items() if r.text and len(r.text) > 40}
    assert all(known[d] == start[d] for d in known)

    ids = sorted(known)
    labels = plain_components(ids, [plain_print(known[d].text) for d in ids], 4)
    assert sorted(single) == sorted(set(labels)) and len(single) < len(known)

    want = plain_repeats([(d, r.text) for d, r in single.items()])
    assert cut.keys() == single.keys()
    for d, r in cut.items():
        assert r.text == want[d][3].decode("utf-8", "ignore")
        assert r.n_chars == (len(r.text) if want[d][1] else single[d].n_chars)
        assert (r.lang, r.source) == (single[d].lang, single[d].source)
    assert any(want[d][1] for d in cut)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_leaks([(d, r.text) for d, r in cut.items()], items)}
    assert sorted(clean) == sorted(cut.keys() - leaks)

    found = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()}
    assert found.keys() == clean.keys()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, r in found.items():
        ids = library.encode(clean[d].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_small).collect())) == sorted(map(tuple, found.values()))


def test_odd_tables(spark, rows):
    """Nulls in every column, repeated rows and an extra column pass through every stage; so does an empty table."""
    folder = "/root/testdata/sf0.001"
    long = "the reading of this and that was here for her " * 3
    data = [(1, long, "en", "s", 5, 1), (1, long, "en", "s", 5, 1), (None, "une " * 9, None, None, None, None), (3, None, "en", "s", 0, 1), (4, "", None, "s", 0, 2)]
    docs = rows(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int")
    for start in (docs, docs.limit(0)):
        got = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = corpus_pipeline.written_once(stage(spark, got, folder), name)
            assert got.columns == docs.columns
        out = corpus_pipeline.encode(spark, got, folder).collect()
        assert sorted({r.doc_id or 0 for r in out}) == ([0, 1] if start is docs else [])
