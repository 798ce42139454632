"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetledger.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


def test_query_matches_the_library(spark, sf_small, library):
    found = queries.QUERIES["op5_bpe_codec"](spark, sf_small).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas()
    assert len(found) == len(docs)
    for d, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = found.loc[d]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


CASES = [
    "", " ", "It's WE'LL 'd 12x ²Ⅷ", "<|endoftext|>a<|startoftext|> <|EndOfText|>", "ΣΑΣ İx ﬁ",
    "é ẞ \x00\x1c\x1f\x85​　_", "中文\U0001f600́!?", "a" * 5000, "ab" * 3000 + "</w>", "é" * 2000,
]


@pytest.mark.parametrize("text", CASES)
def test_hard_texts(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts(codec, library):
    rng = random.Random(3)
    alphabet = "aeinrst'SD \néßΣ.,12-\u0301\x1c <|>"
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, repr(text)
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_stream_like_whole_ones(codec, library):
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choices("transcendmojgingthe", k=rng.randint(700, 3000)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_sufficient_for_small_merge_lists():
    """No continuation changes a token that ends the lookahead before the place where it starts."""
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(8):
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens:
                merges.append((x, y))
                tokens.append(x + y)
        far = bpe.sufficient_lookahead(merges)

        def cut(text, merges=merges):
            parts = list(text)
            for x, y in merges:
                out = []
                for p in parts:
                    if out and out[-1] == x and p == y:
                        out[-1] = x + y
                    else:
                        out.append(p)
                parts = out
            return np.cumsum([len(p) for p in parts]).tolist()

        for _ in range(40):
            head = "".join(rng.choices("abc", k=24))
            ends = {tuple(e for e in cut(head + "".join(rng.choices("abc", k=rng.randint(0, 9)))) if e <= 24 - far) for _ in range(6)}
            assert len(ends) == 1


def test_readable_text_is_incremental(spark, rows, codec):
    assert list(codec.stream_text(np.frombuffer(codec.encode("中 x"), "<u4").tolist()))[-1] == "x "
    docs = rows([(1, "Le Père 中文"), (2, None)], "doc_id bigint, text string")
    encoded = bpe.encode_decode(docs, PATH)
    assert {r.doc_id: r.text for r in bpe.readable(encoded, PATH).collect()} == {1: "le père 中文 ", 2: ""}


def test_odd_rows(spark, rows):
    data = [(None, "a", "x"), (1, None, "y"), (1, None, "y"), (2, "", None)]
    docs = rows(data, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in bpe.encode_decode(docs, PATH).collect())
    assert got == [(0, 4, "a</w>"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert bpe.digests(bpe.encode_decode(docs.limit(0), PATH)).collect() == []


def test_frequent_pieces_stay_cached_and_short_merges_equal_long_ones(monkeypatch):
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    made = []
    transduce = codec.transduce
    monkeypatch.setattr(bpe, "_CACHED", 10)
    monkeypatch.setattr(codec, "transduce", lambda symbols: (made.append(symbols), transduce(symbols))[1])
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 12)) + chr(97 + i // 26) for i in range(100)]
    ids = [codec.encode(f"hello {word}") for word in words]
    assert len(made) == len({*words}) + 1
    monkeypatch.setattr(bpe, "_SHORT", 0)
    fresh = bpe.Codec(open(PATH, encoding="utf-8").read())
    assert [fresh.encode(f"hello {word}") for word in words] == ids
    assert codec.decode_all([*ids, b""]).to_pylist() == [*map(codec.decode, ids), ""]
