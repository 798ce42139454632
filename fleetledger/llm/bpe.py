"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding."""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of this kind of tokenizer file: the mark of a word's end, white space, and what a piece is.
WORD_END = "</w>"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

_BLOCK = 256  # symbols that are merged at a time, besides the lookahead
_CACHED = 200_000  # pieces whose tokens a worker keeps
_SHORT = 64  # symbols up to which merges are made one at a time
_NEVER = 1 << 60
_MAX_FILE = 64 << 20
SCHEMA = "doc_id bigint, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if it is printable Latin-1, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after which a token can no longer change, whatever follows.

    Let two texts differ from some place on. Their merges agree up to a boundary, which only moves left when a merge
    (x, y) happens in one of them alone, because y starts at the boundary there. So y was left over or made by an earlier merge at
    that boundary. ``reach[t]`` is the farthest from the first difference that a boundary with token t to its right can be; the rules
    move it in order of rank, each by the symbols of x. The largest reach is sufficient.
    """
    reach: dict[str, int] = {}
    for x, y in merges:
        moved = reach.get(y, 0) + len(x.replace(WORD_END, ""))
        reach[x + y] = max(reach.get(x + y, 0), reach.get(x, 0), moved)
        reach[x] = max(reach.get(x, 0), moved)
    return max(reach.values(), default=0)


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + WORD_END] for c in letters]
        self.rank = {(vocab[x], vocab[y]): r for r, (x, y) in reversed(list(enumerate(merges)))}
        self.rules = [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges]
        self.width = {i: len(t.removesuffix(WORD_END)) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.pieces = regex.compile(PIECES).findall
        self.token = {i: t for t, i in chain(vocab.items(), special.items())}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.raw = {i: bytes(byte_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END) for t, i in vocab.items()}
        self.raw |= {i: t.encode() for t, i in special.items()}
        self.texts = pa.array(map(self.token.get, range(max(self.token) + 1)), pa.string())
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _merge(self, ids: list[int]) -> list[int]:
        if len(ids) <= _SHORT:
            return self._merge_short(ids)
        while len(ids) > 1:
            best = min(map(self.rank.get, zip(ids, ids[1:]), repeat(_NEVER)))
            if best == _NEVER:
                break
            x, y, xy = self.rules[best]
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == x and i + 1 < n and ids[i + 1] == y:
                    out.append(xy)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The first pair of the least rank at a time; only the ranks beside it change."""
        rank, rules, ids = self.rank.get, self.rules, ids[:]
        ranks = list(map(rank, zip(ids, ids[1:]), repeat(_NEVER)))
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i] = rules[best][2]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
        return ids

    def transduce(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece, given its symbols one by one; a token goes out as soon as it is stable.

        At most a block and the lookahead are held. What is kept starts at a token's end, and merging from there gives the same
        tokens, as no merge crossed it.
        """
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= _BLOCK + 2 * self.lookahead:
                stable, at = len(held) - self.lookahead, 0
                for t in self._merge(held):
                    if at + self.width[t] > stable:
                        break
                    yield t
                    at += self.width[t]
                held = held[at:]
        yield from self._merge(held)

    def _piece(self, piece: str) -> bytes:
        found = self._cache.get(piece)
        if found is None:
            found = self._older.get(piece)
            if found is not None:
                self._keep(piece, found)
                return found
            raw = piece.encode()
            symbols = chain(map(self.inner.__getitem__, raw[:-1]), (self.last[raw[-1]],))
            found = np.fromiter(self.transduce(symbols), "<u4").tobytes()
            if len(raw) <= 64:
                self._keep(piece, found)
        return found

    def _keep(self, piece: str, found: bytes) -> None:
        # Two halves: what the younger one did not use again goes when it is full, frequent pieces stay.
        if len(self._cache) >= _CACHED // 2:
            self._cache, self._older = {}, self._cache
        self._cache[piece] = found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = self.split_special(text) if self.split_special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.append(b"".join(map(self._piece, self.pieces(plain))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The token texts with a space between, as a decoder without rules of its own gives them."""
        return self.decode_all([ids])[0].as_py()

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """``decode`` of every entry, as an Arrow array: one look-up of all tokens, one join of each list."""
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        tokens = self.texts.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        if tokens.null_count:
            raise KeyError("an id has no token")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")

    def stream_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text piece by piece: word ends become spaces, bytes become characters as soon as they are complete.

        The state is an unfinished UTF-8 sequence of at most three bytes; malformed bytes give U+FFFD.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.raw[i]):
                yield text
        if rest := machine.decode(b"", True):
            yield rest


@lru_cache(maxsize=4)
def _codec(source: str) -> Codec:
    return Codec(source)


class _Shared:
    """The tokenizer file as a broadcast, parsed once in a worker."""

    def __init__(self, spark, path: str):
        source = Path(path).read_text(encoding="utf-8")
        if len(source) > _MAX_FILE:
            raise ValueError(f"a tokenizer file of over {_MAX_FILE} bytes is not broadcast")
        self.source = spark.sparkContext.broadcast(source)

    def codec(self) -> Codec:
        return _codec(self.source.value)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every document: the ids as packed little-endian unsigned 32-bit numbers, and the
    text that the ids decode to.

    The file is read on the driver (64 MB at most) and broadcast. Whole texts are encoded, each by itself. A null text is an empty
    one and gives no id and an empty decoded text. Strings of special tokens in a text become special tokens. Repeated rows and
    null ids are kept; other columns are ignored.
    """
    shared = _Shared(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            size, ids, first = 0, [], 0
            for row, text in enumerate(batch.column("text")):
                ids.append(codec.encode(text.as_py() or ""))
                size += len(ids[-1])
                if size > 2 << 20 or row == batch.num_rows - 1:
                    columns = [batch.column("doc_id")[first : row + 1], pa.array(ids, pa.binary()), codec.decode_all(ids)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
                    size, ids, first = 0, [], row + 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def readable(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text): packed ``ids`` as readable text, decoded incrementally."""
    shared = _Shared(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            texts = ["".join(codec.stream_text(np.frombuffer(i.as_py() or b"", "<u4").tolist())) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
