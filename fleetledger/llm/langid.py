"""Language identification with a bidirectional gated recurrent network over bytes, trained in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_SEGMENT = 128  # bytes after which the state starts anew
_BLOCK = 2048  # segments that run side by side


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; the first axis is the direction. ``inputs`` holds the input weights and biases of every byte."""

    inputs: np.ndarray  # 2, 256, 3 * hidden: update gate, reset gate, candidate
    state: np.ndarray  # 2, hidden, 3 * hidden
    out: np.ndarray  # 2, hidden, languages
    bias: np.ndarray  # languages

    @classmethod
    def random(cls, hidden: int, languages: int, rng: np.random.Generator) -> Network:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            draw(2, 256, 3 * hidden, scale=0.3),
            draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
            draw(2, hidden, languages, scale=hidden**-0.5),
            np.zeros(languages, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.out, self.bias]

    def run(self, x: np.ndarray, valid: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States after every byte, (time, direction, text, hidden), of bytes (time, text); the backward direction in its own
        order. Where ``valid`` is false the state is zero. ``keep`` gets what the backward pass needs."""
        hidden = self.state.shape[1]
        both = np.stack([x, x[::-1]], 1)
        states = np.empty((len(x), 2, x.shape[1], hidden), np.float32)
        h = np.zeros(states.shape[1:], np.float32)
        rows = self.inputs.reshape(512, -1)
        both = both.astype(np.intp) + np.array([0, 256])[:, None]
        for t in range(len(x)):
            e, a = rows[both[t]], h @ self.state
            gates = _sigmoid(e[..., : 2 * hidden] + a[..., : 2 * hidden])
            z, r = gates[..., :hidden], gates[..., hidden:]
            inner = a[..., 2 * hidden :]
            n = np.tanh(e[..., 2 * hidden :] + r * inner)
            before, h = h, n + z * (h - n)
            if valid is not None:
                h *= np.stack([valid[t], valid[len(x) - 1 - t]])[..., None]
            states[t] = h
            if keep is not None:
                keep.append((before, z, r, inner, n))
        return states

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Probability of each language at every position, (time, text, language)."""
        logits = states[:, 0] @ self.out[0] + states[::-1, 1] @ self.out[1] + self.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Backpropagation through time of the mean cross-entropy over all positions of bytes (time, text)."""
        keep: list = []
        states = self.run(x, None, keep)
        p = self.positions(states)
        steps, size = x.shape
        loss = -np.log(np.maximum(p[:, np.arange(size), y], 1e-9)).mean()
        p[:, np.arange(size), y] -= 1
        d = p / (steps * size)
        ahead, back = states[:, 0], states[::-1, 1]
        flat = d.reshape(-1, d.shape[-1])
        d_out = np.stack([s.reshape(-1, s.shape[-1]).T @ flat for s in (ahead, back)])
        from_out = np.stack([d @ self.out[0].T, (d @ self.out[1].T)[::-1]], 1)
        d_state, d_rows = np.zeros_like(self.state), np.zeros((512, self.inputs.shape[-1]), np.float32)
        dh = np.zeros_like(states[0])
        both = np.stack([x, x[::-1]], 1).astype(np.intp) + np.array([0, 256])[:, None]
        for t in range(steps - 1, -1, -1):
            before, z, r, inner, n = keep[t]
            dh = dh + from_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], -1)
            d_state += before.transpose(0, 2, 1) @ da
            np.add.at(d_rows, both[t], np.concatenate([dz, dr, dn], -1))
            dh = dh * z + da @ self.state.transpose(0, 2, 1)
        return [d_rows.reshape(self.inputs.shape), d_state, d_out, flat.sum(0)], float(loss)


def train(segments: list[bytes], labels: np.ndarray, languages: int, hidden: int = 8, steps: int = 160, seed: int = 7) -> Network:
    """Adam over batches of segments of equal length, languages drawn evenly."""
    rng = np.random.default_rng(seed)
    net = Network.random(hidden, languages, rng)
    x = np.stack([np.frombuffer(s, np.uint8) for s in segments], 1)
    of = [np.flatnonzero(labels == k) for k in range(languages)]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, 256 // languages + 1) for o in of if len(o)])
        grads, _ = net.gradients(x[:, pick], labels[pick])
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        for w, g, m, v in zip(net.weights(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


@dataclass
class Model:
    network: Network
    languages: list[str]

    def pooled(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that lie end to end in ``data``, parted at ``at``: the mean probability of each language over all
        positions, and the share of positions that each language labels."""
        sizes = np.diff(at)
        pieces = -(-sizes // _SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = np.repeat(at[:-1], pieces) + _SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(start + _SEGMENT, at[1:][doc]) - start
        order = np.argsort(-length, kind="stable")
        shape = (len(sizes), len(self.languages))
        total, labelled = np.zeros(shape), np.zeros(shape)
        for i in range(0, len(order), _BLOCK):
            some = order[i : i + _BLOCK]
            steps = int(length[some[0]])
            place = np.arange(steps)[:, None]
            valid = place < length[some]
            x = data[np.minimum(start[some] + place, len(data) - 1)]
            whole = bool(valid.all())
            p = self.network.positions(self.network.run(x, None if whole else valid))
            label = p.argmax(-1)
            if not whole:
                p *= valid[..., None]
                label = np.where(valid, label, -1)
            summed = p.sum(0, dtype=np.float64)
            for k in range(shape[1]):
                total[:, k] += np.bincount(doc[some], summed[:, k], shape[0])
                labelled[:, k] += np.bincount(doc[some], (label == k).sum(0), shape[0])
        return total / np.maximum(sizes, 1)[:, None], labelled / np.maximum(sizes, 1)[:, None]

    def label_bytes(self, text: str) -> list[str]:
        """The language of every byte of a text, in segments as in ``pooled``."""
        data = np.frombuffer(text.encode(), np.uint8)
        parts = [data[i : i + _SEGMENT, None] for i in range(0, len(data), _SEGMENT)]
        labels = [self.network.positions(self.network.run(x, None)).argmax(-1)[:, 0] for x in parts]
        return [self.languages[k] for part in labels for k in part]


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = 2000, segment: int = 64
) -> Model:
    """Train on labelled documents: on four segments of ``segment`` bytes from places spread over each of ``sample`` documents, chosen
    by the hash of id and text. This bound is the only one; it limits what the driver gets to about 4 MB.

    Rows with a null label or without a letter are not learned from. Without any row every text is ``und``.
    """
    usable = docs.where(F.col(label_col).isNotNull() & has_letter(F.col(text_col)))
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("h", k), F.length("text"))).cast("int") + 1, F.lit(2 * segment)),
    )
    chosen = usable.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), hashed.alias("h"))
    # about four times the sample, so that no task sends its own best ones to the driver in full number
    share = min(1.0, 4 * sample / max(docs.where(F.col(label_col).isNotNull()).count(), 1))
    few = chosen.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).select("h", "label", cut.alias("parts"))
    rows = few.orderBy("h", "label").limit(sample).collect()
    languages = sorted({r.label for r in rows})
    number = {name: k for k, name in enumerate(languages)}
    segments, labels = [], []
    for r in rows:
        for part in r.parts:
            raw = part.encode()
            if len(raw) < segment:
                raw = (raw + b" ") * segment
            segments.append(raw[:segment])
            labels.append(number[r.label])
    if not languages:
        return Model(Network.random(1, 1, np.random.default_rng(0)), [UNKNOWN])
    return Model(train(segments, np.array(labels), len(languages)), languages)


def identify(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, doc_id, lang_pred, score, share) of every document.

    Each byte of the whole text is labelled; ``score`` is the mean probability of the predicted language over all bytes, ``share`` the
    part of them labelled with it. A text that is null or has no letter is ``und`` with score 0. ``row`` is a struct of the columns
    ``carry`` names. Repeated rows and null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() if ok.as_py() else b"" for t, ok in zip(batch.column("text"), batch.column("ok"))]
            at = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
            if not len(raw):
                continue
            mean, share = model.pooled(np.frombuffer(b"".join(raw), np.uint8), at)
            best, some, every = mean.argmax(1), np.diff(at) > 0, np.arange(len(raw))
            names = np.where(some, np.array(model.languages, object)[best], UNKNOWN)
            columns = [
                batch.column("row"), batch.column("doc_id"), pa.array(names.tolist(), pa.string()),
                pa.array(np.where(some, mean[every, best], 0.0)), pa.array(np.where(some, share[every, best], 0.0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "lang_pred", "score", "share"])

    others = [F.col(f"`{c}`") for c in carry or []] or [F.lit(None).cast("int").alias("none")]
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*others).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        has_letter(text).alias("ok"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, doc_id bigint, lang_pred string, score double, share double")


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that the operator does not reject: every one whose prediction is not ``und`` (a null text or
    one without a letter). Short, mixed or unsure texts stay, whatever their score."""
    found = identify(model, docs, id_col, text_col, docs.columns)
    known = found.where(F.col("lang_pred") != UNKNOWN)
    return known.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
