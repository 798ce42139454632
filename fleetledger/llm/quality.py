"""Quality of documents by ordinal regression: cumulative links with shared hashed-text weights and ordered thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import bind, lists

_BITS = 18
_PRIOR = 10.0  # the ridge on the summed loss: the more ratings, the less it holds back
_SPACE = r"[\x20\x09-\x0D]+"


def features(text: Column) -> Column:
    """Distinct hashed traits of a text: its words without punctuation, the shapes of its words (case and punctuation marks),
    and whether words follow themselves."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.split(F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), _SPACE)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{N}+", "0")

    def pairs(w: Column) -> Column:
        doubled = F.exists(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: (F.get(w, i) == F.get(w, i - 1)) & (F.get(w, i) != ""))
        return F.concat(F.array_distinct(w), F.when(doubled, F.array(F.lit(" twice"))).otherwise(F.array().cast("array<string>")))

    words = bind(plain, pairs)
    shapes = F.transform(F.array_distinct(F.split(shape, _SPACE)), lambda s: F.concat(F.lit(" shape "), s))
    hashed = F.transform(F.concat(words, shapes), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << _BITS)).cast("int"))
    return F.array_distinct(hashed)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """One weight a hashed trait, and thresholds in ascending order: P(grade > k) = sigmoid(sum of weights - threshold k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, traits: np.ndarray) -> np.ndarray:
        """Of each text (traits end to end, parted at ``at``) the probability of a grade above each threshold."""
        sums = np.append(0.0, np.cumsum(self.weights[traits], dtype=np.float64))
        total = sums[at[1:]] - sums[at[:-1]]
        return _sigmoid(total[:, None] - self.thresholds)


def _minimum(of: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, close: float = 1e-5, memory: int = 10) -> np.ndarray:
    """L-BFGS until no slope is over ``close``, for ``steps`` steps at most."""
    value, slope = of(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= close:
            break
        way, shares = -slope, []
        for dx, dg in reversed(moves):
            shares.append(dx @ way / (dx @ dg))
            way = way - shares[-1] * dg
        if moves:
            dx, dg = moves[-1]
            way = way * (dx @ dg / (dg @ dg))
        else:
            way = way / max(np.linalg.norm(way), 1.0)
        for (dx, dg), share in zip(moves, reversed(shares)):
            way = way + (share - dg @ way / (dx @ dg)) * dx
        length = 1.0
        while (ahead := of(x + length * way))[0] > value + 1e-4 * length * (slope @ way) and length > 1e-10:
            length /= 2
        if length <= 1e-10:
            if not moves:
                break
            moves = []
            continue
        dx, dg = length * way, ahead[1] - slope
        x, (value, slope) = x + dx, ahead
        if dx @ dg > 1e-12:
            moves = [*moves, (dx, dg)][-memory:]
    return x


def train(at: np.ndarray, traits: np.ndarray, grades: np.ndarray, top: int, steps: int = 1000, ridge: float = 1e-3) -> Model:
    """Maximum penalised likelihood over all rows, by L-BFGS to convergence. Traits of fewer than four texts keep weight 0, however many
    texts there are; of the others the ridge holds back those that are rare or go with no grade: it is divided by the square of the
    trait's score statistic (about 1 for a trait without any bearing), so that a few telling words are not outweighed by the many others of a text."""
    n, size = len(grades), 1 << _BITS
    count = np.bincount(traits, minlength=size)
    used = np.flatnonzero(count >= 4)
    slot = np.full(size, -1)
    slot[used] = np.arange(len(used))
    owner, mine = np.repeat(np.arange(n), np.diff(at)), slot[traits]
    owner, mine = owner[mine >= 0], mine[mine >= 0]
    share = np.array([(grades > k).mean() for k in range(top)]).clip(0.01, 0.99)
    start = -np.log(share / (1 - share))
    # the first threshold, then the logarithms of the gaps, so that the order holds
    cut = np.append(start[0], np.log(np.maximum(np.diff(start), 1e-2)))
    every = np.arange(n)

    def slopes(w: np.ndarray, cut: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean loss, and its slopes by each text's sum of weights and by ``cut``."""
        gaps = np.exp(cut[1:])
        thresholds = cut[0] + np.append(0.0, np.cumsum(gaps))
        tail = _sigmoid(np.bincount(owner, w[mine], n)[:, None] - thresholds)
        bounds = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        slope = bounds * (1 - bounds)
        p = np.maximum(bounds[every, grades] - bounds[every, grades + 1], 1e-9)
        score = (slope[every, grades + 1] - slope[every, grades]) / p / n
        by_cut = np.zeros((n, top + 2))
        by_cut[every, grades] += slope[every, grades] / p / n
        by_cut[every, grades + 1] -= slope[every, grades + 1] / p / n
        later = np.cumsum(by_cut[:, 1:-1].sum(0)[::-1])[::-1]
        return -np.log(p).mean(), score, np.append(later[0], later[1:] * gaps)

    rest = slopes(np.zeros(len(used)), cut)[1]
    rest = rest - rest.mean()
    statistic = np.bincount(mine, rest[owner], len(used)) / np.sqrt(count[used]) / max(rest.std(), 1e-12)
    held = ridge / (1 + statistic**2)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut = x[: len(used)], x[len(used) :]
        value, score, by_cut = slopes(w, cut)
        by_w = np.bincount(mine, score[owner], len(used)) + held * w
        return value + held @ w**2 / 2, np.append(by_w, by_cut)

    best = _minimum(loss, np.append(np.zeros(len(used)), cut), steps)
    w, cut = np.zeros(size, np.float32), best[len(used) :]
    w[used] = best[: len(used)]
    return Model(w, cut[0] + np.append(0.0, np.cumsum(np.exp(cut[1:]))))


def fit(
    docs: DataFrame, ratings: DataFrame, top: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = 6000
) -> Model:
    """Train on rated documents; grades are 0 to ``top``.

    At most ``sample`` ratings, chosen by hash, are learned from: the only bound. About that many ids are broadcast, and the driver gets
    the hashed traits of their whole texts, 4 bytes each. Ratings with a null or another grade are left out. Without any rating all texts get
    even odds.
    """
    usable = ratings.where(F.col(grade_col).between(0, top)).select(F.col(id_col).cast("bigint").alias("id"), F.col(grade_col).cast("int").alias("grade"))
    share = min(1.0, sample / max(usable.count(), 1))
    few = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * sample)
    rated = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    found = rated.select("grade", features(F.col("text")).alias("traits")).toArrow()
    if not found.num_rows:
        return Model(np.zeros(1 << _BITS, np.float32), np.zeros(top))
    at, traits = lists(found.column("traits"))
    grades = found.column("grade").to_numpy().astype(np.int64)
    return train(at - at[0], traits[at[0] : at[-1]], grades, top, ridge=_PRIOR / len(grades))


def grade(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every document by its whole text.

    ``tail_probability`` is that of grade ``tail`` (the highest, if not given) or more; ``keep`` tells whether it is at least ``least``. A null text is
    an empty one. Repeated rows and null ids are kept; other columns are ignored.
    """
    which = (len(model.thresholds) if tail is None else tail) - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = shared.value.tails(*lists(batch.column("traits")))
            chance = tails[:, which]
            columns = [batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(chance), pa.array(chance >= least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "keep"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), features(F.col(text_col)).alias("traits"))
    return rows.mapInArrow(run, "doc_id bigint, expected_grade double, tail_probability double, keep boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings 0 to 2 from two marks: one point for quality and one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
