"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has surface features and those of its neighbours; the chain labels it good or bad. Labels exist per
document only, so training is by hard expectation-maximisation: lines begin with their document's label, then lines
of bad documents that the chain itself finds good are relabelled (at least one, the worst, stays bad). Forward-backward
marginals, weighted by line length, give each document its share of good text, and a logistic curve fitted on the
same rows turns that into the probability of label 1.

Training takes a bounded sample (``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_LINES`` lines, by hash of
the id); the model is a few dozen numbers. Scoring reads every whole text without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vastlin.llm.text import BLANKS, Words, add_columns, remainder, text_of, utf8

SAMPLE_DOCS = 6000
SAMPLE_LINES = 2000
#: Lines of all documents of the sample together; the driver needs about 2 KB for each.
SAMPLE_TOTAL = 100_000
#: Documents with a score from here on are predicted to be of quality 1.
THRESHOLD = 0.3

_KINDS = ("upper", "lower", "digit", "space", "stop", "bang", "odd", "bar", "other", "wide")


def _kinds() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)
    for lo, hi, k in ((65, 91, 0), (97, 123, 1), (48, 58, 2), (128, 256, 9)):
        kind[lo:hi] = k
    for chars, k in ((" \t\r\v\f", 3), (".,;:'\"-?", 4), ("!", 5), ("*#$%&@^~=+<>", 6), ("|\\/_{}[]", 7)):
        kind[[ord(c) for c in chars]] = k
    return kind


_KIND = _kinds()


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, each row's first line, and line lengths in bytes. Each row has one line at least."""
    data, off = utf8(column)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    row_of = np.searchsorted(off[1:], breaks, "right")  # of each break
    rows = np.sort(np.concatenate((np.arange(len(off) - 1), row_of)), kind="stable")
    first = np.searchsorted(rows, np.arange(len(off)))
    ends = np.append(starts[1:], len(data))
    last_of_row = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last_of_row, ends, ends - 1)
    length = (ends - starts).astype(np.float64)
    kind = _KIND[data]
    shares = []
    for k in range(len(_KINDS)):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        shares.append((sums[ends] - sums[starts]) / np.maximum(length, 1))
    upper, lower = shares[0], shares[1]
    # words, and runs of three words or whole lines that the row has had before
    w = Words(column, BLANKS)
    words_at = np.searchsorted(w.starts, starts)
    n_words = np.append(words_at[1:], len(w.starts)) - words_at
    again = np.zeros(len(w.hashes))
    if len(w.hashes) > 2:
        of = w.rows()
        three = w.hashes.copy()
        three[2:] += w.hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
        three += of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(three, kind="stable")
        again[order[1:]] = three[order[1:]] == three[order[:-1]]
    sums = np.concatenate(([0], np.cumsum(again)))
    repeated = (sums[words_at + n_words] - sums[words_at]) / np.maximum(n_words, 1)
    x = np.stack([*shares, upper / np.maximum(upper + lower, 1e-9), np.log1p(length) / 5, np.log1p(n_words) / 4, length / np.maximum(n_words, 1) / 10, repeated, (length == 0).astype(float), np.minimum(length, 30) / 30], 1)
    return x, first, length


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line with those of the line before and after it (zeros at a row's ends), squares, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edge = np.zeros((len(x), 2))
    edge[first[:-1], 0] = 1
    edge[first[1:] - 1, 1] = 1
    return np.concatenate((x, np.sqrt(np.abs(x)), before, after, edge, np.ones((len(x), 1))), 1)


def marginals(emission: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of moves between states.

    ``emission`` is the score of good over bad; ``move`` a 2 x 2 matrix of scores. All chains advance together,
    longest first, so a step is a few numpy operations over the chains that are still running.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(1, steps + 1), "right") if steps else []
    forward = np.zeros((len(emission), 2))
    forward[:, 1] = emission
    scores = forward.copy()
    for t in range(1, steps):
        at = start[: running[t]] + t
        prev = forward[at - 1]
        new = np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1]) + scores[at]
        forward[at] = new - new.max(1, keepdims=True)
    backward = np.zeros_like(forward)
    moves = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = start[: running[t + 1]] + t
        ahead = scores[at + 1] + backward[at + 1]
        pair = move[None] + ahead[:, None, :]
        new = np.logaddexp(pair[:, :, 0], pair[:, :, 1])
        backward[at] = new - new.max(1, keepdims=True)
        joint = forward[at][:, :, None] + pair
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    total = forward + backward
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), moves


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: np.ndarray

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(((with_neighbours(x, first) - self.mean) / self.scale) @ self.weights, self.move, first)[0]


def document_evidence(good: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per row: a constant, the length-weighted share of good text, its logit, and log length."""
    weight = length + 1
    share = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    safe = np.clip(share, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(share)), share, np.log(safe / (1 - safe)) / 5, np.log1p(np.add.reduceat(length, first[:-1])) / 8], 1)


def _adam(parameters: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, steps + 1):
        g = gradient(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        parameters = parameters - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return parameters


def fit(x: np.ndarray, first: np.ndarray, length: np.ndarray, quality: np.ndarray, rounds: int = 3, steps: int = 60, ridge: float = 1e-3) -> Model:
    """Hard expectation-maximisation of the chain, then the document curve. One class alone gives that class's rate."""
    f = with_neighbours(x, first)
    mean, scale = f.mean(0), f.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    f = (f - mean) / scale
    of = np.repeat(np.arange(len(quality)), np.diff(first))
    gold = quality[of].astype(float)
    inner = np.ones(len(f), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    parameters = np.zeros(f.shape[1] + 4)
    n = len(f)
    for _ in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[at].astype(int), gold[at + 1].astype(int)), 1)

        def gradient(p, gold=gold, seen=seen):
            good, moves = marginals(f @ p[:-4], p[-4:].reshape(2, 2), first)
            return np.concatenate((f.T @ (good - gold), (moves - seen).ravel())) / n + ridge * p

        parameters = _adam(parameters, gradient, steps, 0.1)
        good, _ = marginals(f @ parameters[:-4], parameters[-4:].reshape(2, 2), first)
        worst = np.minimum.reduceat(good, first[:-1])
        gold = np.where(quality[of] == 1, 1.0, ((good > 0.5) & (good > worst[of])).astype(float))
    evidence = document_evidence(good, first, length)

    def slope(p):
        q = 1 / (1 + np.exp(-np.clip(evidence @ p, -50, 50)))
        return evidence.T @ (q - quality) / len(quality) + 1e-4 * p

    return Model(mean, scale, parameters[:-4], parameters[-4:].reshape(2, 2), _adam(np.zeros(evidence.shape[1]), slope, 1500, 0.05))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", quality: str = "quality", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fits on a bounded sample of rows with a label; None if there is none. Null texts count as empty.

    The sample is drawn from the labels alone, so no text is shuffled: at most ``sample_docs`` keys are broadcast.
    """
    chosen = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(quality).cast("int").alias("_q")).orderBy(F.xxhash64(key), "_q").limit(sample_docs)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k")
    rows = rows.withColumn("_lines", F.length("_t") - F.length(F.translate("_t", "\n", "")) + 1).where(F.col("_lines") <= SAMPLE_LINES)
    # rows may share a key
    rows = rows.orderBy(F.xxhash64("_k"), F.xxhash64("_t"), "_q").limit(sample_docs)
    order = Window.orderBy(F.xxhash64("_k"), F.xxhash64("_t"), "_q")  # over the sample alone
    rows = rows.withColumn("_so_far", F.sum("_lines").over(order)).where(F.col("_so_far") <= SAMPLE_TOTAL)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        x, first, length = line_features(text_of(batch, "_t"))
        off = pa.array(first.astype(np.int32))
        wide = pa.array((first * x.shape[1]).astype(np.int32))
        return [pa.ListArray.from_arrays(wide, pa.array(x.astype(np.float32).ravel())), pa.ListArray.from_arrays(off, pa.array(length.astype(np.float32)))]

    got = add_columns(rows.select("_t", "_q"), "_t", make, [T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("length", T.ArrayType(T.FloatType()))]).select("_q", "x", "length").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    length = got.column("length").combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy().astype(np.float64)
    size = np.diff(length.offsets.to_numpy()[: len(length) + 1])
    flat = length.flatten().to_numpy().astype(np.float64)
    return fit(x.reshape(len(flat), -1), np.concatenate(([0], np.cumsum(size))), flat, (got.column("_q").to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of quality 1), ``predicted`` and ``good_lines``, P(good) of each line.

    A null text counts as empty, which is one empty line. Without a model every score is 0.5. Rows are scored whole and on
    their own, so repeated rows agree; columns of the same names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        x, first, length = line_features(text_of(batch, text))
        m = sent.value
        good = m.lines(x, first) if m else np.full(len(x), 0.5)
        value = 1 / (1 + np.exp(-np.clip(document_evidence(good, first, length) @ m.slope, -50, 50))) if m else np.full(batch.num_rows, 0.5)
        lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good.astype(np.float32)))
        return [pa.array(value), pa.array((value >= threshold).astype(np.int32)), lines]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("good_lines", T.ArrayType(T.FloatType()))]
    return add_columns(docs, text, make, fields)


def held_out(column: str = "doc_id"):
    return remainder(column, 5) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract query: learns from the labelled rows that aren't held out, scores all."""
    model = train(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
