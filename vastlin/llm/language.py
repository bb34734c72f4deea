"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters of the lower-cased text, with every run of non-letters as a
blank) of all training rows into languages x ``2**bits`` counters; partitions add up locally, so the shuffle
carries at most that many rows per partition. The log-probability matrix has a fixed size and is broadcast;
scoring sums its entries per text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vastlin.llm.text import add_columns, chunks, remainder, text_of

BITS = 15
#: Entries of the matrix, four bytes each, which is broadcast: with more languages than fit, n-grams are hashed to fewer bits.
ENTRIES = 1 << 23
#: Characters whose n-grams are held at once.
WINDOW = 1 << 17
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None], bits: int = BITS, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket and row of every n-gram, whether each row has a letter), for one window of about ``window`` characters after another.

    A long text is cut into windows that see the two characters before them, so its n-grams are those of the whole.
    """
    parts: list[str] = []
    rows: list[int] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[code]
        code = np.where(letter, code, np.uint32(32))
        row = np.repeat(np.array(rows, np.int64), size)
        own = np.ones(len(code), bool)  # the two characters ahead of each part are none of its own
        begin = np.cumsum(size) - size
        own[begin] = own[begin + 1] = False
        one, two, three = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
        a, b, c = code[2:], code[1:-1], code[:-2]
        ids, at = [], []
        for h, keep in ((a * one, letter[2:]), (a * one + b * two + np.uint32(1), letter[2:]), (a * one + b * two + c * three + np.uint32(2), letter[1:-1])):
            keep = keep & own[2:]
            h = h[keep]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            ids.append((h ^ (h >> np.uint32(12))) & np.uint32((1 << bits) - 1))
            at.append(row[2:][keep])
        parts.clear()
        rows.clear()
        return np.concatenate(ids), np.concatenate(at), np.bincount(row[letter & own], minlength=len(texts)) > 0

    for k, t in enumerate(texts):
        lowered = (t or "").lower()
        for i in range(0, len(lowered) or 1, window):
            last = i + window >= len(lowered)
            parts.append(("\0\0" + lowered[:window] if i == 0 else lowered[i - 2 : i + window]) + "\0" * last)
            rows.append(k)
            held += len(parts[-1])
            if held >= window:
                yield flush()
                held = 0
    if parts:
        yield flush()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    bits: int


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, smoothing: float = 0.5) -> Model:
    """Counts over all rows with a language; rows with a null text count only towards the prior."""
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in chunks(whole, text):
                of = np.unique(text_of(batch, lang).to_pylist(), return_inverse=True)
                total = np.zeros(len(of[0]) << bits, np.int64)
                for ids, rows, _ in grams(text_of(batch, text).to_pylist(), bits):
                    total += np.bincount(of[1][rows] << bits | ids, minlength=len(total))
                docs_of = np.bincount(of[1], minlength=len(of[0]))
                for i, name in enumerate(of[0].tolist()):
                    mine = found.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                    mine[:-1] += total[i << bits : (i + 1) << bits]
                    mine[-1] += docs_of[i]
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang).isNotNull())
    names = sorted(r[0] for r in known.select(F.col(lang).cast("string")).distinct().collect())
    while bits > 1 and len(names) << bits > ENTRIES:  # a hash of fewer bits is these bits of a longer one
        bits -= 1
    rows = known.select(text, F.col(lang).cast("string").alias(lang)).mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), (1 << bits) + 1))
    counts[[number[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    grams_of, docs_of = counts[:, :-1] + smoothing, counts[:, -1]
    weights = np.log(grams_of / grams_of.sum(1, keepdims=True)) if names else grams_of
    return Model(names, np.log((docs_of + 1) / (docs_of + 1).sum()) if names else docs_of, weights.astype(np.float32), bits)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language.

    A text that is null or has no letter, and every text if nothing was learned, gets ``und`` and 0. A tie goes to the
    first language in alphabetical order. Whole texts are scored, one row at a time in effect, so repeated rows agree.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m = sent.value
        n = batch.num_rows
        total = np.repeat(m.prior[:, None], n, 1)
        lettered = np.zeros(n, bool)
        for ids, rows, some in grams(text_of(batch, text).to_pylist(), m.bits):
            lettered |= some
            for k, w in enumerate(m.weights):
                total[k] += np.bincount(rows, w[ids], minlength=n)
        if not m.languages:
            return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))]
        best = total.argmax(0)
        score = 1 / np.exp(total - total.max(0)).sum(0)
        names = np.array(m.languages, object)[best]
        names[~lettered] = UNDETERMINED
        return [pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))]

    return add_columns(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out() -> Column:
    return remainder("doc_id", 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """The contract query: learns from the rows that aren't held out, predicts all."""
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
