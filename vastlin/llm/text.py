"""Vectorised reading of Arrow text batches: chunks, word spans and 64-bit word hashes in numpy.

A batch's text column is used in place (UTF-8 bytes and offsets), so no Python string is made per
word. Nulls count as empty texts here; operators that tell them apart look at the validity bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: UTF-8 bytes handled at once; a longer text is handled alone and whole.
CHUNK_BYTES = 512 << 10


def tidy() -> None:
    """Gives freed memory back to the system, as a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible uint64 values of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A value for each byte, the same for A-Z and a-z.
_BYTE = stream(1, 256)[_FOLD]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        for_all = np.full(size, _BASE, np.uint64)
        for_all[0] = 1
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _powers, _inverse = np.multiply.accumulate(for_all), np.multiply.accumulate(back)


def blank_separators() -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D."""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def alnum_separators() -> np.ndarray:
    """True for every ASCII byte that is no letter and no digit."""
    sep = np.zeros(256, bool)
    sep[:128] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        sep[lo:hi] = False
    return sep


BLANKS, NON_ALNUM = blank_separators(), alnum_separators()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and len + 1 offsets that start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to ``limit`` bytes of text each, or one row."""
    n = batch.num_rows
    if not n:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a column: byte spans, 64-bit hashes (A-Z as a-z), and each row's first word."""

    def __init__(self, column: pa.Array, separators: np.ndarray):
        self.data, self.offsets = utf8(column)
        data, off = self.data, self.offsets
        if len(data):
            word = ~separators[data]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = off[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, off)  # per row, and the end

    @cached_property
    def hashes(self) -> np.ndarray:
        data = self.data
        if not len(data):
            return np.zeros(0, np.uint64)
        _grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers[: len(data)], out=sums[1:])
        length = (self.ends - self.starts).astype(np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * _inverse[self.starts] + length * np.uint64(0xD6E8FEB86659FD93))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; one for the whole sequence if it is shorter, none if empty."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    odd = stream(2, k) | np.uint64(1)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * odd[j]
    return mix(total + np.uint64(size))


def word_hash(text: str) -> int:
    """The hash that Words gives to one word."""
    w = Words(pa.array([text]), np.zeros(256, bool))
    return int(w.hashes[0]) if len(w.hashes) else 0


def add_columns(df, text: str, make, fields: list, limit: int = CHUNK_BYTES):
    """``df`` with the columns that ``make(batch)`` returns for each chunk of whole texts; columns of the same names are replaced.

    No shuffle; a Python worker holds one Arrow batch and the arrays of one chunk.
    """
    from pyspark.sql import types as T

    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text, limit):
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], [*keep, *names])
        tidy()

    return df.select(*keep).mapInArrow(run, schema)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def remainder(column: str, n: int):
    """crc32 of a column as text, modulo n; 0 for null."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))
