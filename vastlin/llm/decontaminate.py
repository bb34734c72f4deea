"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about ``SHARD_BYTES``. Its words are numbered by the vocabulary of the test
phrases; any other word is a separator, as no phrase holds one, and so are document ends. Runs of known words
long enough for the shortest phrase make the indexed string: suffix array by prefix doubling (separators are distinct,
so equal documents cost no extra rounds), Burrows-Wheeler transform, and a wavelet matrix for ranks. All
distinct phrases are searched backwards at once; occurrences are located by walking to sampled suffix
positions; spans merge per document.

The phrases travel in blocks of at most ``BLOCK_BYTES`` of item text, one pass over the documents for each block, so
nothing that is broadcast grows with the tables.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vastlin.llm.shared import boxed, unboxed
from vastlin.llm.text import NON_ALNUM, Words, add_columns, text_of

WINDOW = 10
SHARD_BYTES = 1 << 20
#: Item text whose windows are held at once; the driver needs about 150 times as much.
BLOCK_BYTES = 2 << 20
SAMPLE = 8


class WaveletMatrix:
    """Symbols below 2**levels with access and rank, as one array of zero counts per level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.zeros, self.counts = len(symbols), levels, [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            ahead = np.zeros(self.n + 1, np.int32)
            np.cumsum(1 - bit, out=ahead[1:])
            self.counts.append(ahead)
            self.zeros.append(int(ahead[-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for k, (ahead, zeros) in enumerate(zip(self.counts, self.zeros, strict=True)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ahead[low], ahead[high]
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, low, here = np.zeros_like(at), np.zeros_like(at), at
        for ahead, zeros in zip(self.counts, self.zeros, strict=True):
            a, b = ahead[here], ahead[low]
            one = ahead[here + 1] == a
            symbol = symbol * 2 + one
            here, low = np.where(one, zeros + here - a, a), np.where(one, zeros + low - b, b)
        return symbol, here - low


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of a string given as dense ranks, by prefix doubling; only tied suffixes are sorted again."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    new = np.concatenate(([True], sorted_ranks[1:] != sorted_ranks[:-1]))
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    step = 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        who = order[tied]
        after = who + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        inner = np.lexsort((key, rank[who]))
        who, key, group = who[inner], key[inner], rank[who[inner]]
        order[tied] = who
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
        rank[who] = tied[start]
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Full-text index of one shard: ``codes`` are symbols from 1 on, and 0 for separators."""

    def __init__(self, codes: np.ndarray, size: int, sample: int = SAMPLE):
        self.n = n = len(codes)
        gap = codes == 0
        ranks = np.where(gap, np.cumsum(gap) - 1, gap.sum() + codes)
        order = suffix_array(ranks)
        self.bwt = WaveletMatrix(codes[order - 1], max(1, int(size).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=size + 1))))
        begins = np.append(True, gap[:-1])  # the walk must end before a separator, whose order the transform doesn't keep
        self.sampled = (order % sample == 0) | begins[order]
        self.marks = np.concatenate(([0], np.cumsum(self.sampled)))
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of symbols; an empty one if it doesn't occur."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.before[c] + self.bwt.rank(c, low[live])
            high[live] = self.before[c] + self.bwt.rank(c, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes of words."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.empty(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            here = at[open_]
            hit = self.sampled[here]
            done = open_[hit]
            out[done] = self.places[self.marks[here[hit]]] + steps[done]
            open_ = open_[~hit]
            c, r = self.bwt.access(at[open_])
            at[open_] = self.before[c] + r
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a block of items, by length."""

    vocabulary: np.ndarray  # sorted word hashes
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # length -> symbols
    items: dict[int, list[np.ndarray]] = field(default_factory=dict)  # length -> items of each window
    names: list[str] = field(default_factory=list)
    shortest: int = WINDOW

    @classmethod
    def of(cls, ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
        names = sorted({str(i) for i, t in zip(ids, texts, strict=True) if i is not None})
        number = {x: k for k, x in enumerate(names)}
        words = Words(pa.array(texts, pa.string()), NON_ALNUM)
        vocabulary = np.unique(words.hashes)
        codes = np.searchsorted(vocabulary, words.hashes) + 1
        found: dict[int, dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, i in enumerate(ids):
            own = codes[words.first[k] : words.first[k + 1]]
            size = min(window, len(own))
            for j in range(len(own) - size + 1 if size else 0):
                found[size][tuple(own[j : j + size].tolist())].add(number.get(str(i), -1) if i is not None else -1)
        out = cls(vocabulary, names=names, shortest=min(found, default=window))
        for size, windows in found.items():
            out.windows[size] = np.array(list(windows), np.int64)
            out.items[size] = [np.array(sorted(x), np.int64) for x in windows.values()]
        return out


def occurrences(words: Words, phrases: Phrases, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """Start and end word of every occurrence in a shard, and the items that occur in each row."""
    items: list[set[int]] = [set() for _ in range(len(words.first) - 1)]
    none = np.zeros(0, np.int64)
    if not len(phrases.vocabulary) or not len(words.hashes):
        return none, none, items
    vocabulary = phrases.vocabulary
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == words.hashes
    # runs of known words within a row
    begins = known.copy()
    begins[1:] &= ~(known[:-1] & (rows[1:] == rows[:-1]))
    start = np.flatnonzero(begins)
    ends = known.copy()
    ends[:-1] &= ~(known[1:] & (rows[1:] == rows[:-1]))
    length = np.flatnonzero(ends) + 1 - start
    start, length = start[length >= phrases.shortest], length[length >= phrases.shortest]
    if not len(start):
        return none, none, items
    # the indexed string: each run and a separator after it
    size = length + 1
    first = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
    codes = np.where(np.arange(first[-1]) == np.repeat(first[1:] - 1, size), 0, at[np.minimum(source, len(at) - 1)] + 1)
    index = FMIndex(codes, len(vocabulary))
    froms, tos = [], []
    for n, windows in phrases.windows.items():
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        many = high[hit] - low[hit]
        which = np.repeat(hit, many)
        spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
        word = source[index.locate(spot)]
        froms.append(word)
        tos.append(word + n)
        for row, w in {(r, w) for r, w in zip(rows[word].tolist(), which.tolist(), strict=True)}:
            items[row].update(phrases.items[n][w].tolist())
    return (np.concatenate(froms), np.concatenate(tos), items) if froms else (none, none, items)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without these spans of UTF-8 bytes, which may overlap."""
    if not spans:
        return text
    raw, at, parts = text.encode(), 0, []
    for start, end in sorted(spans):
        parts.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*parts, raw[at:]]).decode()


def _block(docs: DataFrame, phrases: Phrases, text: str, left: str | None = None, before: str | None = None) -> DataFrame:
    """``docs`` with n_words, the merged hit spans in words and in bytes, and the items.

    With ``left``, only the text without these spans, and those of a column ``before``, under that name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        words = Words(text_of(batch, text), NON_ALNUM)
        rows = words.rows()
        p = sent.value
        froms, tos, items = occurrences(words, p, rows)
        n = len(words.hashes)
        edge = np.bincount(froms, minlength=n + 1)[: n + 1] - np.bincount(tos, minlength=n + 1)[: n + 1]
        covered = np.cumsum(edge)[:n] > 0
        opens = covered.copy()
        opens[1:] &= ~(covered[:-1] & (rows[1:] == rows[:-1]))
        closes = covered.copy()
        closes[:-1] &= ~(covered[1:] & (rows[1:] == rows[:-1]))
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        of = rows[a]
        off = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
        base, byte = words.first[of], words.offsets[of]

        def spans(x: np.ndarray, y: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["start", "end"]))

        if left:
            gone: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
            for row, x, y in zip(of.tolist(), (words.starts[a] - byte).tolist(), (words.ends[b] - byte).tolist(), strict=True):
                gone[row].append((x, y))
            if before:
                gone = [x + [(s["start"], s["end"]) for s in y] for x, y in zip(gone, text_of(batch, before).to_pylist(), strict=True)]
            column = text_of(batch, text)
            return [pa.array([_without(column[i].as_py(), x) if x else column[i].as_py() for i, x in enumerate(gone)], pa.string())]
        names = [[p.names[k] for k in sorted(s) if k >= 0] for s in items]
        return [pa.array(words.counts, pa.int64()), spans(a - base, b + 1 - base), spans(words.starts[a] - byte, words.ends[b] - byte), pa.array(names, pa.list_(pa.string()))]

    if left:
        return add_columns(docs, text, make, [T.StructField(left, T.StringType())], SHARD_BYTES)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("cut_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    return add_columns(docs, text, make, fields, SHARD_BYTES)


def phrase_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, each collected when its turn comes."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.collect()
        yield Phrases.of([r.i for r in got], [r.t for r in got])


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word positions), cut_spans (UTF-8 byte positions) and items.

    Spans are merged, in order, end exclusive. ``items`` are the ids, as text, of items with an occurring window, sorted and
    distinct; items with a null id hit words but are not listed. Null and empty texts have no words. Every row is
    scanned whole and on its own: repeated rows agree. Result columns replace those of the same names.
    """
    out = None
    for phrases in phrase_blocks(items, item_id, item_text, block_bytes):
        out = _block(docs, phrases, text) if out is None else _further(out, phrases, text)
    return out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def _further(out: DataFrame, phrases: Phrases, text: str) -> DataFrame:
    """A further pass, which merges with the spans so far."""
    old = ["hit_spans", "cut_spans", "items"]
    out = _block(out.withColumnsRenamed({c: f"_{c}" for c in old}), phrases, text)
    merged = {c: _merged(F.concat(f"_{c}", c)) for c in old[:2]} | {"items": F.array_sort(F.array_union("_items", "items"))}
    return out.withColumns(merged).drop(*(f"_{c}" for c in old))


def _merged(spans):
    """Sorted union of spans."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def remove(docs: DataFrame, items: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` with the hit spans cut out of the text; rows without hits stay byte for byte."""
    found, last, before = boxed(docs, text), None, None
    for phrases in phrase_blocks(items, "item_id", "text", block_bytes):
        if last is not None:  # spans of all blocks but the last go along
            found = _block(found, last, "_text") if before is None else _further(found, last, "_text")
            found, before = found.select("_row", "_text", "hit_spans", "cut_spans", "items"), "cut_spans"
        last = phrases
    return unboxed(_block(found, last, "_text", "_left", before), docs.columns, **{text: F.col("_left")})


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract columns of every document."""
    found = scan(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
