"""Line dedup with a log-template tree of fixed depth.

A line of at least ``MIN_TOKENS`` tokens goes down the tree by its number of tokens and its ``LEADING`` first tokens (any token
with a digit counts as a variable field; at least half of a line's and of a template's tokens are constant). A shorter line, or one
of mostly variable fields, is too little to generalise from: it is a template of its own, by its literal tokens. Blank lines are none.
Within a leaf, a line joins the most similar template if at least ``SIMILARITY`` of
its tokens agree, and positions where they differ become variable; else it begins a template. A template that recurs in
``MIN_TEXTS`` different texts is boilerplate: its lines are dropped everywhere but in the first document that has it.

Equal texts count once, so copies of a document don't turn its lines into boilerplate. A first pass counts lines by hash, and
leaves that too few texts reach are left out before any line's text is shuffled; each remaining leaf is read as a sorted
stream. Only dropped lines, and one row per text, meet the documents again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vastlin.llm.shared import boxed, checkpointed, hot_keys, salted_join, unboxed
from vastlin.llm.text import add_columns, chunks, text_of

MIN_TOKENS, LEADING, SIMILARITY, MIN_TEXTS = 5, 3, 0.7, 5
VARIABLE = "<*>"
_DIGIT = re.compile("[0-9]")


def masked(line: str) -> list[str]:
    """The tokens of a line, those with a digit as variables."""
    tokens = line.split()
    if _DIGIT.search(line):
        has_digit = _DIGIT.search
        return [VARIABLE if has_digit(t) else t for t in tokens]
    return tokens


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def general(tokens: list[str], min_tokens: int) -> bool:
    """Whether a line of these masked tokens may be generalised; another one is matched literally."""
    return len(tokens) >= min_tokens and 2 * tokens.count(VARIABLE) <= len(tokens)


def literal(line: str) -> int:
    """The name of a line that is matched literally, which is also its leaf; no masked line has a line feed."""
    return _hash("\n" + " ".join(line.split()))


#: Slots of the fixed-size map of busy leaves that a second pass looks at; a slot that several leaves share only costs work.
SLOTS = 1 << 22


def lines_of(docs: DataFrame, text: str, min_tokens: int, leading: int, busy=None) -> DataFrame:
    """(_text_hash, leaf, line) of every line but blank ones, once per row, by the hash of its masked tokens or, with leaf = line, its literal ones.

    With a broadcast map of busy leaves: (leaf, line, sample), the masked lines of those leaves, once per chunk, without literal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                of, leaves, keys, kept, seen = [], [], [], [], set()
                for h, t in zip(batch.column(0).to_pylist(), text_of(batch, text).to_pylist(), strict=True):
                    if busy is None:
                        seen = set()
                    for line in (t or "").split("\n"):
                        tokens = masked(line)
                        if general(tokens, min_tokens):
                            leaf = _hash(f"{len(tokens)} " + " ".join(tokens[:leading]))
                            if busy is None or busy.value[leaf % SLOTS]:
                                joined = " ".join(tokens)
                                k = _hash(joined)
                                if k not in seen:
                                    seen.add(k)
                                    of.append(h)
                                    leaves.append(leaf)
                                    keys.append(k)
                                    kept.append(joined)
                        elif tokens and busy is None:
                            k = literal(line)
                            if k not in seen:
                                seen.add(k)
                                of.append(h)
                                leaves.append(k)
                                keys.append(k)
                first = pa.array(of, pa.int64()) if busy is None else None
                rest = [pa.array(leaves, pa.int64()), pa.array(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays([first, *rest], ["_text_hash", "leaf", "line"]) if busy is None else pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.string())], ["leaf", "line", "sample"])

    return docs.select("_text_hash", text).mapInArrow(run, "_text_hash long, leaf long, line long" if busy is None else "leaf long, line long, sample string")


def grow(rows: Iterator[tuple[int, int, str]], similarity: float) -> Iterator[tuple[int, int]]:
    """(line, template) from (leaf, line, masked line) rows sorted by leaf and line; a template is named by its first line."""
    of, templates = None, []
    for leaf, line, sample in rows:
        if leaf != of:
            of, templates = leaf, []
        tokens = sample.split(" ")
        best, most = None, similarity * len(tokens)
        for name, template in templates:
            same = sum(a == b or b == VARIABLE for a, b in zip(tokens, template, strict=True))
            fixed = sum(a == b and b != VARIABLE for a, b in zip(tokens, template, strict=True))
            if same >= most and 2 * fixed >= len(tokens) and (best is None or same > most):
                best, most = (name, template), same
        if best is None:
            templates.append((line, tokens))
            yield line, line
        else:
            name, template = best
            for i, (a, b) in enumerate(zip(tokens, template, strict=True)):
                if a != b:
                    template[i] = VARIABLE
            yield line, name


def recurring(docs: DataFrame, one: DataFrame, text: str, min_tokens: int, leading: int, similarity: float, min_texts: int) -> DataFrame:
    """(_text_hash, line, keep_key, keep_hash): the lines of recurring templates in every text, and the first document of the template.

    ``one`` holds the smallest key of each text as ``_first``. Lines and templates that many texts share are dealt over several tasks.
    """
    # equal texts fall together here, before lines are counted
    met = checkpointed(lines_of(docs, text, min_tokens, leading).distinct())
    counts = checkpointed(met.groupBy("leaf", "line").agg(F.count("*").alias("n")))
    busy = counts.where("leaf <> line").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_texts).select("leaf")
    slots = np.zeros(SLOTS, bool)
    slots[busy.select(F.pmod("leaf", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(slots)
    lines = lines_of(docs, text, min_tokens, leading, sent).groupBy("leaf", "line").agg(F.min("sample").alias("sample")).join(busy, "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple[int, int]] = []
        for pair in grow(rows, similarity):
            out.append(pair)
            if len(out) == 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    alone = counts.where((F.col("leaf") == F.col("line")) & (F.col("n") >= min_texts)).select("line", F.col("line").alias("template"))
    tree = checkpointed(lines.select("leaf", "line", "sample").repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(run, "line long, template long").unionByName(alone))
    placed = salted_join(met.select("_text_hash", "line"), tree, "line", hot_keys(counts, "line"), F.col("_text_hash"))
    # texts of a template: distinct ones, since a text may have several of its lines
    texts = placed.join(one.select("_text_hash", "_first"), "_text_hash").groupBy("template", "_text_hash").agg(F.min("_first").alias("_first"))
    counted = texts.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("_first", "_text_hash")).alias("f")).where(F.col("n") >= min_texts)
    drop = checkpointed(counted.select("template", "n", F.col("f._first").alias("keep_key"), F.col("f._text_hash").alias("keep_hash")))
    return salted_join(placed, drop.drop("n"), "template", hot_keys(drop, "template"), F.col("_text_hash")).select("_text_hash", "line", "keep_key", "keep_hash")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["line", "template"])


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_tokens: int = MIN_TOKENS, leading: int = LEADING, similarity: float = SIMILARITY, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with the boilerplate lines cut from the text, and ``n_lines`` and ``n_dropped``.

    The first document of a template, the one of smallest key (a null key comes first) and then smallest text hash, keeps its lines.
    Lines end at a line feed; the other lines keep their bytes and order. Null texts stay null with no lines, an empty text
    has one line. Rows with equal key and text get equal results, so repeated rows stay repeated. Columns named
    as the two counts are replaced.
    """
    # null texts have no lines, and go by their keys, not all to one task
    marked = boxed(docs, text, _key=F.col(key), _text_hash=F.xxhash64(F.coalesce(F.col(text), F.col(key).cast("string"))))
    one = checkpointed(marked.where(F.col("_text").isNotNull()).groupBy("_text_hash").agg(F.min("_key").alias("_first"), F.count("*").alias("n")))
    drop = recurring(marked, one, "_text", min_tokens, leading, similarity, min_texts)
    of_text = drop.groupBy("_text_hash").agg(F.collect_list(F.struct("line", "keep_key", "keep_hash")).alias("_drop"))
    met = salted_join(marked, of_text, "_text_hash", hot_keys(one, "_text_hash"), F.col("_key"), "left")
    mine = F.filter("_drop", lambda d: ~(d["keep_key"].eqNullSafe(F.col("_key")) & (d["keep_hash"] == F.col("_text_hash"))))
    met = met.select("_row", "_text", F.transform(F.coalesce(mine, F.array()), lambda d: d["line"]).alias("_lines"))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out, n_lines, n_dropped = [], [], []
        for t, gone in zip(text_of(batch, "_text").to_pylist(), text_of(batch, "_lines").to_pylist(), strict=True):
            lines = t.split("\n") if t is not None else []
            kept = lines
            if gone:
                gone = set(gone)
                name = lambda x: _hash(" ".join(tokens)) if general(tokens := masked(x), min_tokens) else literal(x) if tokens else None
                kept = [x for x in lines if name(x) not in gone]
            out.append(t if len(kept) == len(lines) else "\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return [pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    fields = [T.StructField("_left", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    done = add_columns(met, "_text", make, fields)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return unboxed(done, own, **{text: F.col("_left"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})


def clean(docs: DataFrame) -> DataFrame:
    """The query: doc_id, n_lines, n_dropped and the text that is left of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
