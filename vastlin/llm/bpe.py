"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list in the usual (proper) form, where both halves of each merge are base symbols or were
made by earlier merges, applies its merges in the order of their ranks. Two facts follow, and the
transducer rests on them:

* the tokens before any token boundary are the encoding of the text before it, so each prefix of a
  pre-token has one last token: the one whose neighbour before it is *compatible*, that is, the
  merges that build the two tokens never reach across their common edge (``_compatible``);
* whether a merge happens depends on symbols to its right only through merges of lower rank that
  could take its right half first. ``lookahead`` follows such chains through the merge list once and
  gives the number of symbols that is always enough.

``Encoder.push`` reads symbols, ``stable`` emits tokens that every live continuation shares, and the
state never holds more than the longest token plus the lookahead. Decoding is a state machine from
ids to bytes to text (``Decoder``), with at most three pending bytes.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vastlin.llm.text import chunks, tidy

#: White space that the normaliser folds (the Unicode White_Space property).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FOLDED = regex.compile(f"[{SPACE}]+")
#: str.split() also splits at these.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Entries of each cache of a Python worker; a full cache starts anew, so memory stays constant.
CACHE = 200_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file of the BPE kind says; raises ValueError on parts that are not supported."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE merge lists are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.text = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {kinds}")
        self.nfc, self.fold, self.lower = "NFC" in kinds, "Replace" in kinds, "Lowercase" in kinds
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        found = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
        self.add_space = any(p.get("add_prefix_space") for p in parts if p["type"] == "ByteLevel")
        default = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = (found[0] if found else default).replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = self.ids[a], self.ids[b]
            new = self.ids[a + b]
            for x in (left, right):
                if x not in self.made and len(self.text[x].removesuffix(self.end) if self.end else self.text[x]) > 1:
                    raise ValueError("the merge list uses a token before it is made")
            self.rank[left, right] = (r, new)
            if new in self.parts:
                raise ValueError("a token is made by two merges")
            self.parts[new] = (left, right)
            self.made[new] = r
        self.longest = max((self.width(i) for i in self.ids.values()), default=1)

    def width(self, token: int) -> int:
        """Symbols of a token."""
        s = self.text[token]
        return len(s.removesuffix(self.end)) if self.end else len(s)

    def lookahead(self) -> int:
        """Symbols after a merge's left half that decide whether the merge takes place.

        A merge (x, y) waits for y, and y or a token at y's right edge can be taken away first only by
        a merge of lower rank with what follows; that one waits in turn. One pass in rank order
        keeps, for each token, the longest wait of the merges seen so far that it begins.
        """
        best: dict[int, int] = {}
        most = 0
        for (x, y), _ in sorted(self.rank.items(), key=lambda p: p[1][0]):
            edge, wait = y, 0
            while True:
                wait = max(wait, best.get(edge, 0))
                if edge not in self.parts:
                    break
                edge = self.parts[edge][1]
            reach = self.width(y) + wait
            best[x] = max(best.get(x, 0), reach)
            most = max(most, reach)
        return most


class Encoder:
    """Encodes pre-tokens symbol by symbol; ``encode`` does a whole text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.marks = tuple(vocabulary.special)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.words = _Cache(self._word)
        self.pieces = _Cache(self._piece)
        self.wait = vocabulary.lookahead()
        #: Tokens without the word end, those with it (by what is before it), and the symbols of the
        #: longest token by its first four symbols.
        end = vocabulary.end
        self.inner = {s: i for s, i in vocabulary.ids.items() if not (end and s.endswith(end))}
        self.final = {s.removesuffix(end): i for s, i in vocabulary.ids.items() if s.endswith(end)} if end else self.inner
        self.reach: dict[str, int] = {}
        for s, i in vocabulary.ids.items():
            head, width = s.removesuffix(end)[:4] if end else s[:4], vocabulary.width(i)
            self.reach[head] = max(self.reach.get(head, 3), width)
        #: Proper prefixes of tokens, which tell whether a boundary is still live.
        self.prefixes = {s[:i] for s in vocabulary.ids for i in range(1, len(s))}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token, from the base symbol up, each with the rank that ends it."""
        key = (token, side)
        if (found := self.spines.get(key)) is None:
            path, until, at = [], float("inf"), token
            while True:
                path.append((at, until))
                if at not in self.v.parts:
                    break
                until = self.v.made[at]
                at = self.v.parts[at][side]
            if len(self.spines) > CACHE:
                self.spines.clear()
            found = self.spines[key] = path[::-1]
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are.

        Both edges grow in rank order. A merge across the edge happens if its rank comes before what
        ends the left edge token, and not after what ends the right one (equal ranks go leftmost first).
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        left, right, rank, i, j, fine = self._spine(a, 1), self._spine(b, 0), self.v.rank, 0, 0, True
        while True:
            x, x_end = left[i]
            y, y_end = right[j]
            if (r := rank.get((x, y))) and r[0] < x_end and r[0] <= y_end:
                fine = False
                break
            if x_end == y_end == float("inf"):
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def transduce(self, symbols: Iterator[str]) -> Iterator[int]:
        """Token ids of one pre-token given as an iterator of byte symbols, each as soon as it is stable.

        ``last[i]`` is the last token of the prefix that ends at i. The window begins at the last
        boundary that was emitted.
        """
        ids, end, compatible, longest = self.v.ids, self.v.end, self._compatible, self.v.longest
        window, last, before = "", [-1], -1
        limit = self.wait + 2 * longest
        upcoming = next(symbols, None)
        while upcoming is not None:
            window += upcoming
            upcoming = next(symbols, None)
            i = len(window)
            suffix = end if upcoming is None else ""
            for start in range(max(0, i - longest), i):
                token = ids.get(window[start:] + suffix)
                if token is not None and ((prev := last[start]) < 0 or compatible(prev, token)):
                    last.append(token)
                    break
            else:
                last.append(-2)  # only a prefix that no text of this alphabet ends at
            if i >= limit and upcoming is not None:
                done, keep = self._stable(window, last)
                yield from done
                if done:
                    before = done[-1]
                    window, last = window[keep:], [before, *last[keep + 1 :]]
        yield from self._chain(last, len(window))

    def _chain(self, last: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= self.v.width(last[at])
        return out[::-1]

    def _stable(self, window: str, last: list[int]) -> tuple[list[int], int]:
        """The tokens that the chains of all live boundaries share, and where they end."""
        n, v = len(window), self.v
        live = [j for j in range(max(0, n - v.longest), n + 1) if last[j] >= -1 and (j == n or window[j:] in self.prefixes)]
        paths = []
        for j in live:
            at, path = j, [j]
            while at:
                at -= v.width(last[at])
                path.append(at)
            paths.append(set(path))
        shared = max(set.intersection(*paths), default=0)
        return self._chain(last, shared), shared

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token, as little-endian int32."""
        symbols = word if word.isalpha() and word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return array("i", self._short(symbols) if len(symbols) <= self.wait else self.transduce(iter(symbols))).tobytes()

    def _short(self, symbols: str) -> list[int]:
        """The tokens of a pre-token that fits in the lookahead, so that nothing is emitted before its end.

        Walks the same boundaries as ``transduce``, longest compatible token first; a boundary from
        which no token fits is dead, and the walk returns to the one before it.
        """
        inner, final, pairs, compatible, reach = self.inner.get, self.final.get, self.pairs.get, self._compatible, self.reach.get
        n, at, prev = len(symbols), 0, -1
        out, begins, dead = [], [], set()
        stop = reach(symbols[:4], 3)
        while at < n:
            token = None
            if stop >= n:
                token, stop = final(symbols[at:]), n
                if token is None or (prev >= 0 and not ((fine := pairs(prev << 32 | token)) or (fine is None and compatible(prev, token)))):
                    token, stop = None, n - 1
            if token is None:
                while stop > at:
                    if (token := inner(symbols[at:stop])) is not None and stop not in dead and (prev < 0 or (fine := pairs(prev << 32 | token)) or (fine is None and compatible(prev, token))):
                        break
                    stop -= 1
            if stop > at:
                out.append(token)
                begins.append(at)
                prev, at = token, stop
                stop = at + reach(symbols[at : at + 4], 3)
            else:
                dead.add(at)
                stop = at - 1
                at = begins.pop()
                out.pop()
                prev = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> bytes:
        """The ids of text between white space."""
        found = self.find(piece)
        return self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def _segment(self, text: str) -> bytes:
        v = self.v
        plain = text.isascii()
        if v.nfc and not plain:
            text = unicodedata.normalize("NFC", text)
        if v.lower:
            text = text.lower() if plain else text.replace("Σ", "σ").lower()
        if not v.fold:
            if v.add_space and text[:1] != " ":
                text = " " + text
            return b"".join(map(self.words.__getitem__, self.find(text)))
        return b"".join(map(self.pieces.__getitem__, _FOLDED.split(text) if _SEPARATORS.search(text) else text.split()))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32; the added tokens' strings count as those tokens."""
        if not text:
            return b""
        if self.split is None or not any(m in text for m in self.marks):
            return self._segment(text)
        special = self.v.special
        return b"".join(np.array([special[s]], "<i4").tobytes() if s in special else self._segment(s) for s in self.split(text) if s)


class _Cache(dict):
    """A bounded memo."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(key) > 64:  # long strings aren't worth their memory
            return self.make(key)
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Decoder:
    """From ids to text, id by id: ``push`` returns what has become certain, ``close`` the rest.

    Byte-level decoders turn symbols into bytes and bytes into text through an incremental UTF-8
    machine (a bad sequence becomes U+FFFD); without a decoder, tokens are joined by one space.
    Ids that the vocabulary doesn't have are skipped.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.reset()

    def reset(self) -> None:
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, token: int) -> str:
        s = self.v.text.get(token)
        if s is None:
            return ""
        if self.v.byte_decoder:
            raw = s.encode() if s in self.v.special else bytes(self.byte[c] for c in s)
            return self.utf8.decode(raw)
        out = " " + s if self.begun else s
        self.begun = True
        return out

    def close(self) -> str:
        out = self.utf8.decode(b"", True)
        self.reset()
        return out

    def decode(self, ids: np.ndarray) -> str:
        if not self.v.byte_decoder:  # the machine's only state is whether a token came before
            text = self.v.text
            return " ".join([text[i] for i in ids.tolist() if i in text])
        out = "".join([self.push(i) for i in ids.tolist()])
        return out + self.close()


_loaded: dict[str, tuple[Encoder, Decoder]] = {}


def machines(path: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a file, loaded once per Python worker."""
    if path not in _loaded:
        v = Vocabulary(path)
        _loaded[path] = (Encoder(v), Decoder(v))
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the text that these ids decode to.

    A null or empty text has no ids and decodes to an empty text. Rows are independent of one
    another, so repeated rows and ids stay as they are; a column already named as one of the two results is
    replaced. No shuffle; memory is one batch and the bounded caches.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(path)
        for whole in batches:
            for batch in chunks(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                raw = [encoder.encode(t or "") for t in texts]
                flat = np.frombuffer(b"".join(raw), "<i4")
                off = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raw], out=off[1:])
                back = pa.array([decoder.decode(flat[off[i] : off[i + 1]]) for i in range(len(raw))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32())), back], [*keep, ids, decoded])
        tidy()

    return docs.select(*keep).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode_decode(docs.select("doc_id", "text"), path)
    listed = F.translate(F.col("token_ids").cast("string"), "[],", "")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
