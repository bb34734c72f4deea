"""Parts that need no Spark, each against a plain form."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vastlin.llm import bpe, decontaminate, jaccard, passages, quality, simhash, suffix_tree, templates
from vastlin.llm.text import BLANKS, NON_ALNUM, Words, chunks

TEXTS = ["", None, "a", " \n\t ", "The cat  SAT\non é-mat x1", "ÄÖ über\x0bb\x1cc", "z" * 5000, "one two three four five six\n" * 40]


@pytest.mark.parametrize("sep,pattern", [(BLANKS, r"[^\x20\x09-\x0D]+"), (NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(sep, pattern):
    w = Words(pa.array(TEXTS), sep)
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    found = [re.findall(pattern, fold(t)) for t in TEXTS]
    assert w.counts.tolist() == [len(x) for x in found]
    flat = [x for f in found for x in f]
    by = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_chunks_keep_rows_whole():
    b = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    parts = list(chunks(b, "text", 100))
    assert sum(p.num_rows for p in parts) == len(TEXTS) and [x for p in parts for x in p.column(0).to_pylist()] == TEXTS


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_as_the_library(name):
    e, d = bpe.machines(public_tokenizers.path(name))
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rnd = random.Random(4)
    texts = [x or "" for x in TEXTS] + ["<|endoftext|> hi <|endoftext|>x", "naïve\nÅng's'll ½ ǅ İ ΑΣ ΑΣΒ", "\U0001f600日本語 ЖЖ don't I'LL", "thethething" * 300]
    texts += ["".join(rnd.choice("etaoin shrdlu'éß1.,\n") for _ in range(rnd.randint(1, 400))) for _ in range(200)]
    for x in texts:
        ids = np.frombuffer(e.encode(x), "<i4").tolist()
        assert ids == t.encode(x, add_special_tokens=False).ids, x[:80]
        assert d.decode(np.array(ids)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_streams_long_words():
    e, _ = bpe.machines(public_tokenizers.path("word_bpe_49k.json"))
    word = "".join(random.Random(7).choice("aehinorst") for _ in range(4000))
    early = 0
    it = e.transduce(iter(word))
    first = next(it)
    early = [first, *it]
    assert early == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(word, add_special_tokens=False).ids
    assert e.wait > 0


def test_fm_index():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 4, 3000)
    codes[-1] = 0
    index = decontaminate.FMIndex(codes, 3)
    for n in (1, 3, 6):
        phrases = rnd.integers(1, 4, (40, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(codes) - n + 1) if (codes[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array():
    rnd = np.random.default_rng(1)
    s = np.concatenate((rnd.integers(0, 3, 200), np.zeros(100, int)))
    assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def near_sets(rnd, n):
    a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
    cut = rnd.integers(0, n // 4 + 1)
    return a, np.unique(np.concatenate((a[cut // 2 :], rnd.integers(0, 1 << 62, cut - cut // 2).astype(np.uint64))))


def test_prefixes_lose_no_link():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 10, 11, 65, 110, 400, 2000):
        for _ in range(40):
            a, b = near_sets(rnd, n)
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                both = len(np.intersect1d(a[: jaccard.prefix(len(a), 80)], b[: jaccard.prefix(len(b), 80)]))
                assert both >= max(jaccard.need(len(a), 80), jaccard.need(len(b), 80))


def test_cells_hold_every_near_pair():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    cells = [set(c.tolist()) for c in jaccard.cells_of(d[:, :9], 0.3)]
    assert all(any(i in c and j in c for c in cells) for i, j in zip(*np.nonzero(d <= 0.3), strict=True))
    assert max(map(len, cells)) < 300


def test_region_join_by_brute_force():
    rnd = np.random.default_rng(2)
    for trial in range(6):
        sets = []
        for _ in range(25):
            base = np.unique(rnd.integers(0, 400 if trial % 2 else 1 << 40, int(rnd.integers(1, 120))).astype(np.int64))
            for _ in range(int(rnd.integers(1, 8))):
                keep = rnd.random(len(base)) > 0.1
                keep[0] = True
                sets.append(base[keep])
        n = len(sets)
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        given = [i // 7 * 7 for i in range(n)]  # what is one component already needs no link
        for roots in (list(range(n)), given):
            for cell in (2, 24):
                got = jaccard.join_region(roots, sets, 80, cell, 4)
                assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in linked}
                want, have = jaccard._Forest(n), jaccard._Forest(n)
                for forest, links in ((want, linked), (have, got)):
                    for i, j in [*links, *enumerate(roots)]:
                        forest.union(i, j)
                assert [want.find(i) for i in range(n)] == [have.find(i) for i in range(n)]


def test_marginals_by_enumeration():
    from itertools import product

    rnd = np.random.default_rng(2)
    sizes = [1, 4, 2, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, move = rnd.normal(size=first[-1]), rnd.normal(size=(2, 2))
    got, moves = quality.marginals(e, move, first)
    expected = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, good = 0.0, np.zeros(b - a)
        pair = np.zeros((2, 2))
        for path in product((0, 1), repeat=b - a):
            p = np.exp(sum(e[a + i] * s for i, s in enumerate(path)) + sum(move[s, t] for s, t in zip(path, path[1:], strict=False)))
            total += p
            good += p * np.array(path)
            for s, t in zip(path, path[1:], strict=False):
                pair[s, t] += p
        assert np.allclose(got[a:b], good / total)
        expected += pair / total
    assert np.allclose(moves, expected)


def test_tree_distributions_sum_to_one():
    w = Words(pa.array(["the cat sat on the mat " * 30, "a dog", "", None]), BLANKS)
    symbols, begin, length = suffix_tree.spelled(w)
    assert length.tolist()[2:] == [1, 1] and bytes(symbols[begin[1] : begin[1] + length[1]]) == b"a dog \n"
    at = suffix_tree._scored(begin, length)
    n = Counter((d, int.from_bytes(bytes(symbols[i - d : i])[::-1], "big"), int(symbols[i])) for i in at for d in range(suffix_tree.DEPTH + 1))
    rows = [(*x, k) for x, k in n.items()]
    tree = suffix_tree.grow(*(np.array(c) for c in zip(*rows, strict=True)))
    child, log10 = tree.tables
    of = np.bincount(tree.code, minlength=log10.shape[1])  # bytes that share a column have that probability each
    assert np.allclose((10.0**log10) @ of, 1, atol=1e-5) and len(child) > 1
    assert tree.score(symbols, begin, length)[0] > -690 * np.log10(256)
    assert len(suffix_tree.grow(*(np.zeros(0, int) for _ in range(4))).tables[0]) == 1


def test_a_part_of_the_tree_looks_at_its_own_places():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["cat", "Dog", "é", "on", "a", "matted"]) for _ in range(rnd.randrange(60))) for _ in range(40)] + ["", None, "\xff" * 5, " "]
    symbols, begin, length = suffix_tree.spelled(Words(pa.array(texts), BLANKS))
    at, depth = suffix_tree._scored(begin, length), suffix_tree.DEPTH
    key = suffix_tree.packed(symbols, depth)[at]
    assert key.tolist() == [int.from_bytes(bytes(symbols[i - depth : i])[::-1] + bytes([symbols[i]]), "big") for i in at]
    n = Counter((d, int.from_bytes(bytes(symbols[i - d : i])[::-1], "big"), int(symbols[i])) for i in at for d in range(depth + 1))
    counts = [np.array(c) for c in zip(*((*x, k) for x, k in n.items()), strict=True)]
    whole = suffix_tree.grow(*counts).score(symbols, begin, length)
    parts = [suffix_tree.grow(*counts, None, (k, 5)) for k in range(5)]
    assert all(p.mine.sum() and len(p.mine) == 1 << 8 * suffix_tree.SPLIT for p in parts) and sum(p.mine.astype(int) for p in parts).max() == 1
    assert np.allclose(sum(p.score(symbols, begin, length) for p in parts), whole, atol=1e-3)


def test_states_of_a_tree_score_as_its_dense_tables_in_less_room():
    rnd = random.Random(4)
    words = ["cat", "Dog", "on", *(chr(200 + k) + "x" for k in range(60))]  # over 64 columns
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(300))) for _ in range(90)] + ["", None]
    symbols, begin, length = suffix_tree.spelled(Words(pa.array(texts[:50]), BLANKS))
    n = Counter((d, int.from_bytes(bytes(symbols[i - d : i])[::-1], "big"), int(symbols[i])) for i in suffix_tree._scored(begin, length) for d in range(suffix_tree.DEPTH + 1))
    tree = suffix_tree.grow(*(np.array(c) for c in zip(*((*x, k) for x, k in n.items()), strict=True)))
    symbols, begin, length = suffix_tree.spelled(Words(pa.array([*texts, "Zebra ~ [Quiz]"]), BLANKS))
    (child, log10), at = tree.tables, suffix_tree._scored(begin, length)
    want = []
    for i in at.tolist():
        node = 0
        for d in range(1, suffix_tree.DEPTH + 1):
            if not (to := child[node, tree.code[symbols[i - d]]]):
                break
            node = to
        want.append(log10[node, tree.code[symbols[i]]])
    assert log10.shape[1] > 64 and np.allclose(tree.score(symbols, begin, length), np.bincount(np.repeat(np.arange(len(length)), length), want, len(length)), atol=1e-4)
    s = tree.states
    held = sum(x.nbytes for x in (s.child.bits, s.child.before, s.follow.bits, s.follow.before, s.log10, s.back, s.parent))
    assert held == suffix_tree.bytes_for(np.unique(symbols)[: int(tree.code.max())], len(tree.parent), len(tree.n)) < (child.nbytes + log10.nbytes) / 4


def test_chains_and_alignment():
    rnd = random.Random(1)
    passage = [rnd.randrange(10**6) for _ in range(90)]
    other = passage.copy()
    other[30], other[60:62] = -1, [-2]
    a, b = [-5] * 20 + passage + [-6] * 10, [-7] * 7 + other + [-8] * 4
    n = passages.SEED
    matches = [(i, j) for i in range(len(a) - n) for j in range(len(b) - n) if a[i : i + n] == b[j : j + n]]
    x, y = (np.array(c) for c in zip(*matches, strict=True))
    chains = passages.chain(x, y)
    assert len(chains) == 1
    assert passages.align(a, b, *chains[0])[:4] == (20, 110, 7, 7 + len(other))
    assert passages.minimizers(np.arange(5, dtype=np.uint64)).tolist() == [0]
    h = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    kept = set(passages.minimizers(h).tolist())
    assert all(kept & set(range(i, i + passages.WINDOW)) for i in range(300 - passages.WINDOW + 1))


def test_alignment_counts_all_of_a_chain():
    shared = list(range(360))
    a, b = shared[:60] + [-1] * 15 + shared[60:], shared[:60] + [-2] * 15 + shared[60:]
    assert passages.align(a, b, 3, 300, 3, 300) == (0, 375, 0, 375, 360)
    assert passages.spans(passages.runs_of(a, b, 3, 300, 3, 300)) == [(0, 375, 0, 375, 360)]
    # several wide gaps, and one that leaves too few equal words: its sides are passages of their own
    a = shared[:60] + [-1] * 30 + shared[60:70] + [-3] * 20 + shared[70:160]
    b = shared[:60] + [-2] * 30 + shared[60:70] + shared[70:160]
    assert passages.align(a, b, 0, 200, 0, 180)[4] == 160
    runs = [(0, 0, 60), (200, 60, 60), (260, 120, 9)]
    assert passages.spans(runs) == [(0, 60, 0, 60, 60), (200, 269, 60, 129, 69)]


def test_look_ahead_by_brute_force():
    rnd = random.Random(2)
    look, words = passages.LOOK, passages.RESUME
    for _ in range(300):
        a, b = ([rnd.randrange(rnd.choice([2, 4, 9])) for _ in range(rnd.randrange(look + words + 1))] for _ in range(2))
        near = [(p + q, p, q) for p in range(look + 1) for q in range(look + 1) if p + q < 2 * look and len(a[p : p + words]) == words and a[p : p + words] == b[q : q + words]]
        assert passages._ahead(a, b) == (min(near)[1:] if near else None)
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert passages._equal([1] * 130 + a, [1] * 130 + b, 0, 0) == 130 + n and passages._equal(a, b, len(a), 0) == 0


def test_a_far_chain_hides_no_near_one():
    x = np.concatenate((np.arange(0, 993, 5), np.arange(1100, 1393, 5)))
    assert sorted(passages.chain(x, x)) == [(0, 998, 0, 998), (1100, 1398, 1100, 1398)]


def test_templates():
    rows = [(1, 10, "user <*> logged in from home today"), (1, 11, "user <*> logged in from work today"), (1, 12, "user <*> went out of the door"), (2, 13, "user <*> logged in from home today")]
    assert dict(templates.grow(iter(rows), 0.7)) == {10: 10, 11: 10, 12: 12, 13: 13}
    assert templates.masked("a1 b 22\tc") == ["<*>", "b", "<*>", "c"]


def test_plan_follows_the_size():
    small, large = simhash.plan(1000), simhash.plan(10**6)
    assert small[0] < large[0] and small[1] < large[1]
    assert hashlib.sha256(b"").hexdigest() == decontaminate.EMPTY_SHA256
