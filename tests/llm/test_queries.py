"""Operators over small frames: brute force, and the cases of nulls, empty tables, repeats and clashing names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vastlin.llm import bpe, decontaminate, jaccard, language, passages, pii, quality, queries, shared, simhash, suffix_tree, templates
from vastlin.llm.queries import tokenizer_path

WORDS = "river stone light forest window garden letter winter summer silver copper bridge market corner pencil bottle engine ladder mirror basket".split()


def plain(seed, n):
    """Without digits, which line templates take for variable fields."""
    return prose(seed, n).translate(str.maketrans("0123456789", "abcdefghij"))


def prose(seed, n):
    rnd = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rnd.integers(0, len(WORDS), n), rnd.integers(0, 50, n), strict=True))


EDGES = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "some words here"), (None, None), (4, "x " * 3000), (5, "ÄÖÜ")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe(edges, empty):
    got = bpe.digest(edges, tokenizer_path()).collect()
    assert len(got) == len(EDGES) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert bpe.digest(empty, tokenizer_path()).count() == 0
    clash = bpe.encode_decode(edges.withColumn("token_ids", F.lit("mine")), tokenizer_path())
    assert clash.columns.count("token_ids") == 1


def test_language(spark, edges, empty):
    rows = [(i, ("the and of with " if i % 2 else "der die und mit ") + prose(i, 5), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and {r.held_out for r in got.values()} == {True, False}
    out = language.predict(edges, language.train(docs)).collect()
    assert len(out) == len(EDGES) and all((r.lang_pred == "und") == (r.text is None or not re.search(r"[^\W\d_]", r.text)) for r in out)
    none = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.predict(edges, none).collect()} == {"und"}
    assert language.predict(empty, none).count() == 0


def test_decontaminate(spark, edges, empty):
    item = prose(1, 14)
    items = spark.createDataFrame([(7, item), (8, "Rare-Word"), (9, None), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, "a rare word, twice: RARE WORD"), (3, prose(2, 30)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    assert (got[1].n_hit, got[1]["items"]) == (14, ["7"]) and (got[2].n_hit, got[2]["items"]) == (4, ["8"])
    assert got[3].n_hit == 0 and got[4].n_words == 0
    blocks = {r.doc_id: r for r in decontaminate.scan(docs, items, block_bytes=20).collect()}
    assert all((blocks[i].n_hit, blocks[i]["items"], blocks[i].hit_spans) == (got[i].n_hit, got[i]["items"], got[i].hit_spans) for i in got)
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, items).collect()}
    assert left[1] == "start  end" and left[3] == prose(2, 30) and left[4] is None
    assert {r.doc_id: r.text for r in decontaminate.remove(docs, items, block_bytes=20).collect()} == left
    assert decontaminate.digest(edges, items).count() == len(EDGES)
    assert decontaminate.digest(empty, items).count() == 0
    assert {r.n_hit for r in decontaminate.digest(docs, items.where("false")).collect()} == {0}


def test_quality(spark, edges, empty):
    rnd = np.random.default_rng(0)
    text = lambda i: "\n".join(("BUY!! NOW!! " * 5 if i % 3 == 0 else prose(i * 10 + k, 12) + ".") for k in range(int(rnd.integers(1, 6))))
    docs = spark.createDataFrame([(i, text(i)) for i in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(121, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == 150 and ((got.predicted == 1) == (got.doc_id % 3 > 0)).mean() > 0.97 and got.score.between(0, 1).all()
    model = quality.train(docs, labels)
    assert quality.score(edges, model).count() == len(EDGES)
    assert quality.train(docs, labels.where("false")) is None and quality.score(empty, None).count() == 0


def test_pii(spark, edges, empty):
    docs = spark.createDataFrame([(1, "é mail a.b@c.de, 1.2.3.4 or 300.1.1.1; card 4111 1111 1111 1111 or 4111 1111 1111 1112"), (2, "call +1 (437) 555-0689 now"), (3, "nothing 12"), (4, "a" * 20000 + " @ " + "1 " * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 0] and got[2].n_phone == 1 and got[2].spans == "phone:5:22"
    assert got[1].spans.startswith("email:7:15,ip:17:24") and got[3].spans == "" and got[4].spans == ""
    assert pii.digest(edges).count() == len(EDGES) and pii.digest(empty).count() == 0


def test_jaccard(spark, edges, empty):
    rnd = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = prose(g, int(rnd.integers(3, 260))).split()
        for _ in range(4):
            own = words.copy()
            for k in rnd.integers(0, len(own), rnd.integers(0, max(1, len(own) // 40) + 1)):
                own[k] = "changed"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), rows[0][1]), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    small = jaccard.join(docs.withColumn("node", F.lit("mine")).withColumn("n", F.lit(0)), region=150, pivots=2).collect()  # regions are split across tasks, again and again
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in small} == got
    assert jaccard.join(edges).count() == len(EDGES)
    assert jaccard.join(empty).count() == 0


def test_simhash(spark):
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(40, 16))
    x = np.concatenate((base, base[:20] + rnd.normal(size=(20, 16)) * 0.05, base[:5]))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    got = {r.vec_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert simhash.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_suffix_tree_counts(spark, edges, empty):
    docs = spark.createDataFrame([(i, "the quick fox " * 3 + prose(i, 10)) for i in range(20)] + [(20, None)], "doc_id long, text string")
    got = suffix_tree.score(docs, docs).collect()
    counts = {}
    for r in docs.collect():
        for w in [*(r.text or "").lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r, d in zip(sorted(got, key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        tokens = [*(d.text or "").lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), len(tokens), n)
        assert np.isclose(r.base_score, sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)) and r.score < 0
    assert suffix_tree.score(edges, empty).count() == len(EDGES)
    assert suffix_tree.score(empty, docs).count() == 0


def test_templates(spark, edges, empty):
    docs = spark.createDataFrame([(i, f"{plain(i, 20)}\nCopyright 20{i:02d} by the owner of page {i}\n{plain(i + 100, 8)}") for i in range(8)] + [(50, plain(9, 20)), (51, plain(9, 20)), (52, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in templates.dedup_lines(docs).collect()}
    assert [got[i].n_dropped for i in range(8)] == [0] + [1] * 7 and "Copyright" in got[0].text and "Copyright" not in got[5].text
    assert got[50].n_dropped == got[51].n_dropped == 0 and got[52].text is None
    assert templates.clean(edges).count() == len(EDGES) and templates.clean(empty).count() == 0
    assert templates.dedup_lines(docs.withColumn("text_hash", F.lit(1)).withColumn("n_lines", F.lit(2))).columns == ["doc_id", "text", "text_hash", "n_lines", "n_dropped"]


def test_passages(spark, edges, empty):
    shared = prose(77, 70)
    rows = [(i, f"{prose(i, 60)} {shared} {prose(i + 500, 40)}") for i in range(4)] + [(10, prose(10, 200)), (11, prose(11, 90)), (12, prose(11, 90)), (13, "short"), (14, None)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = {r.doc_id for r in got} | {r.other_id for r in got}
    assert named == {0, 1, 2, 3, 11, 12}
    assert all((r.start, r.end) == (60, 130) for r in got if r.doc_id < 10)
    assert passages.passages(edges).count() == 0 and passages.passages(empty).count() == 0


def test_passages_with_edits_and_hot_runs(spark):
    rows, want = [], set()
    for i in range(60):
        words = prose(1000 + i, 60).split()
        other = words.copy()
        other[20], other[40] = "changed", "altered"
        for k, w in enumerate((words, other)):
            rows.append((2 * i + k, f"{prose(2000 + 2 * i + k, 30)} {' '.join(w)} {prose(3000 + 2 * i + k, 30)}"))
        want.add((2 * i + 1, 2 * i))
    hot = prose(99, 45)
    rows += [(200 + i, f"{prose(4000 + i, 20)} {hot} {prose(5000 + i, 20)}") for i in range(8)]
    sides = [prose(98, 28), prose(97, 28)]
    rows += [(i, f"{prose(6000 + i, 20)} {sides[0]} {hot} {sides[1]} {prose(7000 + i, 20)}") for i in (300, 301)]
    got = {}
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.other_id), []).append((r.start, r.end, r.other_start, r.other_end))
    assert {p for p in got if p[0] < 200} == want and all(got[p] == [(30, 90, 30, 90)] for p in want)
    assert got[301, 300] == [(20, 121, 20, 121)]


def test_passages_that_stand_twice_in_a_text(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, f"{a} {prose(10, 30)} {a} {prose(11, 80)}"), (2, f"{prose(12, 70)} {a}"), (3, f"{prose(13, 20)} {b} {prose(14, 20)} {b} {b}"), (4, "x " * 3000)]
    got = {(r.doc_id, r.start, r.end): r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {(r.doc_id, r.other_id) for r in got.values()}
    assert pairs == {(1, 1), (2, 1), (3, 3)} and all(r.start > r.other_start for r in got.values() if r.doc_id == r.other_id)
    assert got[1, 90, 150].other_start == 0
    covered = lambda i: {w for r in got.values() for d, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)) if d == i for w in range(s, e)}
    assert covered(1) == {*range(60), *range(90, 150)} and covered(2) == set(range(70, 130)) and {*range(20, 80), *range(100, 220)} <= covered(3) <= set(range(20, 220))


def test_passages_of_which_others_have_either_half(spark):
    """All seeds of a run lead to texts that have less than the run; with four places of it, and as a unit that repeats."""
    rows, want = [], set()
    for t in range(10):
        run = prose(10_000 + t, 56).split()
        parts = [run, run, *([run[:36]] * 6), *([run[20:]] * 6), *([run] * (t % 3))]
        ids = [100 * t + i for i in range(len(parts))]
        rows += [(i, f"{prose(20_000 + i, 20)} {' '.join(part)} {prose(30_000 + i, 20)}") for i, part in zip(ids, parts, strict=True)]
        want.add(frozenset(i for i, part in zip(ids, parts, strict=True) if part is run))
    rows += [(5000 + i, f"{prose(40_000 + i, 20)} {'tick tock ' * (30 if i in (3, 8) else 12)}{prose(50_000 + i, 20)}") for i in range(12)]
    want.add(frozenset((5003, 5008)))
    found = {}
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.end - r.start >= 50
        sides = found.get(r.doc_id, {r.doc_id}) | found.get(r.other_id, {r.other_id})
        found.update({i: sides for i in sides})
    assert {frozenset(x) for x in found.values()} == want


def test_every_text_with_a_passage_has_rows(spark, tmp_path):
    """The first text with a passage too, one that is copied, and the first place of a passage that a text repeats."""
    a, b, c = prose(61, 60), prose(62, 70), prose(63, 80)
    rows = [(i, f"{prose(600 + i, 30 + i)} {a} {prose(700 + i, 20)}") for i in range(5)]
    rows += [(10, c), (11, c), (12, c), (20, f"{b} {prose(64, 60)} {b}"), (30, prose(65, 200)), (31, "short"), (32, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_passages(spark, str(tmp_path)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
    assert spans == {**{i: {(30 + i, 90 + i)} for i in range(5)}, 10: {(0, 80)}, 11: {(0, 80)}, 12: {(0, 80)}, 20: {(0, 70), (130, 200)}}
    sides = {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in got}
    assert len(sides) == len(got) and {(y, x, s2, e2, s, e) for x, y, s, e, s2, e2 in sides} == sides


def test_short_and_digit_heavy_lines(spark):
    short, digits, han = "All rights reserved.", "12 34 56 78 90 tel", "版权所有不得转载"
    rows = [(i, f"{plain(i, 20)}\n{short}\n\n{digits}\n{han}\n{i} {i + 1} {i + 2} 4 5 6\npage {i}\n{plain(i + 100, 8)}") for i in range(8)]
    rows += [(20 + i, f"{plain(20 + i, 20)}\nseldom seen") for i in range(4)]
    got = {r.doc_id: r for r in templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and [got[i].n_dropped for i in range(1, 8)] == [3] * 7
    assert all(got[i].text == rows[i][1].replace(f"{short}\n", "").replace(f"{digits}\n", "").replace(f"{han}\n", "") for i in range(1, 8))
    assert all(got[20 + i].n_dropped == 0 for i in range(4))


def test_salted_join_as_a_plain_one(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 6 == 0, F.col("id")).alias("k"), F.col("id").alias("x"))
    facts = spark.createDataFrame([(1, "a"), (6, "b"), (7, "c"), (12, "d")], "k long, f string")
    hot = shared.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert [r.k for r in hot.where("k is not null").collect()] == [1]
    for how in ("inner", "left"):
        got = shared.salted_join(rows, facts, "k", hot, F.col("x"), how)
        assert sorted(map(str, got.select("k", "x", "f").collect())) == sorted(map(str, rows.join(facts, "k", how).select("k", "x", "f").collect()))


def test_components_with_hubs_by_brute_force(spark):
    rnd = np.random.default_rng(3)
    links = [(1000, i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2050)] + [(5, 5), (7, 1000), (1000, 7)]
    links += [tuple(map(int, x)) for x in rnd.integers(3000, 3400, (220, 2))] + [(4000 + i, 4500) for i in range(100)] + [(4500, 2050)]
    root = {x: x for p in links for x in p}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root[x] for x in linked}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_line_and_a_template_in_very_many_texts(spark):
    rows = [(i, f"{plain(i, 9)}\nall rights reserved\nread more about {plain(i, 1)} on the next page of it\n{plain(i + 500, 7)}") for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000 + i, None) for i in range(100)]
    got = {r.doc_id: r for r in templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[0].text == rows[0][1]
    assert {got[i].n_dropped for i in [*range(1, 200), *range(1000, 1150)]} == {2}
    assert all(got[1000 + i].text == got[7].text for i in range(150)) and all(got[2000 + i].text is None for i in range(100))


#: Names that operators use inside, and those of their results.
NAMES = ["_text", "_key", "_row", "_left", "_lines", "_drop", "_text_hash", "_candidates", "_id", "node", "n", "items", "n_words", "n_hit", "hit_spans", "cut_spans", "line", "leaf", "region", "root", "key", "row_key", "w", "held_out", "base_spans_", "bucket", "block"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [*EDGES, (9, f"{prose(1, 30)}\n1.2.3.4 a@b.de"), (9, f"{prose(1, 30)}\n1.2.3.4 a@b.de"), (10, prose(1, 30))]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES))


def test_columns_with_clashing_names(spark, clashing):
    items = spark.createDataFrame([(7, prose(1, 14))], "item_id long, text string")
    n = clashing.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, quality int")
    rows = [(i, ("the and of with " if i % 2 else "der die und mit ") + prose(i, 5), "en" if i % 2 else "de") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = [  # operators that return the rows they get
        templates.dedup_lines(clashing),
        decontaminate.remove(clashing, items),
        pii.find(clashing),
        language.predict(clashing, model),
        bpe.encode_decode(clashing, tokenizer_path()),
    ]
    for out in kept:
        got = out.collect()
        assert len(got) == n and all(r[c] == f"own {c}" for r in got for c in NAMES)
    for out in (jaccard.join(clashing), suffix_tree.score(clashing, clashing), decontaminate.digest(clashing, items), quality.classify(clashing, labels), bpe.digest(clashing, tokenizer_path()), pii.digest(clashing), templates.clean(clashing)):
        assert out.count() == n
    assert passages.passages(clashing).collect() is not None


def test_embeddings_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [0.0, 1.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("own").alias(c) for c in ("vec", "code", "table", "u", "v", "a", "b", "node", "root", "n", "key")))
    assert simhash.near_duplicates(x).count() == len(rows)


def test_suffix_tree_score_by_brute_force(spark, monkeypatch):
    depth, end, pad = suffix_tree.DEPTH, "\n", " " * suffix_tree.DEPTH
    rows = [(i, f"{prose(i, 15)} the cat sat {'on the mat ' * (i % 4)}") for i in range(40)] + [(40, ""), (41, "Zebra ~ [Quiz]")]
    learned = spark.createDataFrame(rows[:30], "doc_id long, text string")
    spelled = lambda t: "".join(w + " " for w in t.lower().split()) + end
    counts: dict[str, dict[str, int]] = {}
    for _, t in rows[:30]:
        s = pad + spelled(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                of = counts.setdefault(s[i - d : i], {})
                of[s[i]] = of.get(s[i], 0) + 1

    def gain(c):
        up, total = counts[c[1:]], sum(counts[c].values())
        return sum(n * np.log(n / total * sum(up.values()) / up[x]) - 0.5 * np.log(total) for x, n in counts[c].items())

    kept = {""}
    for c in counts:
        if c and gain(c) > 0:
            kept |= {c[i:] for i in range(len(c))}

    def probability(c, x):
        of = counts[c]
        prior, strength = (probability(c[1:], x), len(of)) if c else (1 / 256, 1 + len(of))
        return (of.get(x, 0) + strength * prior) / (sum(of.values()) + strength)

    want = {}
    for i, t in rows:
        s, total = pad + spelled(t), 0.0
        for k in range(depth, len(s)):
            c = ""
            while len(c) < depth and s[k - len(c) - 1 : k] in kept:
                c = s[k - len(c) - 1 : k]
            total += np.log10(probability(c, s[k]))
        want[i] = total
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert all(np.isclose(got[i], want[i], rtol=1e-4, atol=1e-4) for i in want) and len(kept) > 100
    # a small budget keeps the most divergent nodes
    monkeypatch.setattr(suffix_tree, "MODEL_BYTES", 8 * 40 * 60)
    cut = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert sum(cut.values()) < sum(got.values()) and len(cut) == len(rows)


def test_suffix_tree_in_parts_as_in_one(spark, monkeypatch):
    rows = [(i, f"{prose(i, 15)} the cat sat {'on the mat ' * (i % 4)}") for i in range(40)] + [(40, None), (41, "Zebra ~ [Quiz]"), (41, "Zebra ~ [Quiz]"), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 3)) for r in suffix_tree.score(docs, docs.where("doc_id < 30")).collect())
    want = found()
    monkeypatch.setattr(suffix_tree, "PASS_BYTES", 8 * 40 * 60)  # too little for the tree, which takes several passes then
    trees, grow = [], suffix_tree.grow
    monkeypatch.setattr(suffix_tree, "grow", lambda *x: trees.append(grow(*x)) or trees[-1])
    got = found()
    assert len(trees) > 2 and all(a[:3] == b[:3] and np.isclose(a[3], b[3], atol=0.01) for a, b in zip(got, want, strict=True))


def test_suffix_tree_takes_one_pass_where_dense_tables_took_several(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{prose(i, 15)} the cat sat {'on the mat ' * (i % 4)}") for i in range(40)], "doc_id long, text string")
    trees, grow = [], suffix_tree.grow
    monkeypatch.setattr(suffix_tree, "PASS_BYTES", 60_000)
    monkeypatch.setattr(suffix_tree, "grow", lambda *x: trees.append(grow(*x)) or trees[-1])
    assert suffix_tree.score(docs, docs).count() == 40
    assert len(trees) == 1 and sum(x.nbytes for x in trees[0].tables) > 2 * 60_000


def test_suffix_tree_finds_the_rare_words_once(spark):
    """The words of the texts are taken apart in four passes: to count them, to count symbols, to score, and to look up rare words."""
    docs = spark.createDataFrame([(i, f"{prose(i, 15)} the cat sat") for i in range(40)], "doc_id long, text string")
    plan = suffix_tree.score(docs, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_pii_base_spans_by_plain_patterns(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}

    def fine(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0
        return all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 9 <= len(d) <= 15 if kind == "phone" else True

    rnd = np.random.default_rng(4)
    pieces = ["1.2.3.4", "12.345.6.7.8.9", "4111 1111-1111 1111", "a@b.c", "+1 (22) 333-4444", "é😀", "@", ".", "-", " ", "  ", "7", "x_y", "\n", "+", "00.0.0.256", "5500000000000004", "a.b@c-d.e.f@g.h", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"]
    rows = [(i, "".join(pieces[k] for k in rnd.integers(0, len(pieces), rnd.integers(1, 25)))) for i in range(400)]
    rows += [(1000, "7 12 " * 30000), (1001, "1.2.3.4 " * 20000), (1002, "9-" * 40000)]
    got = {r.doc_id: r.base_spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "base_spans").collect()}
    for i, t in rows:
        want = sorted((m.start(), rank, m.end()) for rank, kind in enumerate(pii.KINDS) for m in re.finditer(plain[kind], t) if fine(kind, m[0]))
        assert [(s["start"], s["rank"], s["end"]) for s in got[i]] == want, t[:80]


def test_simhash_recall_of_long_signatures(spark):
    """Pairs right above the threshold, by the bits and tables of a large corpus."""
    rnd = np.random.default_rng(8)
    n, d = 1500, 32
    a, noise = rnd.normal(size=(n, d)), rnd.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * noise
    bits, tables = simhash.plan(1_000_000)
    assert bits >= 14
    code = simhash.signatures(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(np.concatenate((a, b)))], "vec long, embedding array<double>, size long"), d, bits, tables).orderBy("vec").toPandas()
    code = np.array(code["codes"].tolist())
    assert (code[:n] == code[n:]).any(1).mean() >= 0.99


def test_checkpoints_of_many_small_partitions_take_few_files_and_keep_all_rows(spark, monkeypatch):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written, write = [], type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a: (written.append((out := write(self, *a)).rdd.getNumPartitions()), out)[1])
    spark.conf.set("spark.sql.shuffle.partitions", 211)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = shared.checkpointed(spark.range(5000).selectExpr("id % 1000 as k").groupBy("k").count())
        assert sorted(map(tuple, rows.collect())) == [(k, 5) for k in range(1000)] and written == [53]
        assert shared.checkpointed(spark.range(1000).repartition("id"), merge=False).count() == 1000 and written.pop() == 211
        chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
        assert {(r.node, r.root) for r in shared.components(chain).collect()} == {(i, 0) for i in range(31)}
        assert written[1] == 53 and max(written[2:]) == 4
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
