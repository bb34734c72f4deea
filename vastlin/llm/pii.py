"""PII by aggregated weak supervision, in DataFrame functions throughout.

Candidates are what the base patterns match and what looser patterns add (obfuscated addresses, national phone numbers,
IPv6, numbers that fail a check). Labelers vote 1, -1 or 0 on each: the strict pattern, a gazetteer (top-level domains, issuer and
area ranges, address ranges), the words before it, and its shape. The votes of the whole corpus are counted per
pattern of votes, of which there are at most 4 kinds x 81 votes x 16 traits, and only these counts reach the driver: expectation-maximisation
estimates each labeler's reliability from them, and a logistic classifier is trained on the resulting probabilities. Its
weights go back into a column expression that scores every candidate. Base spans always stay; other candidates
stay with a probability of ``ACCEPT`` or more if they overlap no base span.

Patterns are written so that Java's matcher takes linear time: possessive repeats, and no start within a run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vastlin.llm.shared import boxed, unboxed

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
VOTES = ("strict", "gazetteer", "context", "shape")
#: What the span classifier sees of a candidate besides its kind and votes, each true or false.
TRAITS = ("stands alone", "has separators", "repeats one character", "is long")

#: The base patterns; each matches what its plain form matches, leftmost and without overlap; of cards only those with the least number of digits.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Whether a text can hold a match at all.
HINT = {"email": "@", "phone": "+"}
#: Looser patterns, and what a text must have for them.
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,8}+", r"[\[({]at[\])}]"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "eu", "uk", "us", "it", "nl", "ch", "at")
CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel", "escriba"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "credit", "debit", "amex", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "anruf", "llame", "appel"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "release", "token", "doi", "section", "build")


#: Elements that a running sum appends to one array, so that long texts take linear time.
RUN = 512


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _running(x: Column) -> Column:
    """The running sums of an array of ints."""
    append = lambda done, v: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + v))
    none = F.array().cast("array<int>")

    def joined(runs: Column) -> Column:
        ahead = F.aggregate(runs, F.array(F.lit(0)), lambda done, r: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(r, -1))))
        return F.flatten(F.zip_with(runs, F.slice(ahead, F.lit(1), F.size(runs)), lambda r, o: F.transform(r, lambda v: v + o)))

    def cut(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(RUN))
        return F.transform(starts, lambda i: F.aggregate(F.slice(all_, i, F.lit(RUN)), none, append))

    return _let(x, lambda v: F.when(F.size(v) == 0, none).otherwise(_let(cut(v), joined)))


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start,end,m,before>> of a pattern's matches, in code points, end exclusive."""
    kind = "array<struct<start:int,end:int,m:string,before:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("n"), m.alias("m"), F.lower(F.right(g, F.lit(40))).alias("before")))

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["n"]))
        return F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("m"), x["before"].alias("before")))

    return F.coalesce(F.when(possible, _let(pairs, placed)), F.array().cast(kind)).cast(kind)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _any(before: Column, words: tuple[str, ...]) -> Column:
    return before.rlike(r"\b(?:" + "|".join(words) + ")")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, loose: bool, s: Column) -> list[Column]:
    """The labelers' votes on a candidate, in the order of VOTES."""
    m, before = s["m"], s["before"]
    digits, ok = _digits(m), F.lit(False) if loose else valid(kind, m)
    strict = F.when(ok, 1).otherwise(0 if loose else -1)
    if kind == "email":
        last = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
        gazetteer = _vote(last.isin(*DOMAINS), last == "")
        shape = _vote(F.length(m).between(6, 80), F.length(m) > 120)
    elif kind == "ip":
        gazetteer = _vote(F.lit(loose) | ~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^(?:0|255)\."))
        shape = _vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)[0-9]{4,}"))
    elif kind == "card":
        gazetteer = _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[01]"))
        shape = _vote(F.length(digits).isin(15, 16), ~F.length(digits).between(12, 19))
    else:
        gazetteer = _vote(digits.rlike("^(?:1|[2-9][0-9])"), digits.rlike("^0{2}"))
        shape = _vote(F.length(digits).between(10, 13), ~F.length(digits).between(9, 15))
    return [strict, gazetteer, _vote(_any(before, CONTEXT[kind]) & ~_any(before, AGAINST), _any(before, AGAINST)), shape]


def traits(s: Column) -> list[Column]:
    """A candidate's TRAITS."""
    m = s["m"]
    return [~s["before"].rlike(r"[\p{L}0-9]$"), m.rlike(r"[\x20()-]"), m.rlike(r"([0-9A-Za-z])\1{4}"), F.length(m) > 20]


def _candidate(kind: str, rank: int, loose: bool):
    def candidate(s: Column) -> Column:
        base = F.lit(False) if loose else valid(kind, s["m"])
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"), F.array(*votes(kind, loose, s)).alias("votes"), F.array(*traits(s)).alias("traits"))

    return candidate


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_candidates``: array<struct<start,rank,end,kind,base,votes,traits>>, a null text counting as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for rank, kind in enumerate(KINDS):
        hint = F.contains(t, F.lit(HINT[kind])) if kind in HINT else t.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")
        for loose, pattern, possible in [(False, BASE[kind], hint)] + ([(True, LOOSE[kind][0], t.rlike(LOOSE[kind][1]))] if kind in LOOSE else []):
            spans = _matches(t, pattern, possible)
            parts.append(F.transform(spans, _candidate(kind, rank, loose)))
    return docs.withColumn("_candidates", F.concat(*parts))


def learn(patterns: list[tuple[str, tuple[int, ...], tuple[bool, ...], int]], rounds: int = 50) -> tuple[dict[tuple[str, tuple[int, ...]], float], np.ndarray]:
    """Posterior of each (kind, votes) by expectation-maximisation, and the weights of the classifier, from (kind, votes, traits, count).

    Labelers are independent given the truth; a vote's probabilities given true and false are estimated with add-one
    counts that begin in favour of the labeler. The classifier sees kind, votes and traits as indicators.
    """
    if not patterns:
        return {}, np.zeros(len(KINDS) + 3 * len(VOTES) + len(TRAITS))
    v = np.array([p[1] for p in patterns]) + 1  # 0, 1, 2
    n = np.array([p[3] for p in patterns], float)
    # one prior for each labeler: rates of -1, 0, 1 when false and when true
    rate = np.tile(np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]), (len(VOTES), 1, 1))
    kept, share = rate * 10, 0.5
    for _ in range(rounds):
        true, false = np.log(share), np.log(1 - share)
        for k in range(len(VOTES)):
            true, false = true + np.log(rate[k, 1, v[:, k]]), false + np.log(rate[k, 0, v[:, k]])
        q = 1 / (1 + np.exp(np.clip(false - true, -50, 50)))
        share = ((n * q).sum() + 1) / (n.sum() + 2)
        for k in range(len(VOTES)):
            for y, w in ((1, n * q), (0, n * (1 - q))):
                c = kept[k, y] + np.bincount(v[:, k], w, minlength=3)
                rate[k, y] = c / c.sum()
    x = np.array([features(*p[:3]) for p in patterns])
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * (x.T @ (weight * (p - q)) + 1e-4 * w)
    return {(p[0], p[1]): float(y) for p, y in zip(patterns, q, strict=True)}, w


def features(kind: str, votes_: tuple[int, ...], traits_: tuple[bool, ...]) -> list[float]:
    return [float(kind == k) for k in KINDS] + [float(x == y) for x in votes_ for y in (-1, 0, 1)] + [float(t) for t in traits_]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: array<struct<start,rank,end,kind>> sorted by start, then kind.

    Positions are code points, ends exclusive. A null or empty text has none. Rows are independent, so repeated rows
    agree; columns of the same names are replaced. One job counts the vote patterns of all rows, a second
    pass scores; nothing is shuffled but those counts.
    """
    found = with_candidates(docs.select(F.col(text).alias("_t")), "_t")
    counted = found.select(F.explode("_candidates").alias("c")).groupBy("c.kind", "c.votes", "c.traits").count().collect()
    _, w = learn(sorted((r["kind"], tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in counted))

    def probability(c: Column) -> Column:
        of_kind = F.element_at(F.array(*[F.lit(float(x)) for x in w[: len(KINDS)]]), c["rank"] + 1)
        total = of_kind
        for k in range(len(VOTES)):
            each = F.array(*[F.lit(float(x)) for x in w[len(KINDS) + 3 * k : len(KINDS) + 3 * k + 3]])
            total = total + F.element_at(each, F.element_at(c["votes"], k + 1) + 2)
        for k, weight in enumerate(w[-len(TRAITS) :].tolist()):
            total = total + F.when(F.element_at(c["traits"], k + 1), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    keep = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"))
    own = [c for c in docs.columns if c not in ("base_spans", "spans")]
    out = with_candidates(boxed(docs, text), "_text")
    out = out.withColumn("base_spans", F.array_sort(F.transform(F.filter("_candidates", lambda c: c["base"]), keep)))
    extra = F.filter("_candidates", lambda c: ~c["base"] & (probability(c) >= ACCEPT) & (F.element_at(c["votes"], 3) >= 0))
    apart = F.filter(extra, lambda c: ~F.exists("base_spans", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    return unboxed(out, own, **{text: F.col("_text")}, base_spans=F.col("base_spans"), spans=F.array_sort(F.concat("base_spans", F.transform(apart, keep))))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract columns of every document."""
    found = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
