"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, diacritics off, homoglyphs of other scripts
and digits or signs that stand for letters read as the letter, everything else a
blank.  One pass of an Aho-Corasick automaton over the folded text finds all
lexicon entries; a hit inside an exception phrase does not count, and of the
entries that start at one place the heaviest counts.  The summed weight,
absolute and per hundred words, gives the score by a logistic fit.

The lexicon is learned on a bounded sample of labelled rows: word starts and
whole words whose document counts differ between the classes far beyond chance
(likelihood ratio), weighted by the log ratio of their rates among all words.  Exception phrases are words that hold
an entry and yet are usual in clean documents.  A caller may add entries and
phrases.  Counting runs in Spark; only the lexicon (``MAX_ENTRIES``) and the
calibration sample's three numbers a row come to the driver.

Defined results: null or empty text has no hits and gets the score of a text
without hits; labels that are null, or of documents that do not exist, are not
learned from; equal texts of one label count once; without labelled rows of both
classes every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

#: Labelled rows that are learned from, the first by a hash of doc_id.
MAX_LABELLED = 20_000
MAX_ENTRIES = 4_096
MIN_PREFIX, MAX_PREFIX = 3, 8
MIN_HOLDERS = 3
#: Share of an entry's occurrences that must be in toxic documents.
MIN_PRECISION = 0.5
#: About how many word starts stand and fall together, for the chance level.
NESTED = 5
THRESHOLD = 0.5

# Characters read as another, by their look.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
# Signs that stand for letters where a letter follows.
SIGNS = {"@": "a", "$": "s"}
# Marks that do not part a word.
INVISIBLE = "­​‌‍⁠﻿"


class _Folding(dict):
    """Translation table that works out a character when it first occurs."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in INVISIBLE:
            out = ""
        elif ch in SIGNS:
            out = ch
        elif ch in SUBSTITUTES:
            out = SUBSTITUTES[ch]
        else:
            base = [c for c in unicodedata.normalize("NFKD", ch).lower() if not unicodedata.combining(c)]
            out = "".join(HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c)) if c.isalnum() else "" for c in base)
            if not out and not unicodedata.combining(ch):
                out = " "
        self[code] = out
        return out


_FOLDING = _Folding()


_LOOSE_SIGN = re.compile("[" + "".join(SIGNS) + "]+(?![a-z@$])")


def fold(text: str | None) -> str:
    out = (text or "").translate(_FOLDING)
    for sign, letter in SIGNS.items():
        if sign in out:
            out = _LOOSE_SIGN.sub(" ", out).replace(sign, letter)
    return out


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Documents that labels are never learned from: crc32 of the id mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` labelled rows outside the held-out fold, of
    equal texts one."""
    y = F.col(label).cast("int")
    some = (labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
            .select(F.col("doc_id").alias("_id"), y.alias("y")))
    some = C.hash_sample(some, F.xxhash64("_id", "y"), limit, some.count())
    # At most ``limit`` rows of 12 bytes.
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("text", "y").dropDuplicates()


def _terms(batches):
    """Per partition: in how many documents of either class a word start ("abc")
    or a whole word ("abc~") occurs, and how often."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    times: tuple[Counter, Counter] = (Counter(), Counter())
    docs, total = [0, 0], [0, 0]
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"].tolist(), strict=True):
            own: Counter = Counter()
            for w, c in Counter(fold(text).split()).items():
                total[y] += c
                if MIN_PREFIX <= len(w) <= 40:
                    for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1):
                        own[w[:k]] += c
                    own[w + "~"] += c
            held[y].update(own.keys())
            times[y].update(own)
            docs[y] += 1
    terms = list(held[0].keys() | held[1].keys())
    yield pd.DataFrame({"term": ["", *terms], "neg": [docs[0], *(held[0][t] for t in terms)],
                        "pos": [docs[1], *(held[1][t] for t in terms)], "tneg": [total[0], *(times[0][t] for t in terms)],
                        "tpos": [total[1], *(times[1][t] for t in terms)]})


@dataclass
class Lexicon:
    """entries: folded word start, or whole word with a blank at its end -> weight.
    exceptions: folded words or phrases whose hits do not count."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    coef: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    fitted: bool = False

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(" " + e, (len(e) + 1, w))
        for e in self.exceptions:
            key = f" {e.strip()} "
            a.add_word(key, (len(key), 0.0 if key not in a else a.get(key)[1]))
        a.make_automaton()
        return a


def chance_level(kinds: int, n: int, p: int) -> float:
    """Likelihood ratio that an entry must reach: what the best of ``kinds`` terms
    reaches by chance, and a hundredth of what a perfect entry would."""
    return max(2 * math.log(max(2.0, kinds / NESTED)), 0.02 * p * math.log((n + p) / p))


def _nested(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of starts that continue each other, the longest that loses hardly any
    document, then none that only repeats a shorter one."""
    close: dict[str, int] = {}  # start -> most documents of a longer one
    for t, (_, pos) in found.items():
        word = t.rstrip("~")
        for k in range(MIN_PREFIX, len(word) + t.endswith("~")):
            close[word[:k]] = max(close.get(word[:k], 0), pos)
    kept = {t: w for t, (w, pos) in found.items() if t.endswith("~") or close.get(t, 0) < 0.97 * pos}
    out = {}
    for t, w in kept.items():
        word = t.rstrip("~")
        if not any(kept.get(word[:k], -1.0) >= w - 0.7 for k in range(MIN_PREFIX, len(word) + t.endswith("~"))):
            out[word + " " * t.endswith("~")] = w
    return out


def learn_lexicon(sample: DataFrame, scratch: C.Scratch, add: dict[str, float] | None = None,
                  add_exceptions: tuple[str, ...] = ()) -> Lexicon:
    lex = Lexicon({fold(k): v for k, v in (add or {}).items()}, {" ".join(fold(x).split()) for x in add_exceptions})
    counts = C.spread(sample).mapInPandas(_terms, "term string, neg long, pos long, tneg long, tpos long").groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("neg", "pos", "tneg", "tpos")])
    counts = scratch.cut(counts.where(F.col("neg") + F.col("pos") >= MIN_HOLDERS), "terms")
    totals = counts.where("term = ''").first()
    if totals is None or not totals["neg"] or not totals["pos"]:
        return lex
    n, p, kinds = totals["neg"], totals["pos"], counts.count()
    rate = (F.col("pos") + F.col("neg")) / F.lit(n + p)
    g2 = sum(2 * F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (rate * t))).otherwise(0.0) for c, t in (("neg", n), ("pos", p)))
    weight = F.log(((F.col("tpos") + 0.5) / (totals["tpos"] + 1)) / ((F.col("tneg") + 0.5) / (totals["tneg"] + 1)))
    strong = (counts.where("term <> ''").withColumn("g2", g2).withColumn("weight", weight)
              .where((F.col("pos") >= MIN_HOLDERS) & (F.col("tpos") >= MIN_PRECISION * (F.col("tpos") + F.col("tneg")))
                     & (F.col("pos") / p > F.col("neg") / n)
                     & (F.col("g2") >= chance_level(kinds, n, p))))
    best = strong.orderBy(F.desc("g2"), "term").limit(MAX_ENTRIES).select("term", "weight", "pos").collect()  # bounded
    lex.entries.update(_nested({r["term"]: (r["weight"], r["pos"]) for r in best}))
    starts = [e for e in lex.entries if not e.endswith(" ")]
    begins = [F.substring("term", 1, k).isin([e for e in starts if len(e) == k]) for k in range(MIN_PREFIX, MAX_PREFIX + 1)
              if any(len(e) == k for e in starts)]
    if begins:
        cond = begins[0]
        for b in begins[1:]:
            cond = cond | b
        usual = counts.where(F.col("term").endswith("~") & cond & (F.col("neg") >= MIN_HOLDERS)
                             & (F.col("pos") / p < F.col("neg") / n))
        lex.exceptions |= {r["term"][:-1] for r in usual.orderBy(F.desc("neg"), "term").limit(MAX_ENTRIES).collect()}
    return lex


def _hits(folded: str, automaton) -> tuple[float, int, float]:
    """Summed weight, number and greatest weight of a folded text's hits."""
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(folded):
        start = end - size + 1
        if w:
            best[start] = max(w, best.get(start, 0.0))
        else:
            excused.append((start, end))
    if excused and best:
        inside = set()
        for a, b in excused:
            inside.update(s for s in range(a, b) if s in best)
        for s in inside:
            del best[s]
    return sum(best.values()), len(best), max(best.values(), default=0.0)


_BLANKS = re.compile(" {2,}")


def features(texts, lex: Lexicon) -> np.ndarray:
    """Per text: logarithms of the summed weight, of the weight per hundred words
    and of the number of hits, and the heaviest hit."""
    out = np.zeros((len(texts), 4))
    if not lex.entries:
        return out
    auto = lex.automaton()
    for i, text in enumerate(texts):
        folded = f" {fold(text)} "
        if lex.exceptions:
            folded = _BLANKS.sub(" ", folded)  # phrases span any white space
        w, n, top = _hits(folded, auto)
        if w:
            out[i] = math.log1p(w), math.log1p(100 * w / max(1, len(folded.split()))), math.log1p(n), top
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant comes first."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, a.T @ (y - p) - pen * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED, **lexicon) -> Lexicon:
    scratch = C.Scratch(docs.sparkSession, "toxicity")
    sample = scratch.cut(labelled_sample(docs, labels, label, limit), "sample")
    lex = learn_lexicon(sample, scratch, **lexicon)

    def measured(batches):
        for pdf in batches:
            f = features(pdf["text"], lex)
            yield pd.DataFrame({**{c: f[:, k] for k, c in enumerate("abcd")}, "y": pdf["y"].astype("int32")})

    rows = C.spread(sample).mapInPandas(measured, "a double, b double, c double, d double, y int")
    rows = rows.toPandas().sort_values(list("abcdy"))  # at most ``limit`` rows
    if rows["y"].nunique() == 2:
        lex.coef = tuple(logistic_fit(rows[list("abcd")].to_numpy(), rows["y"].to_numpy(float), ridge=0.1).tolist())
        lex.fitted = True
    scratch.drop("sample", "terms")
    return lex


def score(texts, lex: Lexicon) -> np.ndarray:
    if not lex.fitted:
        return np.zeros(len(texts))
    z = lex.coef[0] + features(texts, lex) @ np.array(lex.coef[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, score."""
    def scored(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score(pdf["text"], lex)})

    scores = docs.select(C.as_text("doc_id"), "text").mapInPandas(scored, "doc_id string, score double")
    return scores.withColumn("doc_id", F.col("doc_id").cast("long"))


def reject_toxic(docs: DataFrame, lex: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold."""
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(score(text, lex))

    return docs.where(scored("text") < F.lit(threshold))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    lex = fit(docs, C.table(spark, sf_dir, "labels"))
    return score_documents(docs, lex).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
