"""Quality by regularised quadratic discriminant analysis.

Every whole text becomes a short vector of statistics (lengths, character and
word make-up, repetition), each brought near symmetry by a logarithm or root.
Per class, count, sum and second moments are added up over all labelled rows in
Spark; the class covariances are shrunk towards the pooled one and its diagonal.
A document's score is the logistic of its scaled difference of log densities,
each the Mahalanobis distance by forward substitution with the class's cached
Cholesky factor.  The scale is fitted on a bounded sample (``MAX_CALIBRATION``).

Defined results: null and empty text have the statistics of the empty text;
labels that are null or of unknown documents are not learned from; without
labelled rows of both classes every score is 0.5; a doc_id labelled twice counts
as often; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.llm.op10_toxicity import is_held_out, logistic_fit

THRESHOLD = 0.3
#: Labelled rows that the scale of the scores is fitted on, the first by hash.
MAX_CALIBRATION = 20_000
#: Shares of the class's own, the pooled and the pooled diagonal covariance.
SHRINKAGE = (0.85, 0.1, 0.05)

# Character classes of a byte of UTF-8.
_CLASS = np.zeros(256, dtype=np.int64)
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SIGN, _HIGH, _OTHER = range(9)
_CLASS[:] = _OTHER
_CLASS[ord("a"):ord("z") + 1] = _LOWER
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _STOP
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = _SIGN
_CLASS[128:] = _HIGH

FEATURES = ("log_words", "word_bytes", "upper", "digits", "stops", "signs", "high", "lines", "short_words",
            "sign_words", "caps_words", "types", "top_word", "top_line", "dup_lines", "dup_trigrams", "stop_ends")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(1, len(raw))
    k = np.bincount(_CLASS[raw], minlength=9)
    words = data.split()
    nw = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lower = data.lower().split()
    kinds = Counter(lower)
    lines = [x.strip() for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    line_kinds = Counter(lines)
    nl = max(1, len(lines))
    tri = set(zip(lower, lower[1:], lower[2:]))
    signed = sum(c for w, c in kinds.items() if w[-1] in b"!#$%&*|~^=" )
    caps = sum(1 for w in words if len(w) > 2 and w.isupper())
    ends = sum(c for w, c in kinds.items() if w[-1:] in (b".", b"?"))
    letters = max(1, k[_LOWER] + k[_UPPER])
    return [
        np.log1p(len(words)), float(np.log(1 + sizes.mean())), float(np.sqrt(k[_UPPER] / letters)),
        float(np.sqrt(k[_DIGIT] / n)), float(np.sqrt(k[_STOP] / n)), float(np.sqrt(k[_SIGN] / n)),
        float(np.sqrt(k[_HIGH] / n)), float(np.log1p(nl) - np.log1p(nw)), float((sizes <= 3).mean()),
        float(np.sqrt(signed / nw)), float(np.sqrt(caps / nw)), float(np.log(max(1, len(kinds))) / np.log(nw + 1.0)),
        float(np.sqrt(max(kinds.values(), default=0) / nw)), float(np.sqrt(max(line_kinds.values(), default=0) / nl)),
        float(np.sqrt(1 - len(line_kinds) / nl)) if lines else 0.0,
        float(np.sqrt(max(0.0, 1 - len(tri) / max(1, len(lower) - 2)))) if len(lower) > 2 else 0.0,
        float(np.sqrt(ends / nw)),
    ]


def _measure(batches):
    for pdf in batches:
        x = np.array([statistics(t) for t in pdf["text"]], dtype=float).reshape(-1, len(FEATURES))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": list(x)})


def _moments(batches):
    """One row per class and partition: count, sums, and second moments."""
    d = len(FEATURES)
    acc = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for pdf in batches:
        x, y = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, d), pdf["y"].to_numpy()
        for c in (0, 1):
            z = x[y == c]
            acc[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    for c in (0, 1):
        yield pd.DataFrame({"y": [c] * len(acc[c]), "i": range(len(acc[c])), "v": acc[c]})


class Model:
    """Means, Cholesky factors and log determinants of the two classes, and the
    scale of the scores."""

    def __init__(self, moments: np.ndarray, shrinkage=SHRINKAGE):
        d = len(FEATURES)
        n = moments[:, 0]
        self.mean = moments[:, 1:1 + d] / n[:, None]
        cov = [moments[c, 1 + d:].reshape(d, d) / n[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)]
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        own, pool, diag = shrinkage
        floor = 1e-4 * np.eye(d)
        self.chol = [np.linalg.cholesky(own * s + pool * pooled + diag * np.diag(np.diag(pooled)) + floor) for s in cov]
        self.logdet = [2 * np.log(np.diag(c)).sum() for c in self.chol]
        self.prior = float(np.log(n[1] / n[0]))
        self.scale = (0.0, 1.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0, plus the log prior odds."""
        dens = []
        for c in (0, 1):
            z = np.linalg.solve(self.chol[c], (x - self.mean[c]).T)
            dens.append(-0.5 * ((z * z).sum(0) + self.logdet[c]))
        return dens[1] - dens[0] + self.prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """The difference on a scale that damps far-off documents."""
        return np.arcsinh(self.difference(x) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale[0] + self.scale[1] * self.inputs(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", shrinkage=SHRINKAGE) -> Model | None:
    """``measured`` is (doc_id, x); learns from labels outside the held-out fold."""
    y = F.col(label).cast("int")
    marked = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", y.alias("y"))
    rows = measured.join(marked, "doc_id").select("doc_id", "x", "y")
    sums = rows.mapInPandas(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    got = sums.collect()  # 2 x (1 + d + d * d) numbers
    d = len(FEATURES)
    moments = np.zeros((2, 1 + d + d * d))
    for r in got:
        moments[r["y"], r["i"]] = r["v"]
    if moments[:, 0].min() < 2:
        return None
    model = Model(moments, shrinkage)
    some = C.hash_sample(rows, F.xxhash64("doc_id", "y"), MAX_CALIBRATION, int(moments[:, 0].sum())).select("x", "y").toPandas()
    x, t = np.array(some["x"].tolist(), dtype=float), some["y"].to_numpy(float)
    if len(set(t)) == 2:
        a, b = logistic_fit(model.inputs(x)[:, None], t, ridge=0.1)
        model.scale = (float(a), float(b))
    return model


def measure(docs: DataFrame) -> DataFrame:
    measured = docs.select(C.as_text("doc_id"), "text").mapInPandas(_measure, "doc_id string, x array<double>")
    return measured.withColumn("doc_id", F.col("doc_id").cast("long"))


def score_measured(measured: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score."""
    def scored(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s})

    scores = measured.select(C.as_text("doc_id"), "x").mapInPandas(scored, "doc_id string, score double")
    return scores.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "quality")
    measured = scratch.cut(measure(C.table(spark, sf_dir, "documents")), "measured")
    model = fit(measured, C.table(spark, sf_dir, "labels"))
    return score_measured(measured, model).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
