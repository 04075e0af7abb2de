"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = 1 / (1 + exp(theta_k - w . x)) with one weight vector for all
thresholds theta_1 < theta_2 < ...; the expected severity is the sum of these
probabilities. x are log(1 + occurrences in a hundred words) of the document's terms,
for the terms that part the labels most; documents are scored over their whole texts in batches.

Terms, weights and thresholds are fitted to at most ``SAMPLE`` labelled
documents, chosen by hash. Terms are words and their beginnings. Labels say toxic or not; a toxic document's grade
(1 to ``GRADES``) is the tercile of its density of the terms that lean toxic,
so grades order the toxic documents by how much of it they hold.

Defined cases: null and empty texts have no terms and the lowest severity;
labels without documents are passed by; without labels of both kinds no
document is toxic; repeated rows get equal scores; an empty table gives an
empty result; very long texts are scored whole; all columns are kept (but for
``__toxic`` and ``__severity``, which are replaced) and other columns are not looked at.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spare
from .quality import labelled

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 6_000
TERMS = 256  # features, at most
PREFIXES = (4, 5, 6, 7)  # lengths of the word beginnings that count as terms
GRADES = 3
REJECT = 0.4  # least probability of grade 1 or more of a rejected document
_EDGE = string.punctuation + "¡¿«»“”„’‘…"


def words(text: str | None) -> dict[str, int]:
    """How often each word occurs, in lower case and without signs at its ends."""
    out: dict[str, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(_EDGE)
        if word:
            out[word] = out.get(word, 0) + n
    return out


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings with a mark."""
    return [word, *[f"{word[:k]}~" for k in PREFIXES if len(word) > k]]


def terms(held: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for word, n in held.items():
        for term in terms_of(word):
            out[term] = out.get(term, 0) + n
    return out


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, names: list[str], w: np.ndarray, theta: np.ndarray):
        self.index = {t: i for i, t in enumerate(names)}
        self.heads = {t.rstrip("~")[: PREFIXES[0]] for t in names}
        self.w, self.theta = w, theta

    def score(self, text: str | None) -> tuple[float, float]:
        """(P(grade >= 1), expected severity)."""
        z = 0.0
        held = words(text)
        size = sum(held.values())
        near = {word: n for word, n in held.items() if word[: PREFIXES[0]] in self.heads}
        for term, n in terms(near).items():
            i = self.index.get(term)
            if i is not None:
                z += self.w[i] * math.log1p(100 * n / size)
        p = 1 / (1 + np.exp(np.clip(self.theta - z, -30, 30)))
        return float(p[0]), float(p.sum())


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 3e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) by Adam on the mean log-likelihood of the cumulative-link model."""
    n, d = x.shape
    share = np.array([(y >= k).mean() for k in range(1, grades + 1)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    # theta_1 and the logs of the gaps keep the thresholds in order
    params = np.r_[np.zeros(d), theta[0], np.log(np.maximum(np.diff(theta), 1e-2))]
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, first, gaps = params[:d], params[d], np.exp(params[d + 1 :])
        theta = first + np.r_[0, np.cumsum(gaps)]
        z = x @ w
        edge = np.column_stack((np.full(n, 1.0), 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -30, 30))), np.zeros(n)))
        hi, lo = edge[np.arange(n), y], edge[np.arange(n), y + 1]
        like = np.maximum(hi - lo, 1e-12)
        dz = -(hi * (1 - hi) - lo * (1 - lo)) / like / n
        dtheta = np.zeros(grades)
        for k in range(1, grades + 1):
            at = y == k
            dtheta[k - 1] += ((hi * (1 - hi) / like)[at]).sum() / n
            at = y + 1 == k
            dtheta[k - 1] -= ((lo * (1 - lo) / like)[at]).sum() / n
        g = np.r_[x.T @ dz + ridge * w, dtheta.sum(), np.cumsum(dtheta[::-1])[::-1][1:] * gaps]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:d], params[d] + np.r_[0, np.cumsum(np.exp(params[d + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    rows = labelled(docs.select(id_col, text_col), labels, "toxic", sample, id_col)
    rows = cut(rows.groupBy("__id").agg(F.first("__y").alias("__y"), F.max("__text").alias("text")).repartition(32, "__id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("id", "y", "term", "n", "size")}
            for name, y, text in zip(pdf["__id"], pdf["__y"], pdf["text"], strict=True):
                plain = words(text)
                held = terms(plain)
                for c, v in (("id", name), ("y", int(y)), ("size", sum(plain.values()))):
                    out[c] += [v] * len(held)
                out["term"] += held.keys()
                out["n"] += held.values()
                if len(out["id"]) > 200_000:
                    yield pd.DataFrame(out)
                    out = {c: [] for c in out}
            if out["id"]:
                yield pd.DataFrame(out)

    counted = rows.mapInPandas(count, "id long, y int, term string, n long, size long")
    counted = cut(counted)
    sizes = {r.y: r.k for r in labels.groupBy(F.col("toxic").alias("y")).agg(F.countDistinct(id_col).alias("k")).where("y IS NOT NULL").collect()}
    if len(sizes) < 2:
        return None
    ratio = sizes.get(1, 1) / max(1, sizes.get(0, 1))
    by_term = counted.groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("all")).where("all >= 4")
    # how far a term's share of toxic documents is from the corpus's, in deviations
    expected = F.col("all") * (ratio / (1 + ratio))
    z = (F.col("pos") - expected) / F.sqrt(expected + 1)
    chosen = by_term.select("term", z.alias("z")).orderBy(F.abs("z").desc(), "term").limit(TERMS)
    lean = {r.term: r.z for r in chosen.collect()}
    names = sorted(lean)
    if not names:
        return None
    index = {t: i for i, t in enumerate(names)}
    got = counted.where(F.col("term").isin(names)).select("id", "y", "term", "n", "size").collect()
    # documents without any of the terms are all alike
    total = {int(y): labels_ for y, labels_ in ((r.y, r.k) for r in rows.groupBy(F.col("__y").alias("y")).agg(F.countDistinct("__id").alias("k")).collect())}
    ids = {name: i for i, name in enumerate(sorted({r.id for r in got}))}
    x, y, density = np.zeros((len(ids), len(names)), np.float32), np.zeros(len(ids), int), np.zeros(len(ids))
    strong = {t for t, v in lean.items() if v > 4}
    for r in got:
        i = ids[r.id]
        x[i, index[r.term]] = np.log1p(100 * r.n / r.size)
        y[i] = r.y
        density[i] += r.n / r.size if r.term in strong else 0
    bare = [np.full(max(0, k - int((y == label).sum())), label) for label, k in sorted(total.items())]
    x = np.concatenate((x, np.zeros((sum(map(len, bare)), len(names)), np.float32)))
    density = np.concatenate((density, np.zeros(len(x) - len(density))))
    y = np.concatenate((y, *bare)).astype(int)
    if len(np.unique(y)) < 2:
        return None
    marks = np.quantile(density[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + (density[:, None] > marks[None, :]).sum(axis=1), 0)
    w, theta = fit_ordinal(x.astype(float), grade, GRADES)
    return Ordinal(names, w, theta)


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with __toxic (P(grade >= 1)) and __severity (the expected grade)."""
    model = fit(docs, labels, sample, id_col, text_col)
    if model is None:
        return docs.withColumns({"__toxic": F.lit(0.0), "__severity": F.lit(0.0)})

    @F.pandas_udf("struct<toxic:double,severity:double>")
    def scored(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in text], columns=["toxic", "severity"])

    (held,) = spare(docs, "scored")
    out = docs.withColumn(held, scored(F.col(text_col)))
    return out.withColumns({"__toxic": F.col(held)["toxic"], "__severity": F.col(held)["severity"]}).drop(held)


def op5_toxicity_ordinal(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs, labels).select("doc_id", F.round("__severity", 6).alias("severity"), (F.col("__toxic") >= REJECT).alias("toxic"))
