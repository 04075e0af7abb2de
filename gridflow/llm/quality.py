"""Document quality: a classifier's evidence combined with site posteriors by empirical Bayes.

1. Features of each text's form (signs, capitals, repeats, word lengths) are
   counted in Arrow batches. A logistic model is fitted to at most ``SAMPLE``
   labelled documents, chosen by hash; only their features reach the driver.
2. The model's probabilities are summed for each path and host over all
   documents (a combining aggregate, so a host with a third of all rows is
   summed in parts). Prior strengths follow from the variance between hosts and
   between the paths of a host (method of moments); a path's mean is shrunk
   toward its host's and a host's toward the corpus's, the more the fewer
   documents there are.
3. A document's log-odds move by its path's posterior, without the document's
   own share, against the corpus's mean.

Defined cases: null and empty texts have neutral features (zeros); null hosts
and paths are sites of their own; ids without labels and labels without
documents are passed by; without labels of both kinds every document keeps
probability 1; repeated rows get equal scores; an empty table gives an empty
result; very long texts are scored whole; all columns are kept (but for one
called ``__quality``, which is replaced) and other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, spare

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 20_000
SIGNS = "#$%&*|!~^{}<>\\@=+_"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
DIGITS = "0123456789"
STOPS = ".,"
_COUNTED = SIGNS + CAPITALS + DIGITS + STOPS
_SPACE = re.compile("[\x20\\t-\\r]+")
KEEP = 0.5  # least probability of a document that is kept


def shape(text: str | None) -> list[float]:
    """Features of about unit scale; the text's letters are counted once, its words split once."""
    text = text or ""
    n = max(1, len(text))
    words = _SPACE.split(text)
    count, distinct = len(words), len(set(words))
    held = Counter(text) if n < 200 else {c: text.count(c) for c in _COUNTED}
    signs, capitals, digits, stops = (sum(held.get(c, 0) for c in kind) / n for kind in (SIGNS, CAPITALS, DIGITS, STOPS))
    return [
        math.sqrt(signs) * 4,
        math.sqrt(capitals) * 3,
        math.sqrt(digits) * 4,
        math.log(count) / 5,
        distinct / count * 2,
        math.log(distinct) / 5,
        (n / count) / 8,
        math.sqrt(stops) * 4,
    ]


def features(text: Column) -> Column:
    """The features of each text, as an array."""

    @F.pandas_udf("array<double>")
    def shapes(texts: pd.Series) -> pd.Series:
        return pd.Series([shape(t) for t in texts], dtype=object)

    return shapes(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x, x**2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]] / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * ridge / 10
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids with the documents (two columns): (__id, __y, __text); by hash of the id."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(target).alias("__y"))
    chosen = cut(one.orderBy(F.xxhash64("__id"), "__id").limit(bound))
    return docs.toDF("__id", "__text").join(F.broadcast(chosen), "__id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    rows = labelled(docs.select(id_col, text_col), labels, "quality", sample, id_col).select("__id", "__y", features(F.col("__text")).alias("f"))
    one = rows.groupBy("__id").agg(F.first("__y").alias("y"), F.min("f").alias("f"))
    got = np.array([(r.y, *r.f) for r in one.select("y", "f").collect()], float)
    if not len(got) or len(np.unique(got[:, 0])) < 2:
        return None
    got = got[np.lexsort(got.T)]
    return fit_logistic(got[:, 1:], got[:, 0])


def log_odds(text: Column, w: np.ndarray | None) -> Column:
    if w is None:
        return F.lit(30.0)

    # as nondeterministic, so that a filter on the result is not pushed below and scored again there, by a second set of workers
    @F.pandas_udf("double")
    def odds(texts: pd.Series) -> pd.Series:
        f = np.array([shape(t) for t in texts], float).reshape(len(texts), -1)
        return pd.Series(np.clip(w[0] + np.hstack((f, f**2)) @ w[1:], -30, 30) if len(f) else [], dtype=float)

    return odds.asNondeterministic()(text)


@dataclass(frozen=True)
class Prior:
    mean: float  # of the corpus
    host: float  # strength of the corpus's mean for a host
    path: float  # strength of a host's mean for a path


def strength(mean: float, between: float) -> float:
    """The pseudo-count of a beta prior with this variance between groups."""
    return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, n, s, host_mean) of rows (host, path, p), cut, and the priors."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    if not total["n"]:
        return paths.withColumn("host_mean", F.lit(0.5)), Prior(0.5, 1.0, 1.0)
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))

    def between(table: DataFrame, n: str, s: str, ss: str, center: Column) -> float:
        """Variance of the groups' means beyond what their sizes explain."""
        m = F.col(s) / F.col(n)
        noise = (F.col(ss) / F.col(n) - m * m) / F.greatest(F.col(n) - 1, F.lit(1))
        r = table.agg(F.sum(F.col(n) * (F.pow(m - center, F.lit(2)) - noise)).alias("v"), F.sum(n).alias("n")).first()
        return max(0.0, r["v"] / r["n"])

    k_host = strength(mean, between(hosts, "hn", "hs", "hss", F.lit(mean)))
    with_host = cut(paths.join(hosts.select("host", "hn", "hs"), "host"))
    k_path = strength(mean, between(with_host, "n", "s", "ss", F.col("hs") / F.col("hn")))
    host_mean = (F.col("hs") + k_host * mean) / (F.col("hn") + k_host)
    return cut(with_host.select("host", "path", "n", "s", host_mean.alias("host_mean"))), Prior(mean, k_host, k_path)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _chance(odds: str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(odds)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host_col: str = "source",
    path_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with __quality: the probability of good quality; a column of that name is replaced."""
    w = fit(docs, labels, sample, id_col, text_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")
    names = [c for c in keep or docs.columns if c != "__quality"]
    if w is None:
        return docs.select(*names, F.lit(1.0).alias("__quality"))
    odds_, h, q, p, host_, path_, n, s, mean = spare(docs, "odds", "h", "q", "p", "host", "path", "n", "s", "mean")
    mine = docs.select(*names, log_odds(F.col(text_col), w).alias(odds_), host.alias(h), path.alias(q))
    if text_col not in names:
        # scored once, for the sites' sums and for the documents; whole texts would take more disk than that is worth
        mine = cut(mine)
    scored = mine.select(F.col(h).alias("host"), F.col(q).alias("path"), _chance(odds_).alias("p"))
    sites, prior = site_posteriors(scored)
    sites = small(sites.toDF(host_, path_, n, s, mean))
    joined = mine.withColumn(p, _chance(odds_)).join(sites, (F.col(h) == F.col(host_)) & (F.col(q) == F.col(path_)), "left")
    # the path's posterior from its other documents
    site = (F.col(s) - F.col(p) + prior.path * F.col(mean)) / (F.col(n) - 1 + prior.path)
    moved = F.col(odds_) + _logit(site) - math.log(prior.mean / (1 - prior.mean))
    return joined.select(*names, (F.lit(1.0) / (F.lit(1.0) + F.exp(-moved))).alias("__quality"))


def op6_quality_bayes(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, keep=("doc_id",)).select("doc_id", F.round("__quality", 6).alias("quality"), (F.col("__quality") >= KEEP).alias("kept"))
