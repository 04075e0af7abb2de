"""Language identification: a sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three letters of the lower-cased text, with the edge of
a word as a letter of its own, hashed to ``DIM`` places; (1 + log tf) * idf, scaled to length 1. Document frequencies come
from all documents that may be learned from. The weights are fitted
by follow-the-regularised-leader with L1 and L2 penalties (most become 0), one document at a time
over ``EPOCHS`` passes of at most ``SAMPLE`` documents, chosen by hash and dealt evenly over
languages; a fifth of them is held back to fit the temperature that calibrates the scores.
Every text is then scored whole, in batches.

Documents with crc32(id) mod 4 = 2 are held out: nothing is learned from them. A null id counts as empty text there.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing can be learned; documents of
a null language are not learned from; ties go to the language that is first by its bytes; repeated rows are learned from and
scored like others; an empty table gives an empty result; long texts are worked on in
slices cut at ends of words, with equal counts; other columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

DIM = 1 << 16
#: Documents that the model is fitted to, at most.
SAMPLE = 4_000
EPOCHS = 3
SLICE = 1 << 17  # characters worked on at once, and the rest of a word
# of the fit: learning rate and its smoothing, penalties
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01

_EDGE = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _ALPHA[0]


def _slices(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        b = min(len(text), a + SLICE)
        while b < len(text) and text[b - 1].isalpha():
            b += 1
        yield text[a:b]
        a = b


def _places(text: str) -> np.ndarray:
    """The places of all n-grams of a slice."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.r_[np.uint32(_EDGE), np.where(_letters()[points], points, np.uint32(_EDGE)), np.uint32(_EDGE)]
    edge = points == _EDGE
    points = points[np.r_[True, ~(edge[1:] & edge[:-1])]].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    edge = points == _EDGE
    a, b, c = points[:-2], points[1:-1], points[2:]
    with np.errstate(over="ignore"):
        one = points[~edge] * _MIX[0]
        two = points[:-1] * _MIX[1] + points[1:] * _MIX[2] + np.uint64(1)
        three = ((a * _MIX[2] + b) * _MIX[0] + c * _MIX[1] + np.uint64(2))[~edge[1:-1]]
        h = np.concatenate((one, two, three))
        h = (h ^ h >> np.uint64(31)) * _MIX[0]
    return (h >> np.uint64(48)).astype(np.int64)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, how often): the n-grams of a whole text; empty if it has no letter."""
    total = None
    for part in _slices((text or "").lower()):
        found = _places(part)
        if len(found):
            n = np.bincount(found, minlength=DIM)
            total = n if total is None else total + n
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(1e-12, float(np.sqrt(v @ v)))


@dataclass(frozen=True)
class Model:
    names: list[str]
    idf: np.ndarray  # by place
    weights: np.ndarray  # place, language; the last row is the bias
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vector(at, n, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at):
            return "und", 0.0
        p = softmax(self.logits(at, n) / self.temperature)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Weights by follow-the-regularised-leader, computed from sums of gradients (z) and of their squares (n)."""

    def __init__(self, places: int, classes: int):
        self.z, self.n = np.zeros((places, classes)), np.zeros((places, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[y] -= 1
        g = v[:, None] * p[None, :]
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def fit_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """(place, class) weights, with the bias as the last place, of sparse rows (places, values)."""
    model = Ftrl(DIM + 1, classes)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            at, v = x[i]
            model.learn(np.r_[at, DIM], np.r_[v, 1.0], int(y[i]))
    return model.weights(slice(None))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least mean log-loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    a, b, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of ``docs`` (text) hold each place, and how many texts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, texts = np.zeros(DIM, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen[counts(text)[0]] += 1
            texts += len(pdf)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"place": np.r_[at, -1], "n": np.r_[seen[at], texts]})

    got = docs.select("text").mapInPandas(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # DIM rows at most
    out = np.zeros(DIM + 1, np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out[:DIM], int(out[DIM])


def sample(docs: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``docs`` (id, lang, text), by hash of the id, in numbers as equal for all languages as these allow."""
    # the most frequent languages, a row each
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(bound).collect()}
    left, share = bound, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quota = min(n, left // (len(sizes) - k))
        left -= quota
        share[lang] = quota / n
    spark = docs.sparkSession
    shares = spark.createDataFrame(list(share.items()), "lang string, share double")
    h = F.xxhash64("id")
    place = F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = docs.select("id", "lang").join(F.broadcast(shares), "lang").where(place < F.col("share"))
    chosen = cut(near.orderBy(h, "id", "lang").limit(bound).select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct())
    held = docs.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    # rows that repeat an id are one document of the sample
    return held.groupBy("id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, bound: int = SAMPLE) -> Model | None:
    """A model of the languages of ``docs`` (id, lang, text)."""
    known = docs.where(F.col("lang").isNotNull())
    seen, n = document_frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "lang": pdf["lang"], "at": [a.astype("<u2").tobytes() for a, _ in got], "n": [c.astype("<u4").tobytes() for _, c in got]})

    rows = sample(known, bound).select(F.xxhash64("id").alias("id"), "lang", "text").mapInPandas(run, "id long, lang string, at binary, n binary").toArrow().to_pandas()
    rows = rows[rows["at"].str.len() > 0].sort_values(["id", "lang"]).reset_index(drop=True)
    names = sorted(rows["lang"].unique(), key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not names:
        return None
    x = []
    for at, c in zip(rows["at"], rows["n"], strict=True):
        places = np.frombuffer(at, "<u2").astype(np.int64)
        x.append((places, vector(places, np.frombuffer(c, "<u4"), idf)))
    y = np.array([names.index(v) for v in rows["lang"]])
    back = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    weights = fit_ftrl([v for v, b in zip(x, back, strict=True) if not b], y[~back], len(names))
    model = Model(names, idf, weights, 1.0)
    if not back.any():
        return model
    logits = np.stack([v @ weights[at] + weights[-1] for (at, v), b in zip(x, back, strict=True) if b])
    return Model(names, idf, weights, fit_temperature(logits, y[back]))


def identify(model: Model | None, text: Column) -> Column:
    """(lang, score) of each text, as a struct."""
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    held = SparkSession.builder.getOrCreate().sparkContext.broadcast(model)

    # as nondeterministic, so that a text is not scored again for each field of the result
    @F.pandas_udf("struct<lang:string,score:double>")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang", "score"])

    return told.asNondeterministic()(text)


def op13_language_ftrl(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    model = fit(rows.where(~held_out(F.col("id"))))
    told = docs.select("doc_id", identify(model, F.col("text")).alias("told"))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("told.lang").alias("lang_pred"), F.round("told.score", 6).alias("score"))
