"""Near-duplicate documents by b-bit MinHash, with links confirmed on full sets.

1. Each text becomes its set of word shingles (64-bit hashes), ``rows * bands``
   minima, one hash a band, and the two low bits of 128 minima packed into two
   bit planes (``BITS`` = 2).
2. Texts with equal sets form one class (pre-aggregated); a class goes on as its
   smallest id, so exact copies cost one row from here on.
3. Classes that share a band's hash are candidates. Their packed signatures are
   compared by bit counts: with C = 2**-BITS the chance that unequal minima
   agree, similarity is (agreeing share - C) / (1 - C). Only pairs that are
   clearly too low by that estimate are left out.
4. Candidates are confirmed on their full sets, and links become components.

A band's bucket may hold a third of all classes. Its members are first compared
with one leader, and those still apart with another, each round linear in the
bucket. What is then left are pairs of different components inside a bucket,
and all of them are looked at: few, as rows of a join that leaves out pairs
within the bucket's largest component; many, inside tasks that
each get two blocks of the bucket's members with their sets (no estimate comes
first there) and give back only links that join components. So no pairs of a settled group are formed, none of
a large bucket become rows, and no link is lost.

The chance that a pair at the threshold shares no band is (1 - s**rows)**bands:
6e-7 for s = 0.85 and 5 rows in 25 bands; that a shared pair is left out by
its estimate is below 1e-5 (``MARGIN`` is over four deviations).

Defined cases: null, empty and blank texts have an empty set, no links, and are
components of their own; shorter texts than a shingle are one shingle; repeated
rows are in one class; of rows that repeat an id with different texts, the
smallest text stands for the id; rows with a null id form no component (null)
and are kept; an empty table gives an empty result; very long texts are
worked on whole, in slices; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small

BITS = 2
PLANE = 128  # minima of which low bits are packed
MARGIN = 0.17
LEADERS = 2  # leader rounds at most
#: A bucket's remaining pairs are joined if they are at most this many per member, else compared in blocks.
PAIRS_EACH = 4
BLOCK = 1024  # members that a block holds on average
SEED = 20240229

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)


@dataclass(frozen=True)
class Spec:
    """``percent``: the least similarity of a link, in hundredths."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 32


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _P2
    return x ^ (x >> _S2)


def shingle_set(text: str | None, k: int, words: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = _mix((acc ^ h[j : j + n]) * _P1)
    return np.unique(acc)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """High 32 bits of the minima of each hash function, in slices of bounded size."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            np.minimum(low, (a * s[None, i : i + 4096] + b).min(axis=1), out=low)
    return low >> np.uint64(32)


def signatures(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, k1, k2, bands array<long>, p0..p3): one row per row of ``docs``.

    k1 and k2 are two hashes of the whole set (equal sets, equal keys); p0, p1
    hold the lowest bits of ``PLANE`` minima and p2, p3 the next ones.
    """
    schema = "id long, n long, k1 long, k2 long, bands array<long>, p0 long, p1 long, p2 long, p3 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        count = max(spec.rows * spec.bands, PLANE)
        a, b = _coefficients(count)
        for pdf in batches:
            out = {c: [] for c in ("n", "k1", "k2", "bands", "planes")}
            for text in pdf["text"]:
                with np.errstate(over="ignore"):
                    s = shingle_set(text, spec.shingle, words)
                out["n"].append(len(s))
                raw = s.tobytes()
                out["k1"].append(xxhash.xxh3_64_intdigest(raw, 1))
                out["k2"].append(xxhash.xxh3_64_intdigest(raw, 2))
                if not len(s):
                    out["bands"].append(None)
                    out["planes"].append(np.zeros(4, np.int64))
                    continue
                m = _minima(s, a, b)
                rows = np.ascontiguousarray(m[: spec.rows * spec.bands].reshape(spec.bands, spec.rows).astype(np.uint32))
                out["bands"].append([xxhash.xxh3_64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(rows)])
                bits = [np.packbits(((m[:PLANE] >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)) for i in range(BITS)]
                out["planes"].append(np.concatenate(bits).view(np.int64))
            planes = np.stack(out["planes"]) if out["planes"] else np.zeros((0, 4), np.int64)
            yield pd.DataFrame(
                {
                    "id": pdf["id"].astype("Int64"),
                    "n": out["n"],
                    "k1": np.array(out["k1"], np.uint64).view(np.int64),
                    "k2": np.array(out["k2"], np.uint64).view(np.int64),
                    "bands": out["bands"],
                    **{f"p{i}": planes[:, i] for i in range(4)},
                }
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, schema)


def shingle_sets(docs: DataFrame, spec: Spec) -> DataFrame:
    """(id, s array<long>) of rows (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in batches:
            with np.errstate(over="ignore"):
                sets = [shingle_set(t, spec.shingle, words).view(np.int64) for t in pdf["text"]]
            for i in range(0, len(sets), 256):
                yield pd.DataFrame({"id": pdf["id"].iloc[i : i + 256], "s": sets[i : i + 256]})

    return docs.mapInPandas(run, "id long, s array<long>")


def _estimate_of(x: str, y: str) -> Column:
    """Collision-corrected similarity of the packed signatures ``x`` and ``y`` (struct columns)."""
    apart = F.lit(0)
    for i in (0, 1):
        apart = apart + F.bit_count(
            F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}")).bitwiseOR(F.col(f"{x}.p{i + 2}").bitwiseXOR(F.col(f"{y}.p{i + 2}")))
        )
    chance = 2.0**-BITS
    return (F.lit(1.0) - apart / F.lit(float(PLANE)) - F.lit(chance)) / F.lit(1.0 - chance)


def _confirm(pairs: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """(a, b, link): the exact comparison of the full sets of distinct ``pairs`` (cut).

    Pairs meet in groups by the blocks of their ends, so a set travels once to
    each group that needs it, however many pairs it has there.
    """
    members = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    blocks = members.count() // (BLOCK // 2) + 1
    sets = shingle_sets(texts.join(small(members), "id", "left_semi"), spec)
    keyed = pairs.select("a", "b", *[F.pmod(F.xxhash64(c, F.lit(5)), F.lit(blocks)).alias(f"g{c}") for c in ("a", "b")])
    needs = keyed.select(F.col("ga").alias("ha"), F.col("gb").alias("hb"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
    percent = spec.percent

    def run(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        s = dict(zip(held["id"], held["s"], strict=True))
        link = []
        for a, b in zip(mine["a"], mine["b"], strict=True):
            x, y = s[a], s[b]
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            link.append(both * 100 >= (len(x) + len(y) - both) * percent)
        return pd.DataFrame({"a": mine["a"], "b": mine["b"], "link": np.array(link, bool)})

    grouped = keyed.groupBy("ga", "gb").cogroup(needs.groupBy("ha", "hb"))
    return cut(grouped.applyInPandas(run, "a long, b long, link boolean"))


def near_duplicates(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = cut(signatures(texts, spec, "id", "text"))
    # ids with rows of different sets: the smallest text stands for all of them
    of_set = F.struct("k1", "k2", "n")
    torn = sig.where("id IS NOT NULL").groupBy("id").agg(F.min(of_set).alias("lo"), F.max(of_set).alias("hi"), F.count("*").alias("rows"))
    torn = cut(torn.where("lo <> hi").select("id", "rows"))
    if not torn.isEmpty():
        one = cut(texts.join(torn.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
        again = signatures(one, spec, "id", "text").join(torn, "id").withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
        sig = cut(sig.join(torn.select("id"), "id", "left_anti").unionByName(again))
        texts = texts.join(torn.select("id"), "id", "left_anti").unionByName(one)
    planes = [f"p{i}" for i in range(4)]
    classes = cut(
        sig.where("n > 0 AND id IS NOT NULL")
        .groupBy("k1", "k2", "n")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"), *[F.first(p).alias(p) for p in planes])
    )
    links = _links(classes, texts, spec)
    if links is None:
        labelled = classes.select("k1", "k2", "n", F.col("id").alias("component_id"))
    else:
        comp = components(links)
        labelled = classes.join(comp, classes["id"] == comp["node"], "left").select(
            "k1", "k2", "n", F.coalesce("component", "id").alias("component_id")
        )
    return sig.join(labelled, ["k1", "k2", "n"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


def _links(classes: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame | None:
    """Confirmed links (a, b) between classes that connect all that belong together."""
    packed = F.struct("p0", "p1", "p2", "p3").alias("p")
    least = spec.percent / 100 - MARGIN
    # n bounds the similarity: members are only compared within that factor
    at = classes.select("id", "n", packed, F.posexplode("bands").alias("band", "h"))
    shared = at.groupBy("band", "h").agg(F.count("*").alias("m")).where("m > 1").select("band", "h")
    members = cut(at.join(shared, ["band", "h"]))
    if members.isEmpty():
        return None
    of_id = classes.select("id", "n", packed)
    links: DataFrame | None = None
    tested: DataFrame | None = None
    apart = members.select("band", "h", "id").withColumn("component", F.col("id"))
    for turn in range(LEADERS):
        if _few_pairs(apart).where("NOT few").isEmpty():
            break
        # a leader for each bucket that is still in parts, drawn differently each round
        order = F.struct(F.xxhash64("component", F.lit(turn)), F.xxhash64("id", F.lit(turn)), F.col("id"))
        lead = apart.groupBy("band", "h").agg(F.min_by("id", order).alias("leader"), F.min_by("component", order).alias("lead_in"))
        pairs = (
            apart.join(lead, ["band", "h"])
            .where(F.col("component") != F.col("lead_in"))
            .select(F.col("leader").alias("a"), F.col("id").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        done = _confirm(_estimated(pairs, of_id, least), texts, spec)
        tested = done if tested is None else tested.unionAll(done)
        links = tested.where("link").select("a", "b")
        apart = _still_apart(members, links)
        if apart.isEmpty():
            return links
    # what is left: all pairs of different components, within their buckets
    kinds = cut(_few_pairs(apart))
    more = [] if links is None else [links]
    near = of_id.select(F.col("id").alias("a"), F.struct("n", "p").alias("pa"))
    far = of_id.select(F.col("id").alias("b"), F.struct("n", "p").alias("pb"))
    close = (
        _opposed(apart, kinds.where("few"), near, far)
        .where(F.col("ca") != F.col("cb"))
        .where(_sizes("pa.n", "pb.n", spec) & (_estimate_of("pa.p", "pb.p") >= least))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    if tested is not None:
        seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        close = close.join(seen, ["a", "b"], "left_anti")
    more.append(_confirm(cut(close), texts, spec).where("link").select("a", "b"))
    many = cut(apart.join(kinds.where("NOT few"), ["band", "h"]))
    if not many.isEmpty():
        more.append(_in_blocks(many, texts, spec))
    out = more[0]
    for m in more[1:]:
        out = out.unionAll(m)
    return out


def _few_pairs(apart: DataFrame) -> DataFrame:
    """(band, h, few, main, n_main, n_rest): whether a bucket's pairs of different components are
    few against its members, its largest component, and the members in and out of that."""
    by_part = apart.groupBy("band", "h", "component").agg(F.count("*").alias("m"))
    top = F.max(F.struct("m", "component"))
    by_bucket = by_part.groupBy("band", "h").agg(F.sum("m").alias("m"), F.sum(F.col("m").cast("double") * F.col("m")).alias("own"), top.alias("top"))
    pairs = (F.col("m").cast("double") * F.col("m") - F.col("own")) / 2
    return by_bucket.select(
        "band",
        "h",
        (pairs <= F.col("m") * PAIRS_EACH).alias("few"),
        F.col("top.component").alias("main"),
        F.col("top.m").alias("n_main"),
        (F.col("m") - F.col("top.m")).alias("n_rest"),
    )


def _opposed(apart: DataFrame, kinds: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Pairs (a, ca, b, cb, pa, pb) of the members of the buckets ``kinds``: those out of its largest component against all.

    Few pairs of different components mean few members out of the largest one, so the pairs are
    linear in the bucket. Large buckets are dealt out by ``b`` in parts of about ``BLOCK``.
    """
    parts = F.ceil((F.col("n_main") + F.col("n_rest")) / BLOCK).cast("int")
    all_ = apart.join(kinds.select("band", "h", "main", parts.alias("parts")), ["band", "h"])
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    x = all_.where("component <> main").select("band", "h", every, F.col("id").alias("a"), F.col("component").alias("ca")).join(near, "a")
    salt = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int").alias("salt")
    y = all_.select("band", "h", salt, F.col("id").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("in_main")).join(far, "b")
    # pairs out of the largest component are met from both sides, those with it from one
    return x.join(y, ["band", "h", "salt"]).where(F.col("in_main") | (F.col("a") < F.col("b")))


def _in_blocks(many: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """Links between different components of large buckets, compared two blocks at a time.

    The largest component of a bucket has blocks of its own, which meet only
    the blocks of the rest; the rest's blocks meet each other and themselves.
    """
    r = F.ceil(F.col("n_rest") / BLOCK).cast("int")
    m = F.ceil(F.col("n_main") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("component") == F.col("main"), m).otherwise(r)).cast("int")
    # names of blocks: the rest's are 0 .. r - 1, the main component's -1 .. -m
    others = F.when(
        F.col("component") == F.col("main"), F.transform(F.sequence(F.lit(0), r - 1), lambda j: F.struct(j.alias("x"), (-mine - 1).alias("y")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), r - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"))),
            F.transform(F.sequence(F.lit(1), m), lambda j: F.struct(mine.alias("x"), (-j).alias("y"))),
        )
    )
    placed = many.select("band", "h", "id", "component", F.explode(others).alias("o")).select("band", "h", "o.x", "o.y", "id", "component")
    members = cut(many.select("id").distinct())
    sets = shingle_sets(texts.join(small(members), "id", "left_semi"), spec)
    percent = spec.percent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _links_within(pdf["id"].to_numpy(), pdf["component"].to_numpy(), list(pdf["s"]), percent)

    return cut(placed.join(sets, "id").groupBy("band", "h", "x", "y").applyInPandas(run, "a long, b long").distinct())


def _links_within(ids: np.ndarray, parts: np.ndarray, sets: list, percent: int) -> pd.DataFrame:
    """Links that join different parts: enough of them to join all that belong together."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, -sizes))
    ids, parts, sizes, sets = ids[order], parts[order], sizes[order], [sets[i] for i in order]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.zeros(len(vocabulary), np.int32)
    _, part = np.unique(parts, return_inverse=True)
    out = []
    for i in range(len(ids) - 1):
        # sizes fall: sets from ``last`` on are too small to be linked
        last = i + 1 + int(np.searchsorted(-sizes[i + 1 :] * 100, -sizes[i] * percent, side="right"))
        if last <= i + 1 or (part[i + 1 : last] == part[i]).all():
            continue
        seen[flat[ends[i] : ends[i + 1]]] = 1
        both = np.add.reduceat(seen[flat[ends[i + 1] : ends[last]]], ends[i + 1 : last] - ends[i + 1])
        seen[flat[ends[i] : ends[i + 1]]] = 0
        linked = np.flatnonzero(both * 100 >= (sizes[i] + sizes[i + 1 : last] - both) * percent) + i + 1
        for j in linked:
            if part[j] != part[i]:
                out.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _sizes(x: str, y: str, spec: Spec) -> Column:
    """Sets whose sizes differ by more than this factor can't be linked."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * spec.percent


def _estimated(pairs: DataFrame, of_id: DataFrame, least: float) -> DataFrame:
    near = of_id.select(F.col("id").alias("a"), F.col("p").alias("pa"))
    far = of_id.select(F.col("id").alias("b"), F.col("p").alias("pb"))
    return cut(pairs.join(far, "b").join(near, "a").where(_estimate_of("pa", "pb") >= least).select("a", "b"))


def _still_apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(band, h, id, component) of buckets that hold more than one component."""
    comp = components(links)
    now = members.select("band", "h", "id").join(comp, F.col("id") == comp["node"], "left").select("band", "h", "id", F.coalesce("component", "id").alias("component"))
    parts = now.groupBy("band", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "h")
    return cut(now.join(parts, ["band", "h"]))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, Spec(shingle=3, percent=85, rows=5, bands=25))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w
), one AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), t AS (SELECT id, n, unnest(s) AS t FROM one
), pairs AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)
), reach AS (SELECT id, id AS other FROM one UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), class AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN one o ON s.s = o.s LEFT JOIN class c ON o.id = c.id
"""
