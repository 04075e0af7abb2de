"""Phrases whose words stand together more often than chance, mined from position bitmaps.

1. Texts become blocks of one language, the shards: every word and every end of a piece takes a
   position, and a word's positions in the block are a bitmap, kept as the bytes that
   are not zero (their places, and eight positions each). Blocks are written once, as a table.
2. Counts of words are summed over blocks. Only words that occur ``least`` times in
   their language can be in a phrase that does.
3. In each block phrases are extended depth-first, from a group of first words: the
   prefix's bitmap is shifted by one position and ANDed with the bitmaps of all words
   that have bits there; set bits are counted. Ends of pieces hold no word, so nothing
   crosses them. Counts of phrases are summed over blocks, those of two words first: a longer phrase needs
   both of its parts to be frequent.
4. Candidates are scored at their worst cut in exact decimals.

Blocks are not shuffled; they are told which words and parts are frequent by Bloom filters of ``BLOOM`` bits, whatever the
corpus. A filter's mistakes only let a phrase be counted that turns out to be rare; no frequent one is missed, and counts are
exact. What is shuffled are a block's distinct words and phrases with their counts. A block holds at most ``BLOCK`` positions but for
the rest of its last text, and blocks are dealt as the input is, whatever language they are in.

Defined cases: null and empty texts and pieces have no words; a null language is
``und``; repeated rows count as often as they occur; an empty table gives an empty
result; a very long text stays in one block, which grows to hold it; ties in score go to the higher count and then to the phrase's bytes; other columns are
not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ensure_checkpoint_dir

#: Positions of a block; a text goes on in its block to its end.
BLOCK = 1 << 20
#: Bytes of a group of first words' bitmaps that are extended together.
GROUP = 1 << 15
BLOOM = 1 << 26

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_END = b"."  # can't be a word
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, and any end of a piece as ``_END``.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + _END * len(_ENDS))


def tokens(text: str | None) -> list[bytes]:
    """A text's words in lower case (A-Z), with ``_END`` between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).replace(_END, b" . ").split()


class _Ids(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    """The words of one language, by position."""

    def __init__(self) -> None:
        self.ids = _Ids({_END: 0})
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        got = np.fromiter(map(self.ids.__getitem__, words), np.uint32, len(words))
        self.words += [got, np.zeros(1, np.uint32)]
        self.size += len(got) + 1

    def row(self, lang: str) -> pa.RecordBatch:
        """One row: the words, how often each occurs, how many bytes its bitmap has, and all bitmaps in the order of words."""
        word = np.concatenate(self.words)
        position = np.flatnonzero(word)
        both = np.sort(word[position].astype(np.int64) << 32 | position)
        word, position = both >> 32, both & 0xFFFFFFFF
        key = word << 32 | position >> 3
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        bits = np.bitwise_or.reduceat(np.uint8(1) << (position & 7).astype(np.uint8), first) if len(key) else np.empty(0, np.uint8)
        at, of = position[first] >> 3, word[first]
        step = np.diff(at, prepend=0)  # from byte to byte; a word's first is its place
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        step[begins] = at[begins]
        size = len(self.ids)
        columns = {
            "lang": pa.array([lang], pa.string()),
            "words": pa.array([list(self.ids)[1:]], pa.list_(pa.binary())),
            "n": pa.array([np.bincount(word, minlength=size)[1:].astype(np.int32)], pa.list_(pa.int32())),
            "sizes": pa.array([np.bincount(of, minlength=size)[1:].astype(np.int32)], pa.list_(pa.int32())),
            "at": pa.array([step.astype("<u4").tobytes()], pa.binary()),
            "bits": pa.array([bits.tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


_BLOCKS = "lang string, words array<binary>, n array<int>, sizes array<int>, at binary, bits binary"


def bitmaps(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = BLOCK) -> DataFrame:
    """(lang, words, n, sizes, at, bits): blocks of texts of one language as position bitmaps, a row each; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                block = held.setdefault(lang.as_py(), _Block())
                block.add(tokens(text.as_py()))
                if block.size >= size:
                    yield held.pop(lang.as_py()).row(lang.as_py())
        for lang, block in held.items():
            yield block.row(lang)

    narrow = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    narrow.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    return spark.read.schema(_BLOCKS).parquet(folder)


class Bloom:
    """A set of words or phrases of a language that may hold some more; of ``BLOOM`` bits, two for each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def hashes(lang: str, words: list[bytes]) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of phrases of what ``a`` and ``b`` are hashes of."""
        with np.errstate(over="ignore"):
            h = (a * _P1 ^ b) * _P2
            return h ^ h >> np.uint64(29)

    @staticmethod
    def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)

    def holds(self, h: np.ndarray) -> np.ndarray:
        one, two = (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1) for p in self.places(h, 8 * len(self.bits)))
        return (one & two).astype(bool)


def bloom(rows: DataFrame, names: tuple[str, ...]) -> Bloom:
    """The filter of rows (lang, names), words of which each is a hash's part."""
    size = BLOOM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = []
            for lang, own in pdf.groupby("lang", sort=False):
                h = Bloom.hashes(lang, list(own[names[0]]))
                for name in names[1:]:
                    h = Bloom.joined(h, Bloom.hashes(lang, list(own[name])))
                places += Bloom.places(h, size)
            p = np.unique(np.concatenate(places)).astype(np.int64)
            at, first = np.unique(p >> 5, return_index=True)
            yield pd.DataFrame({"at": at, "bits": np.bitwise_or.reduceat(np.int64(1) << (p & 31), first)})

    got = rows.select("lang", *[F.col(c).cast("binary").alias(c) for c in names]).mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # BLOOM / 32 rows at most
    bits = np.zeros(size // 32, "<u4")
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    return Bloom(bits.view(np.uint8))


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, then those of the next start."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Index:
    """The bitmaps of a block's frequent words, by word and by place."""

    def __init__(self, row: dict, frequent: Bloom):
        h = Bloom.hashes(row["lang"], row["words"])
        kept = np.flatnonzero(frequent.holds(h))
        self.words, self.hashes = pa.array(row["words"], pa.binary()).take(pa.array(kept)), h[kept]
        sizes = np.asarray(row["sizes"], np.int64)
        steps, bits = np.frombuffer(row["at"], "<u4").astype(np.int64), np.frombuffer(row["bits"], np.uint8)
        # places are running sums of each word's steps
        up, starts = np.cumsum(steps), np.cumsum(sizes) - sizes
        at = up - np.repeat(up[starts] - steps[starts], sizes) if len(sizes) else up
        own = _places(starts[kept], sizes[kept])
        self.at, self.bits = at[own], bits[own]
        self.starts = np.r_[0, np.cumsum(sizes[kept])]
        order = np.argsort(self.at)
        self.of_place = np.repeat(np.arange(len(kept)), sizes[kept])[order]
        self.bits_of_place = self.bits[order]
        counts = np.bincount(self.at, minlength=int(self.at.max(initial=0)) + 3)
        self.first, self.count = np.r_[0, np.cumsum(counts)], counts

    def groups(self, size: int) -> Iterator[tuple[int, int]]:
        """Ranges of words whose bitmaps are about ``size`` bytes."""
        a, n = 0, len(self.starts) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + size, side="right")) - 1)
            yield a, b
            a = b

    def extended(self, prefix: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix, word, at, bits) of all words that follow: the prefixes' bitmaps, shifted by one, AND those of words."""
        low, carry = bits << np.uint8(1), bits >> np.uint8(7)
        prefix, at, bits = (np.concatenate(x) for x in ((prefix[low > 0], prefix[carry > 0]), (at[low > 0], at[carry > 0] + 1), (low[low > 0], carry[carry > 0])))
        n = self.count[at]
        found = _places(self.first[at], n)
        both = np.repeat(bits, n) & self.bits_of_place[found]
        kept = np.flatnonzero(both)
        source = np.repeat(np.arange(len(at)), n)[kept]
        return prefix[source], self.of_place[found[kept]], at[source], both[kept]


def _counted(key: np.ndarray, bits: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their set bits, and if there is ``more`` to extend, which of them each key is)."""
    order = np.argsort(key)
    sorted_, n = key[order], np.bitwise_count(bits)[order].astype(np.int64)
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    first = np.flatnonzero(new)
    which = np.empty(len(key) if more else 0, np.int64)
    if more:
        which[order] = np.cumsum(new) - 1
    return sorted_[first], np.add.reduceat(n, first), which


def extend(index: _Index, depth: int, parts: Bloom | None = None, group: int = GROUP) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(the words of phrases by place, counts) of all phrases of ``depth`` words, a group of first words at a time.

    ``parts``: prefixes are only extended, and phrases only given, if their last two words are in it.
    """
    words = len(index.starts) - 1
    for a, b in index.groups(group):
        own = slice(int(index.starts[a]), int(index.starts[b]))
        names, counts = [np.arange(a, b)], np.empty(0, np.int64)
        prefix = np.repeat(np.arange(b - a), np.diff(index.starts[a : b + 1]))
        at, bits = index.at[own], index.bits[own]
        for step in range(2, depth + 1):
            prefix, word, at, bits = index.extended(prefix, at, bits)
            if parts is not None and len(prefix):
                frequent = parts.holds(Bloom.joined(index.hashes[names[-1][prefix]], index.hashes[word]))
                prefix, word, at, bits = prefix[frequent], word[frequent], at[frequent], bits[frequent]
            if not len(prefix):
                break
            keys, counts, prefix = _counted(prefix * words + word, bits, step < depth)
            names = [x[keys // words] for x in names] + [keys % words]
        if len(names) == depth:
            yield names, counts


def counted(blocks: DataFrame, depth: int, frequent: Bloom, parts: Bloom | None = None) -> DataFrame:
    """(lang, phrase, n): how often phrases of ``depth`` words (joined by spaces) occur in all blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast((frequent, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, parts = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: v[0] for c, v in batch.slice(k, 1).to_pydict().items()}
                index = _Index(row, frequent)
                for words, n in extend(index, depth, parts):
                    for i in range(0, len(n), 50_000):
                        held = [index.words.take(pa.array(w[i : i + 50_000])) for w in words]
                        phrase = pc.binary_join_element_wise(*held, pa.scalar(b" ", pa.binary())).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(phrase)), phrase, pa.array(n[i : i + 50_000])], ["lang", "phrase", "n"])

    found = blocks.select("lang", "words", "sizes", "at", "bits").mapInArrow(run, "lang string, phrase string, n long")
    # a block's phrases are distinct, so nothing is gained by adding before the shuffle
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _split(phrases: DataFrame, depth: int) -> DataFrame:
    return phrases.withColumns({f"w{k}": F.split_part("phrase", F.lit(" "), F.lit(k)) for k in range(1, depth + 1)}).drop("phrase")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = 10, cover: int = 50, top: int | None = None, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to 3 words that occur ``least`` times or more, best first in each language.

    A phrase is left out if one that holds it has at least ``cover`` hundredths of its count. ``top``: the first so many of each language.
    """
    blocks = bitmaps(docs, text_col, lang_col, block)
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "n")).alias("x")).select("lang", F.col("x.words").cast("string").alias("word"), F.col("x.n").alias("n"))
    words = cut(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    total = blocks.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    frequent = bloom(words, ("word",))
    pairs = cut(_split(counted(blocks, 2, frequent).where(F.col("n") >= least), 2).withColumnRenamed("n", "f2"))
    triples = cut(_split(counted(blocks, 3, frequent, bloom(pairs, ("w1", "w2"))).where(F.col("n") >= least), 3).withColumnRenamed("n", "a"))

    def word(k: int) -> DataFrame:
        return words.select("lang", F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}_"))

    def score(a: str, l_: str, r_: str) -> Column:
        # a <= l and a <= r, so the quotient is at most a million; the products have up to 38 digits
        product = _exact(F.col(a)) * _exact(F.col(a)) * F.lit(1_000_000).cast("decimal(7,0)")
        return F.call_function("div", product, _exact(F.col(l_)) * _exact(F.col(r_)))

    # a pair is covered by the triples that hold it
    held = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    over = held.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("over"))
    two = pairs.join(over, ["lang", "w1", "w2"], "left").where(F.coalesce(F.col("over") * 100 < F.col("f2") * cover, F.lit(True))).join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f2").alias("a"), F.col("f1_").alias("l"), F.col("f2_").alias("r"), score("f2", "f1_", "f2_").alias("score"))
    head = pairs.select("lang", "w1", "w2", F.col("f2").alias("head"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("tail"))
    three = triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(word(1), ["lang", "w1"]).join(word(3), ["lang", "w3"])
    early, late = score("a", "f1_", "tail"), score("a", "head", "f3_")
    first = early <= late
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(first, F.col("f1_")).otherwise(F.col("head")).alias("l"),
        F.when(first, F.col("tail")).otherwise(F.col("f3_")).alias("r"),
        F.least(early, late).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), top=2000)


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM w
), one AS (SELECT lang, w1, count(*) AS f FROM g WHERE w1 IS NOT NULL GROUP BY 1, 2
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY 1
), two AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10
), three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10
), cover AS (SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY 1, 2, 3
), c2 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.a, x.f AS l, y.f AS r, CAST(CAST(t.a AS HUGEINT) * t.a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN cover c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2 WHERE c.a IS NULL OR 100 * c.a < 50 * t.a
), c3 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.f AS l1, v.a AS r1, u.a AS l2, y.f AS r2,
    CAST(CAST(t.a AS HUGEINT) * t.a * 1000000 // (CAST(x.f AS HUGEINT) * v.a) AS BIGINT) AS s1, CAST(CAST(t.a AS HUGEINT) * t.a * 1000000 // (CAST(u.a AS HUGEINT) * y.f) AS BIGINT) AS s2
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
  JOIN two u ON u.lang = t.lang AND u.w1 = t.w1 AND u.w2 = t.w2 JOIN two v ON v.lang = t.lang AND v.w1 = t.w2 AND v.w2 = t.w3
), c AS (
  SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3
), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, total.n, k.score FROM k JOIN total ON total.lang = k.lang WHERE k.rank <= 2000
"""
