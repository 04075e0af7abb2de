"""Token ids in compressed binary files: context mixing and range coding in independent blocks.

A file holds whole documents' ids in order. Its head (checksummed) has the
documents' ids and lengths and how often each id occurs in the file; its body
is blocks of ``BLOCK`` ids. Every block starts from the same state, has its own
length and CRC-32, and can be read with the head alone.

Within a block three predictions share the range:

* order 2: the id that last followed the two ids before it, as sure as such
  guesses (by how often this one was right) have been in this block;
* order 1: likewise by the one id before it;
* order 0: what is left, by groups of ids of like frequency, whose shares
  start from the file's and adapt, and within a group by the file's counts.

A weight between orders 2 and 1 moves, id by id, to the one that was right when
the other was not. The range coder has 64-bit state and 32-bit words and one
step an id; the writer carries into words already written. A task codes all blocks
of a file side by side, one array operation a step for all blocks, with integer
arithmetic only, so that files read the same everywhere.

Files are rows of a table in the shared folder (``write_token_files``), so
Spark's committer makes them whole even where executors are lost or tasks run
twice; ``payload`` is the file.

Very long texts are single documents of a file, which is closed after it has
``FILE_IDS`` ids; a file may hold 65,536 different ids at most.

Defined cases: a null text is an empty text and has the end id alone; null ids
sort first; rows that repeat an id are kept, ordered by text; an empty table
gives no file; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import ensure_checkpoint_dir

MAGIC = b"CMT1"
BLOCK = 2048
FILE_IDS = 1 << 23  # a file is closed once it has so many ids
SLOT_BITS = 8
SLOTS = 1 << SLOT_BITS  # of a block's context tables
SHARE_BITS = 30  # of the share that a step leaves of a block's range
GROUPS, GROUP_BITS = 8, 14  # of ids by rank, and of their adaptive bounds
MEMBERS = 1 << 15  # ids of each further group, in files of more than 2**16 different ids
MOST = 60_000  # a guess has at most this share of 2**16
_SURE = (1536, 64_000)  # the weight of order 2 stays between these
_LEAST = 48  # of 2**GROUP_BITS, towards which a group that does not occur shrinks
_HASH, _HASH_SHIFT = tuple(map(np.uint32, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))), np.uint32(32 - SLOT_BITS)
_U32, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)
_LOW = np.uint64(1) << _U32
_ONE, _TWO, _SURENESS, _WHOLE = map(np.uint32, (1, 2, 3, 65536))
_NONE, _SHARES, _GROUP_BITS, _U16 = np.uint32(0), np.uint32(1 << SHARE_BITS), np.uint32(GROUP_BITS), np.uint64(16)
_MOST_INSIDE = np.uint32(65535)
_MOST, _SURER = np.int32(MOST), np.int32(_SURE[1] - _SURE[0])


class _Model:
    """What all blocks that are coded side by side have learned; blocks are the last axis of every array.

    Operations are on whole arrays of one type each: numpy casts slowly where types differ.
    """

    def __init__(self, lanes: int, first: np.ndarray):
        self.lanes, self.lane, self.lane32 = lanes, np.arange(lanes), np.arange(lanes, dtype=np.uint32)
        self.base = self.lane * SLOTS
        # by the hash of a context: (the id that last followed it + 1) * 4 + how sure it is, 0 to 3; order 1, order 2
        self.guess = [np.zeros(lanes * SLOTS, np.uint32) for _ in range(2)]
        # by sureness: how often the guess was right, of 2**16; no guess is never right
        self.right = [np.repeat(np.array([0, 12000, 28000, 45000], np.int32), lanes) for _ in range(2)]
        self.weight = np.full(lanes, 36000, np.int32)  # of order 2 against order 1, of 2**16
        # order 0: bounds of the groups of ids, starting from the file's
        self.bound = np.repeat(first[:, None], lanes, axis=1)
        groups = len(first) - 1
        self.flat_bound, self.inner = self.bound.reshape(-1), self.bound[1:groups]
        self.spread = np.int16((1 << GROUP_BITS) - groups * _LEAST)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.rising = (np.arange(1, groups, dtype=np.int16) * np.int16(_LEAST))[:, None]
        self.place = np.arange(1, groups, dtype=np.int16)[:, None]
        self.step = np.empty((groups - 1, lanes), np.int16)

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """(the share of order 2's guess, of both guesses), of 2**30; ``id1``, ``id2``: the guesses' ids + 1, 0 for none."""
        last = self.last
        self.at1, self.at2 = at1, at2 = (last * _HASH[0] >> _HASH_SHIFT).astype(np.int64), (last * _HASH[1] + self.before >> _HASH_SHIFT).astype(np.int64)
        at1 += self.base
        at2 += self.base
        one, two = self.guess[0].take(at1), self.guess[1].take(at2)
        self.id1, self.id2 = one >> _TWO, two >> _TWO
        self.sure1, self.sure2 = sure1, sure2 = one & _SURENESS, two & _SURENESS
        lanes = np.uint32(self.lanes)
        self.k1, self.k2 = (sure1 * lanes + self.lane32).astype(np.int64), (sure2 * lanes + self.lane32).astype(np.int64)
        self.r1, self.r2 = r1, r2 = self.right[0].take(self.k1), self.right[1].take(self.k2)
        # below 2**32, as no share is above MOST
        w = self.weight.view(np.uint32).copy()
        w *= np.minimum(sure2, _ONE)
        share2 = w * r2.view(np.uint32)
        share2 >>= _TWO
        both = np.subtract(_WHOLE, w, out=w)
        both *= r1.view(np.uint32)
        both >>= _TWO
        both += share2
        np.copyto(share2, both, where=self.id1 == self.id2)
        return share2, both

    def learn(self, new: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, group: np.ndarray) -> None:
        """``new``: the ids + 1; ``hit1``, ``hit2``: where the guesses were right; ``group`` of the ids, as int16."""
        one, two = hit1.astype(np.int32), hit2.astype(np.int32)
        for right, k, r, hit in ((self.right[1], self.k2, self.r2, two), (self.right[0], self.k1, self.r1, one)):
            move = hit * _MOST
            move -= r
            move >>= 5
            move += r
            right[k] = move
        # only one was right: the weight moves towards it
        move = two * _SURER
        move += _SURE[0]
        move -= self.weight
        move >>= 4
        move *= one ^ two
        self.weight += move
        entry = new << _TWO
        entry |= _ONE
        for guess, at, sure, hit in ((self.guess[0], self.at1, self.sure1, one), (self.guess[1], self.at2, self.sure2, two)):
            # a guess that was right is surer by one, up to 3
            more = np.minimum(sure, _TWO)
            more *= hit.view(np.uint32)
            more += entry
            guess[at] = more
        step = np.subtract(group, self.place, out=self.step)
        step >>= 15
        step &= self.spread  # in the groups below their bound
        step += self.rising
        step -= self.inner
        step >>= 5
        self.inner += step
        self.before = self.last * _HASH[2]
        self.last = new


class _OrderZero:
    """The file's id frequencies in groups by rank (1, 3, 12, 48, ... ids), each group's adding up to 2**16.

    The last group takes the rest, or where that is too many, its first ``MEMBERS``; further groups take as many each.
    """

    def __init__(self, n: np.ndarray):
        some = np.flatnonzero(n)
        order = some[np.argsort(-n[some], kind="stable")]
        rank = np.arange(len(order))
        group = np.searchsorted(4 ** np.arange(GROUPS - 1), rank, side="right")
        if len(order) > 1 << 16:
            rest = np.maximum(0, rank - 4 ** (GROUPS - 2))
            group += rest // MEMBERS
        groups = max(GROUPS, int(group[-1]) + 1) if len(order) else GROUPS
        sums = np.bincount(group, n[order], groups)
        self.group = np.zeros(len(n), np.int16)
        self.group[order] = group
        self.start, self.freq = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        self.symbol = np.zeros(groups << 16, np.int32)
        for g in range(groups):
            own = order[group == g]
            if len(own):
                f = 1 + (n[own] * ((1 << 16) - len(own)) // int(sums[g])).astype(np.int64)
                f[0] += (1 << 16) - int(f.sum())
                self.freq[own], self.start[own] = f, np.cumsum(f) - f
                self.symbol[g << 16 : (g + 1) << 16] = np.repeat(own, f)
        share = _LEAST + (sums * ((1 << GROUP_BITS) - groups * _LEAST) / max(1.0, float(sums.sum()))).astype(np.int64)
        share[0] += (1 << GROUP_BITS) - int(share.sum())
        self.first = np.concatenate(([0], np.cumsum(share))).astype(np.int16)


def code_blocks(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in each block) of ids, cut into blocks; ``n``: how often each id occurs."""
    size = min(BLOCK, len(ids))
    lanes = -(-len(ids) // size)
    padded = np.full(lanes * size, ids[-1], np.int32)  # the last block is filled up
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, size).T)
    zero = _OrderZero(n)
    m = _Model(lanes, zero.first)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    written = np.zeros(lanes, np.int64)
    lane_of, words, carry_lane, carry_at = [], [], [], []
    for x in steps:
        new = x.view(np.uint32) + _ONE
        x = x.astype(np.int64)
        share2, both = m.look()
        group = zero.group.take(x)
        at = group.astype(np.int64)
        at *= lanes
        at += m.lane
        lo = m.flat_bound.take(at)
        at += lanes
        wide = m.flat_bound.take(at)
        wide -= lo
        # 2**30 at most, so that 32 bits hold all of it
        step = _SHARES - both
        step >>= _GROUP_BITS
        start = step * lo.astype(np.uint32)
        step = step.astype(np.uint64)
        sub = step * wide.astype(np.uint64)
        sub >>= _U16
        start += both
        start = start.astype(np.uint64)
        start += sub * zero.start.take(x)
        part = sub
        part *= zero.freq.take(x)
        hit1, hit2 = m.id1 == new, m.id2 == new
        share1 = both - share2
        for hit, begin, share in ((hit1, share2, share1), (hit2, _NONE, share2)):
            hit = hit & (share > _NONE)
            np.copyto(start, begin, where=hit)
            np.copyto(part, share, where=hit)
        width >>= np.uint64(SHARE_BITS)
        add = start * width
        low += add
        width *= part
        over = np.flatnonzero(low < add)
        if len(over):
            carry_lane.append(over)
            carry_at.append(written[over])
        due = np.flatnonzero(width < _LOW)
        if len(due):
            head = low[due]
            lane_of.append(due)
            words.append(head >> _U32)
            low[due] = head << _U32
            width[due] <<= _U32
            written[due] += 1
        m.learn(new, hit1, hit2, group)
    for word in (low >> _U32, low & _MASK):
        lane_of.append(m.lane)
        words.append(word)
    lane = np.concatenate(lane_of)
    out = np.concatenate(words)[np.argsort(lane, kind="stable")]
    counts = np.bincount(lane, minlength=lanes)
    if carry_lane:  # a carry adds one to the word written before it
        at = (np.cumsum(counts) - counts)[np.concatenate(carry_lane)] + np.concatenate(carry_at) - 1
        np.add.at(out, at, np.uint64(1))
        while len(over := np.flatnonzero(out > _MASK)):
            out[over] &= _MASK
            np.add.at(out, over - 1, np.uint64(1))
    return out.astype("<u4"), counts


def decode_blocks(words: np.ndarray, counts: np.ndarray, total: int, n: np.ndarray) -> np.ndarray:
    lanes = len(counts)
    size = min(BLOCK, total)
    zero = _OrderZero(n)
    m = _Model(lanes, zero.first)
    words = np.append(words, np.zeros(4, words.dtype)).astype(np.uint64)
    at = np.cumsum(counts) - counts
    code, at = words[at] << _U32 | words[at + 1], at + 2
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.zeros((size, lanes), np.int32)
    for t in range(size):
        share2, both = m.look()
        width >>= np.uint64(SHARE_BITS)
        v = (code // width).astype(np.uint32)  # 2**30 or little more
        step = _SHARES - both
        step >>= _GROUP_BITS
        u = np.maximum(v, both)
        u -= both
        group = np.add.reduce((m.inner <= (u // step).astype(np.int16)).view(np.int8), axis=0, dtype=np.int8)
        k = group.astype(np.int64)
        symbol = k << 16
        k *= lanes
        k += m.lane
        lo = m.flat_bound.take(k)
        k += lanes
        wide = m.flat_bound.take(k)
        wide -= lo
        sub = step.astype(np.uint64)
        sub *= wide.astype(np.uint64)
        sub >>= _U16
        lo = step * lo.astype(np.uint32)
        u -= lo
        inside = u // sub.astype(np.uint32)
        symbol += np.minimum(inside, _MOST_INSIDE)
        x = zero.symbol.take(symbol)
        lo += both
        start = lo.astype(np.uint64)
        start += sub * zero.start.take(x)
        part = sub
        part *= zero.freq.take(x)
        new = x.view(np.uint32)
        new += _ONE
        of2 = v < share2
        known = v < both
        share1 = both - share2
        for hit, id_, begin, share in ((known, m.id1, share2, share1), (of2, m.id2, _NONE, share2)):
            np.copyto(new, id_, where=hit)
            np.copyto(start, begin, where=hit)
            np.copyto(part, share, where=hit)
        x = (new - _ONE).view(np.int32)
        code -= start * width
        width *= part
        due = np.flatnonzero(width < _LOW)
        if len(due):
            place = at[due]
            code[due] = code[due] << _U32 | words.take(place, mode="clip")
            width[due] <<= _U32
            at[due] = place + 1
        out[t] = x
        m.learn(new, m.id1 == new, m.id2 == new, zero.group.take(x))
    return out.T.reshape(-1)[:total]


def _ragged(x: np.ndarray) -> bytes:
    packed = zlib.compress(x.tobytes(), 6)
    return struct.pack("<q", len(packed)) + packed


def pack_file(doc_ids: list[int | None], arrays: list[np.ndarray], size: int) -> bytes:
    """A file of these documents' ids; ``size``: ids are below it."""
    ids = np.concatenate([np.empty(0, np.int32), *arrays])
    lengths = np.array([len(a) for a in arrays], "<i8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    freq = np.bincount(ids, minlength=size).astype(np.int64)
    words, counts = code_blocks(ids, freq) if len(ids) else (np.empty(0, "<u4"), np.empty(0, np.int64))
    ends = np.cumsum(counts)
    body = words.astype("<u4").tobytes()
    sums = np.array([zlib.crc32(body[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], "<u4")
    head = struct.pack("<qq", len(ids), size) + b"".join(map(_ragged, (names, known, lengths, freq.astype("<i4"), counts.astype("<i4"), sums)))
    return MAGIC + struct.pack("<qI", len(head), zlib.crc32(head)) + head + body


def unpack_file(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents' names and ids of a file; raises if any checksum is off."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    size, crc = struct.unpack_from("<qI", payload, 4)
    head, body = payload[16 : 16 + size], payload[16 + size :]
    if zlib.crc32(head) != crc:
        raise ValueError("the head's checksum is off")
    n, _ = struct.unpack_from("<qq", head)
    at, parts = 16, []
    for kind in ("<i8", np.uint8, "<i8", "<i4", "<i4", "<u4"):
        (k,) = struct.unpack_from("<q", head, at)
        parts.append(np.frombuffer(zlib.decompress(head[at + 8 : at + 8 + k]), kind))
        at += 8 + k
    names, known, lengths, freq, counts, sums = parts
    ends = np.cumsum(counts, dtype=np.int64)
    for i, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if zlib.crc32(body[4 * (e - c) : 4 * e]) != sums[i]:
            raise ValueError(f"block {i}: its checksum is off")
    ids = decode_blocks(np.frombuffer(body, "<u4"), counts.astype(np.int64), n, freq.astype(np.int64)) if n else np.empty(0, np.int32)
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], np.split(ids, np.cumsum(lengths)[:-1])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes token files in ascending order of ``id_col``: rows (part, file, n_ids, payload)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text_col)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id", tie, "text")
        .select("id", "text", F.spark_partition_id().alias("part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder.at(tokenizer)
        size = len(encoder.v.pieces)
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = file = part = 0

        def close() -> pa.RecordBatch:
            row = [[part], [file], [held], [pack_file(names, arrays, size)]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "file", "n_ids", "payload"])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                piece = batch.slice(i, 500)
                part = piece.column(2)[0].as_py()
                for name, ids in zip(piece.column(0).to_pylist(), encoder.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    names.append(name)
                    arrays.append(ids if end_id is None else np.append(ids, np.int32(end_id)))
                    held += len(arrays[-1])
                    if held >= FILE_IDS:
                        yield close()
                        names, arrays, held, file = [], [], 0, file + 1
        if names:
            yield close()

    ordered.mapInArrow(run, "part int, file int, n_ids long, payload binary").write.mode("overwrite").parquet(folder)


def read_token_files(spark, folder: str, digest, schema: str) -> DataFrame:
    """``digest(names, id arrays)`` (a dict of columns) of each file, and ``start``: the ids of all documents before it."""
    files = spark.read.parquet(folder)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: few, and without their payloads
    starts = files.select("part", "file", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, arrays = unpack_file(batch.column(2)[r].as_py())
                sizes = np.array([len(a) for a in arrays], np.int64)
                held = {"part": [batch.column(0)[r].as_py()] * len(names), "file": [batch.column(1)[r].as_py()] * len(names)}
                held |= {"inside": np.cumsum(sizes) - sizes} | digest(names, arrays)
                yield pa.RecordBatch.from_pydict(held, pa.schema([*fields, *digest_fields]))

    fields = [pa.field("part", pa.int32()), pa.field("file", pa.int32()), pa.field("inside", pa.int64())]
    digest_fields = [pa.field(name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    rows = files.select("part", "file", "payload").mapInArrow(run, f"part int, file int, inside long, {schema}")
    return rows.join(F.broadcast(starts), ["part", "file"]).withColumn("start", F.col("base") + F.col("inside")).drop("part", "file", "inside", "base")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)

    def digest(names, arrays) -> dict:
        return {"doc_id": names, "n_tokens": [len(a) for a in arrays], "ids_crc32": [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]}

    return read_token_files(spark, folder, digest, "doc_id long, n_tokens long, ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")
