"""Byte-level BPE encoding and decoding through a memory-mapped transducer of frequent words.

* Texts are cut into words by classes of code points, a whole batch at a time
  (numpy over the batch's code points); a batch's words are made distinct before
  anything is looked up.
* The corpus's most frequent words (counted by a Spark aggregation over all
  texts; their number is a parameter) are compiled into a minimal acyclic
  automaton: common prefixes and suffixes share states. Each transition carries
  a number, the sum along a word's path is the word's index, and the index
  gives its ids, so the automaton is a transducer from words to ids. Executors
  map it from a file into memory and walk all words of a batch at once.
* Words that the transducer does not hold are merged exactly by the
  vocabulary's ranks, many words side by side, and remembered up to a bound.

A text with a code point that this Python's Unicode tables do not assign goes to
the tokenizers library itself, as the library's tables may be newer; results
equal the library's everywhere. Special tokens in a text become their ids, as the library does it.

Defined cases: a null text is an empty text and has no ids; null ids and
repeated rows are kept; an empty table gives an empty result; very long texts
are worked on whole, by themselves; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Frequent words that the transducer holds; at some 40 bytes each it is small enough to broadcast.
LEXICON = 32_768
REMEMBERED = 400_000
# fixed values: the code points of white space
_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by a rule: bytes
    that print stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    """Pieces, merge ranks and special tokens of a byte-level BPE file."""

    _held: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in symbols.items():
            self.of_byte[b] = vocab[c]
        self.rank: dict[int, int] = {}  # of a pair of ids, as one number
        self.made: list[int] = []  # the id that each rank makes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        # the same by arrays: an open hash of pairs, and for pairs of bytes a table
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        self.hash_bits = max(8, int(len(pairs) * 4).bit_length())
        self.hash_keys = np.full(1 << self.hash_bits, -1, np.int64)
        self.hash_ranks = np.full(1 << self.hash_bits, len(self.made), np.int32)
        todo, slot = np.arange(len(pairs)), self._slots(pairs)
        while len(todo):
            free = self.hash_keys[slot] < 0
            self.hash_keys[slot[free]] = pairs[todo[free]]  # of several at one place one stays
            held = self.hash_keys[slot] == pairs[todo]
            self.hash_ranks[slot[held]] = todo[held]
            todo, slot = todo[~held], slot[~held] + 1 & len(self.hash_keys) - 1
        self.made_ids = np.array(self.made, np.int32)
        self.byte_ids = np.array(self.of_byte, np.int32)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self.ranks_of(self.byte_ids[left], self.byte_ids[right])
        # of every code point: 0 sign, 1 letter, 2 number, 3 space, 9 not assigned
        kinds = {"L": 1, "N": 2}
        names = map(unicodedata.category, map(chr, range(0x110000)))
        self.classes = np.fromiter((9 if c == "Cn" else kinds.get(c[0], 0) for c in names), np.uint8, 0x110000)
        self.classes[list(_SPACES)] = 3
        self._library = None

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word by the merge ranks: the lowest rank first, leftmost first."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 64:
            return self._merged_long(ids)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.rank.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(queue, (m, i, ids[i], ids[j], self.made[m]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i] if live[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.hash_bits)).view(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, the number of ranks where there is none."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slots(key)
        held = self.hash_keys.take(slot)
        out = self.hash_ranks.take(slot)
        todo = np.flatnonzero(held != key)
        while len(todo):
            out[todo] = len(self.made)
            todo = todo[held[todo] >= 0]  # an empty place ends the search
            slot[todo] = slot[todo] + 1 & len(self.hash_keys) - 1
            held[todo], out[todo] = self.hash_keys[slot[todo]], self.hash_ranks[slot[todo]]
            todo = todo[held[todo] != key[todo]]
        return out

    def merged_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words in order, how many each has); words of about equal length merge side by side, each its lowest, leftmost pair at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for least, most in ((1, 4), (5, 8), (9, 12), (13, 20), (21, 40)):
            for at in np.array_split(which := np.flatnonzero((size >= least) & (size <= most)), -(-len(which) // 65_536) or 1):
                if len(at):
                    self._merged_alike(data, begin[at], size[at], at, counts, found)
        for i in np.flatnonzero(size > 40).tolist():
            ids = np.array(self.merged(words[i]), np.int32)
            counts[i] = len(ids)
            found.append((np.array([i]), ids[None]))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for at, ids in found:
            k = np.arange(ids.shape[1])
            held = k < counts[at][:, None]
            out[((ends - counts)[at][:, None] + k)[held]] = ids[held]
        return out, counts

    def _merged_alike(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, counts: np.ndarray, found: list) -> None:
        width = int(size.max())
        none = np.int32(len(self.made))
        column = np.arange(width)
        raw = data[np.minimum(begin[:, None] + column, len(data) - 1)].astype(np.int64)
        ids = self.byte_ids[raw]
        ranks = np.full((len(at), width), none, np.int32)
        ranks[:, :-1] = np.where(column[1:] < size[:, None], self.byte_ranks[raw[:, :-1] << 8 | raw[:, 1:]], none)
        while True:
            row = np.arange(len(ids))
            first = ranks.argmin(axis=1)
            low = ranks[row, first]
            live = low < none
            if not live.all():
                over = ~live
                counts[at[over]] = size[over]
                found.append((at[over], ids[over]))
                ids, ranks, size, at, first, low, row = ids[live], ranks[live], size[live], at[live], first[live], low[live], row[: int(live.sum())]
            if not len(ids):
                return
            # what follows the pair moves up; every word loses one place
            keep = np.ones(ids.shape, bool)
            keep[row, first + 1] = False
            keep, width = keep.reshape(-1), ids.shape[1] - 1
            ids, ranks = ids.reshape(-1)[keep].reshape(-1, width), ranks.reshape(-1)[keep].reshape(-1, width)
            size = size - 1
            ids[row, first] = self.made_ids[low]
            inner = np.flatnonzero(first < size - 1)
            f = first[inner]
            ranks[row, first] = none
            ranks[inner, f] = self.ranks_of(ids[inner, f], ids[inner, f + 1])
            inner = np.flatnonzero(first > 0)
            f = first[inner]
            ranks[inner, f - 1] = self.ranks_of(ids[inner, f - 1], ids[inner, f])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def word_starts(points: np.ndarray, c: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of words among the code points, of classes ``c``, of joined texts.

    A word is a run of letters, of numbers or of signs with one blank before
    it, a contraction, or a run of spaces that leaves its last one to what follows.
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = c[1:] != c[:-1]
    change |= first[:n]
    space = c == 3
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 32
    blank_before &= ~first[:n]
    start = np.where(space, change, change & ~blank_before)
    # the last space of a run before other text
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:]
    follows &= ~first[1:]
    start |= space & follows
    # contractions: an apostrophe that is a word by itself takes the letters it knows
    for i in np.flatnonzero((points == 39) & start):
        j = i + 1
        if j >= n or first[j]:
            continue
        tail = "".join(map(chr, points[j : j + 2]))
        if len(tail) == 2 and not first[j + 1] and tail in ("re", "ve", "ll"):
            end = j + 2
        elif tail[:1] in ("s", "t", "m", "d"):
            end = j + 1
        else:
            continue
        start[j:end] = False
        if end < n:
            start[end] |= not (space[end] and not change[end])
    return np.flatnonzero(start)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them each, in order."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Lexicon:
    """A minimal acyclic transducer from words to ids, in one block of bytes.

    States are numbered; (state * 256 + byte) keys are sorted, each with its
    target and the number of words that the transitions before it skip.
    """

    FIELDS = (("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("offset", np.int64), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], ids_of) -> Lexicon:
        """Incremental minimisation over the sorted words (Daciuk et al., 2000)."""
        words = sorted(set(words))
        trans: list[list[tuple[int, int]]] = [[]]
        final = [False]
        register: dict[tuple, int] = {}
        free: list[int] = []
        path = [0]
        before = b""

        def settle(down_to: int) -> None:
            while len(path) > down_to + 1:
                s = path.pop()
                key = (final[s], tuple(trans[s]))
                same = register.setdefault(key, s)
                if same != s:
                    byte, _ = trans[path[-1]][-1]
                    trans[path[-1]][-1] = (byte, same)
                    trans[s] = []
                    free.append(s)

        for word in words:
            common = 0
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
            settle(common)
            for byte in word[common:]:
                if free:
                    s = free.pop()
                    final[s] = False
                else:
                    s = len(trans)
                    trans.append([])
                    final.append(False)
                trans[path[-1]].append((byte, s))
                path.append(s)
            final[path[-1]] = True
            before = word
        settle(0)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for _, t in trans[s] if t not in count]
            if todo:
                stack += todo
            else:
                count[s] = int(final[s]) + sum(count[t] for _, t in trans[s])
                stack.pop()
        keys, target, skip = [], [], []
        for s in sorted(count):
            passed = int(final[s])
            for byte, t in trans[s]:
                keys.append(s * 256 + byte)
                target.append(t)
                skip.append(passed)
                passed += count[t]
        lists = [ids_of(w) for w in words]
        return cls(
            {
                "keys": np.array(keys, np.int64),
                "target": np.array(target, np.int32),
                "skip": np.array(skip, np.int32),
                "final": np.array(final, np.uint8),
                "offset": np.cumsum([0, *map(len, lists)]).astype(np.int64),
                "ids": np.array([i for x in lists for i in x], np.int32),
            }
        )

    def pack(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        head = np.array([len(a) for a in arrays], np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    _mapped: dict[str, Lexicon] = {}

    @classmethod
    def mapped(cls, packed: bytes) -> Lexicon:
        """The transducer in a file of this process's temporary folder, mapped into memory."""
        name = hashlib.sha256(packed).hexdigest()
        if name not in cls._mapped:
            with tempfile.NamedTemporaryFile(prefix="lexicon-", delete=False) as f:
                f.write(packed)
            whole = np.memmap(f.name, np.uint8, "r")
            os.unlink(f.name)  # the mapping stays until the process ends
            sizes = np.frombuffer(whole[: 8 * len(cls.FIELDS)], np.int64)
            at, arrays = 8 * len(cls.FIELDS), {}
            for (field, kind), size in zip(cls.FIELDS, sizes, strict=True):
                n = int(size) * np.dtype(kind).itemsize
                arrays[field] = whole[at : at + n].view(kind)
                at += n + -n % 8
            cls._mapped[name] = cls(arrays)
        return cls._mapped[name]

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for words it does not hold; all words walk together."""
        index = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        index[size == 0] = -1
        step = 0
        while len(live) and len(self.keys):
            key = state[live] * 256 + flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            index[live[~ok]] = -1
            live, at = live[ok], at[ok]
            index[live] += self.skip[at]
            state[live] = self.target[at]
            step += 1
            over = size[live] == step
            done = live[over]
            index[done[self.final[state[done]] == 0]] = -1
            live = live[~over]
        if not len(self.keys):
            index[:] = -1
        return index


class Encoder:
    """Encodes batches of texts."""

    _held: dict[str, Encoder] = {}

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        # words met so far: their places, and by place where their ids begin, how many they are and in how many batches the word was since words were forgotten
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.size, self.met = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The encoder of this process: tasks that run after each other find the words of those before."""
        if path not in cls._held:
            cls._held[path] = cls(Vocabulary.at(path))
        return cls._held[path]

    def _forget(self) -> None:
        """Keeps the words that were met again, half of :data:`REMEMBERED` at most."""
        least = 2
        while np.count_nonzero(self.met >= least) > REMEMBERED // 2:
            least *= 2
        keep = self.met >= least
        words = list(itertools.compress(self.known, keep.tolist()))  # places are in the order of the words
        size = self.size[keep]
        self.flat = self.flat.take(_spans(self.begin[keep], size))
        self.known, self.size, self.begin, self.met = dict(zip(words, range(len(words)), strict=True)), size, np.cumsum(size) - size, np.zeros(len(words), np.int32)

    def split(self, texts: list[str]) -> tuple[pa.DictionaryArray | None, np.ndarray, np.ndarray]:
        """The joined texts' words as a dictionary array, the words in each text, and which texts go to the library."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        odd = np.zeros(len(texts), bool)
        classes = self.v.classes.take(points)
        if len(points) and classes.max() == 9:
            odd[np.searchsorted(starts + sizes, np.flatnonzero(classes == 9), side="right")] = True
            return (*self.split(["" if o else t for t, o in zip(texts, odd, strict=True)])[:2], odd)
        if not len(points):
            return None, np.zeros(len(texts), np.int64), odd
        words = word_starts(points, classes, starts[sizes > 0])
        data = joined.encode("utf-8")
        # the bytes that begin a code point
        byte_at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)
        offsets = np.append(byte_at.take(words), len(data)).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        per_text = np.diff(np.searchsorted(words, np.append(starts, len(points))))
        return array.dictionary_encode(), per_text, odd

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each of these different words; words not met before are looked up in the transducer, the others merged."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        place = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        unmet = place < 0
        new = list(itertools.compress(words, unmet.tolist()))
        if new:
            place[unmet] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            at = self.lexicon.lookup(new) if self.lexicon is not None else np.full(len(new), -1)
            other = np.flatnonzero(at < 0)
            ids, counts = self.v.merged_many([new[i] for i in other.tolist()])
            size, begin = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            size[other], begin[other] = counts, np.cumsum(counts) - counts + len(self.flat)
            parts = [self.flat, ids]
            held = np.flatnonzero(at >= 0)
            if len(held):
                size[held] = self.lexicon.offset[at[held] + 1] - self.lexicon.offset[at[held]]
                begin[held] = np.cumsum(size[held]) - size[held] + len(self.flat) + len(ids)
                parts.append(self.lexicon.ids[_spans(self.lexicon.offset[at[held]], size[held])])
            self.flat, self.begin, self.size = np.concatenate(parts), np.append(self.begin, begin), np.append(self.size, size)
            self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.met[place] += 1
        return place

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens, up to some MB of text."""
        coded, per_text, odd = self.split(texts)
        empty = np.empty(0, np.int32)
        if coded is None:
            out = [empty] * len(texts)
        else:
            at = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices.to_numpy(zero_copy_only=False))
            counts = self.size.take(at)
            ids = self.flat.take(_spans(self.begin.take(at), counts))
            cuts = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per_text)))]
            out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.v.library().encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out

    def encode(self, texts: list[str], piece: int = 2_000_000) -> list[np.ndarray]:
        """The ids of each text, worked on in groups of about ``piece`` characters."""
        parts: list[str] = []
        plan: list[list[int]] = []  # of each text: its parts, or -1 - id for a special token
        for text in texts:
            if any(s in text for s in self.v.special):
                plan.append(own := [])
                for bit in self._around_special(text):
                    if isinstance(bit, int):
                        own.append(-1 - bit)
                    elif bit:
                        own.append(len(parts))
                        parts.append(bit)
            else:
                plan.append([len(parts)])
                parts.append(text)
        done: list[np.ndarray] = []
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= piece):
                size += len(parts[j])
                j += 1
            done += self._plain(parts[i:j])
            i = j
        return [
            done[p[0]] if len(p) == 1 and p[0] >= 0 else np.concatenate([np.empty(0, np.int32), *[done[x] if x >= 0 else np.array([-1 - x], np.int32) for x in p]])
            for p in plan
        ]

    def _around_special(self, text: str) -> Iterator[str | int]:
        while text:
            found = [(i, -len(s), s) for s in self.v.special if (i := text.find(s)) >= 0]
            if not found:
                break
            i, _, s = min(found)
            yield text[:i]
            yield self.v.special[s]
            text = text[i + len(s) :]
        yield text


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON, text_col: str = "text") -> list[bytes]:
    """The ``size`` most frequent words, ties to the smaller, of all texts but those that go to the library.

    Tasks count before the shuffle, up to a bound of words at a time. No more
    than ``size`` words come to the driver, from all tasks together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.at(path))
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i in range(0, len(texts), 500):
                coded, _, _ = encoder.split(texts[i : i + 500])
                if coded is None:
                    continue
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                for w, k in zip(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), n.tolist(), strict=True):
                    counts[w] = counts.get(w, 0) + k
                if len(counts) > REMEMBERED:
                    yield flush()
        yield flush()

    counted = cut(docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # a histogram over steps of the counts' logarithms, some hundred rows at any size, says from which step on words can stay
    step = F.floor(F.log2("n") * 16).cast("int")
    words_of = sorted(((r.step, r.k) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held = 0
    chosen = counted.limit(0)
    for at, k in words_of:
        if held + k > size:
            # the step that does not fit as a whole gives its most frequent words, ties to the smaller word
            chosen = counted.where(step > at).unionAll(counted.where(step == at).orderBy(F.desc("n"), "word").limit(size - held))
            break
        held += k
        chosen = counted.where(step >= at)
    return [bytes(r.word) for r in chosen.select("word").collect()]


def compiled_lexicon(docs: DataFrame, path: str, size: int = LEXICON, text_col: str = "text") -> bytes:
    vocabulary = Vocabulary.at(path)
    return Lexicon.compile(frequent_words(docs, path, size, text_col), vocabulary.merged).pack()


def with_ids(docs: DataFrame, path: str, digest, schema: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """``digest(doc_ids, id_arrays, vocabulary)`` as an Arrow batch, for batches of encoded documents."""
    packed = docs.sparkSession.sparkContext.broadcast(compiled_lexicon(docs, path, text_col=text_col) if lexicon is None else lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.at(path), Lexicon.mapped(packed.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield digest(part.column(0), ids, encoder.v)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document."""

    def digest(doc_ids, ids, vocabulary) -> pa.RecordBatch:
        sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        return pa.record_batch([doc_ids, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], [id_col, "ids"])

    return with_ids(docs, path, digest, f"{id_col} long, ids array<int>", id_col, text_col)


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return ids.select(id_col, "ids").mapInArrow(run, f"{id_col} long, text string")


def op3_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def digest(doc_ids, ids, vocabulary) -> pa.RecordBatch:
        sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        back = [hashlib.sha256(vocabulary.decode(x.tolist()).encode()).hexdigest() for x in ids]
        return pa.record_batch([doc_ids, pa.array(map(len, ids), pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
