"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is cut where no piece of the vocabulary can lie across: before a run of spaces that follows
something else, and around line ends and tabs if no piece has them. The distinct words of a batch are
sorted by length and words of equal length advance together: for each piece length, hashes of the
substrings probe the sorted hashes of the pieces, and at each place a vectorised maximum over the pieces
that end there stores a backpointer. Long words are cut where no piece lies across and advance in parts.

A unigram model maximises the sum of scores. A model of merges (BPE) keeps those scores as the order of
its merges, so their sum says nothing; there a step is admissible if merging the last piece before it
and the new one from their characters gives these two pieces again, and the maximum picks the longest
admissible one. Prefixes of a merged word split as the word does up to their last piece, so the walk
back along the pointers is the merge result itself.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf

from .words import bound_batches, mix, powers

SPACE = "▁"
#: Bytes of words whose pieces a task remembers between batches.
REMEMBERED = 24 << 20
#: Characters that advance together.
CHARACTERS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0xC6A4A7935BD1E995)
_INVERSE = np.uint64(pow(0xC6A4A7935BD1E995, -1, 1 << 64))


def _fields(data: bytes):
    """The (number, value) pairs of a protocol-buffers message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield number, data[at : at + size]
        at += size


def _merge(word: str, rank: dict[str, int], down_to: int = 1) -> list[str]:
    """Merges the best pair of neighbours, the first of equals, until none is a piece."""
    parts: list = list(word)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(rank[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
    heapq.heapify(heap)
    alive = len(parts)
    while heap and alive > down_to:
        _, i, p = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != p:
            continue
        parts[i], parts[j] = p, None
        alive -= 1
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
            if (q := p + parts[right[i]]) in rank:
                heapq.heappush(heap, (rank[q], i, q))
        if left[i] >= 0 and (q := parts[left[i]] + p) in rank:
            heapq.heappush(heap, (rank[q], left[i], q))
    return [p for p in parts if p is not None]


class Probe:
    """Sorted 64-bit keys with values; the top bits of a key lead to the first place that may hold it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two keys share a hash")
        bits = max(1, min(22, int(len(keys)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.some = counts > 0
        self.most = int(counts.max(initial=0))
        # a search may look past the end: the last key stands there again
        self.keys, self.values = np.append(self.keys, self.keys[-1:].repeat(self.most)), np.append(self.values, self.values[-1:].repeat(self.most))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of keys that are held, and their values."""
        top = (h >> self.shift).astype(np.int64)
        rows = np.flatnonzero(self.some[top])
        top, h = top[rows], h[rows]
        start = self.first[top]
        at = np.full(len(rows), -1)
        for i in range(self.most):
            at = np.where(self.keys[start + i] == h, start + i, at)
        hit = at >= 0
        return rows[hit], self.values[at[hit]]


@dataclass
class Model:
    """Tables of a model file, as arrays."""

    kind: int
    pieces: list[str]
    types: np.ndarray
    scores: np.ndarray
    dummy_prefix: bool
    collapse_spaces: bool
    byte_fallback: bool
    unknown: int
    known: Probe = field(default=None)  # hashes of normal pieces to their identifiers
    longest: int = 1
    order: np.ndarray = field(default=None)  # BPE: place in the order of merges, characters first
    halves: np.ndarray = field(default=None)  # BPE: the two pieces that make each, or itself twice
    pairs: Probe = field(default=None)  # BPE: hashes of those two to the order of what they make
    bytes_at: np.ndarray = field(default=None)

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, types, scores = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append(p.get(1, b"").decode())
                scores.append(np.frombuffer(p[2], np.float32)[0] if 2 in p else 0.0)
                types.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or trainer.get(24) or not normal.get(5, 1):
            raise ValueError("models with a normalisation table, space as suffix or unescaped spaces are not supported")
        if USER in types:
            raise ValueError("models with user-defined pieces are not supported")
        m = cls(trainer.get(3, UNIGRAM), pieces, np.array(types), np.array(scores, np.float32), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(trainer.get(35, 0)), types.index(UNKNOWN))
        if m.kind not in (UNIGRAM, BPE) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("only unigram and BPE models whose pieces hold spaces at their start are supported")
        return m._index()

    def _index(self) -> Model:
        usable = np.flatnonzero(self.types == NORMAL)
        hashes = np.array([hash_piece(self.pieces[i]) for i in usable], np.uint64)
        self.known = Probe(hashes, usable)
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        n = len(self.pieces)
        self.number = {self.pieces[i]: int(i) for i in usable}
        apart = "".join(c for c in "\t\n\r\x0b\x0c" if not any(c in self.pieces[i] for i in usable))
        self.parts = re.compile(f"[{apart}]| +[^ {apart}]*|[^ {apart}]+" if apart else " +[^ ]*|[^ ]+")
        table = [p.replace(SPACE, " ").encode() if t == NORMAL else bytes([int(p[1:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        self.byte_counts, self.piece_bytes = np.fromiter(map(len, table), np.int64, len(table)), np.frombuffer(b"".join(table), np.uint8)
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.bytes_at = np.full(256, self.unknown)
        for i in np.flatnonzero(self.types == BYTE):
            self.bytes_at[int(self.pieces[i][1:-1], 16)] = i
        if self.kind == BPE:
            self.rank = {self.pieces[i]: -float(self.scores[i]) for i in usable}
            number = self.number
            self.order = np.empty(n + 1, np.int64)
            self.order[sorted(range(n), key=lambda i: (len(self.pieces[i]) > 1, -self.scores[i], i))] = np.arange(n)
            self.order[n] = -1
            self.halves = np.repeat(np.arange(n + 1)[:, None], 2, 1)
            for i in usable:
                if len(self.pieces[i]) > 1:
                    two = _merge(self.pieces[i], self.rank, 2)
                    if len(two) == 2 and all(p in number for p in two):
                        self.halves[i] = [number[p] for p in two]
            made = np.flatnonzero(self.halves[:, 0] != np.arange(n + 1))
            self.pairs = Probe(self._pair_key(self.halves[made, 0], self.halves[made, 1]), self.order[made])
        return self

    def _pair_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * (len(self.pieces) + 1) + b).astype(np.uint64) * _BASE

    def pair_order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the order of merges of what a and b make, or a number beyond all."""
        out = np.full(len(a), np.iinfo(np.int64).max)
        rows, order = self.pairs.find(self._pair_key(a, b))
        out[rows] = order
        return out

    def admissible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of piece a and of piece b side by side gives a and b again.

        Undoes the later of the two pieces' merges step by step; a pair across the border that makes a
        piece before that merge would have been taken first.
        """
        ok = np.ones(len(a), bool)
        unknown = len(self.pieces)
        live = np.flatnonzero((a != unknown) & (b != unknown))
        x, y = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            taken = self.pair_order(x, y) < limit
            ok[live[taken]] = False
            px, py = self.order[x], self.order[y]
            can_x, can_y = self.halves[x, 0] != x, self.halves[y, 0] != y
            # the left piece is split if its merge came later, or if only it can be
            left = can_x & (~can_y | (px > py))
            go = ~taken & (can_x | can_y)
            limit = np.where(left, px, py + 1)
            x, y = np.where(left, self.halves[x, 1], x), np.where(left, y, self.halves[y, 0])
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return ok

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words and the number of each; piece ``len(pieces)`` is a character outside the vocabulary."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        by, parts, counts = np.argsort(lengths, kind="stable"), [], []
        sums, lo = np.cumsum(lengths[by]), 0
        while lo < len(by):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + CHARACTERS, "right")))
            chars = np.frombuffer("".join([words[i] for i in by[lo:hi]]).encode("utf-32-le", "surrogatepass"), np.uint32)
            flat, count = self._viterbi(chars.astype(np.uint64), lengths[by[lo:hi]])
            parts.append(flat)
            counts.append(count)
            lo = hi
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, count = np.concatenate(parts), np.concatenate(counts)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return _gather(flat, np.cumsum(count) - count, count, place), count[place]

    def _matches(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces lie in words that end at ``ends`` (for each character): begin, size, piece, by size."""
        sums, inverse = hash_prefixes(chars)
        begin, size, piece = [], [], []
        for n in range(1, min(self.longest, len(chars)) + 1):
            inside = np.flatnonzero(ends[: len(chars) - n + 1] >= np.arange(n, len(chars) + 1))
            rows, found = self.known.find(_sized((sums[inside + n] - sums[inside]) * inverse[inside], n))
            begin.append(inside[rows])
            size.append(np.full(len(rows), n))
            piece.append(found)
        return np.concatenate(begin), np.concatenate(size), np.concatenate(piece)

    def _viterbi(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words one after another, the shortest first. Those of equal length advance together, and all
        lengths in step; words are cut where no piece lies across, so a long one advances in its parts."""
        unknown, n = len(self.pieces), len(chars)
        ends = np.repeat(np.cumsum(lengths), lengths)
        begin, size, piece = self._matches(chars, ends)
        across = np.zeros(n + 2, np.int64)
        np.add.at(across, begin + 1, 1)
        np.add.at(across, begin + size, -1)
        first = np.cumsum(across[:n]) == 0
        starts = np.flatnonzero(first)
        origin = np.repeat(starts, np.diff(np.append(starts, n)))
        # by the place in its part where a piece ends, then by size
        level = begin + size - origin[begin]
        by = np.argsort(level, kind="stable")
        begin, size, piece = begin[by], size[by], piece[by]
        most = int(level.max(initial=0))
        cuts = np.searchsorted(level[by], np.arange(1, most + 2))
        last, back = np.full(n + 1, unknown), np.arange(n)
        if self.kind == UNIGRAM:
            worst = float(self.scores[self.types == NORMAL].min(initial=0)) - 10
            best = np.zeros(n + 1)  # the last stands for what precedes a part
            sizes = np.diff(np.append(starts, n))
            longer = np.argsort(sizes, kind="stable")
            from_ = np.searchsorted(sizes[longer], np.arange(1, int(sizes.max(initial=0)) + 1))
            for i, skip in enumerate(from_):
                here = starts[longer[skip:]] + i
                best[here] = (best[here - 1] if i else 0) + worst
                lo, hi = (cuts[i], cuts[i + 1]) if i < most else (0, 0)
                b, s, p = begin[lo:hi], size[lo:hi], piece[lo:hi]
                value = np.where(first[b], 0, best[b - 1]) + self.scores[p]
                at = b + s - 1
                better = np.flatnonzero(value > best[at])
                better = better[np.lexsort((-s[better], value[better]))]  # of the best the shortest stands last
                at, b, p = at[better], b[better], p[better]
                best[at], last[at], back[at] = value[better], p, b
        else:
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                b, s, p = begin[lo:hi], size[lo:hi], piece[lo:hi]
                inner = np.flatnonzero(~first[b])
                if len(inner):
                    ok = np.ones(len(b), bool)
                    ok[inner] = self.admissible(last[b[inner] - 1], p[inner])
                    b, s, p = b[ok], s[ok], p[ok]
                at = b + s - 1
                last[at], back[at] = p, b  # the longest stands last
        word = np.repeat(np.arange(len(lengths)), lengths)
        steps, where = [], []
        at = np.append(starts[1:], n) - 1 if n else np.zeros(0, np.int64)
        while len(at):
            where.append(at)
            steps.append(last[at])
            at = back[at]
            at = at[~first[at]] - 1
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        flat, where = np.concatenate(steps), np.concatenate(where)
        return flat[np.argsort(where)], np.bincount(word[where], minlength=len(lengths))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all words and the number of each; characters outside the vocabulary become
        bytes or the unknown piece."""
        unknown = len(self.pieces)
        odd: dict[int, list[int]] = {}
        cut = words
        if self.kind == BPE:
            # merges of spaces among themselves come last, so they are made apart
            cut = [w if w[:2] != SPACE * 2 else SPACE + w.lstrip(SPACE) for w in words]
        flat, count = self.segment(cut)
        ends = np.cumsum(count)
        if self.kind == BPE:
            for i in [i for i, (w, c) in enumerate(zip(words, cut, strict=True)) if w is not c]:
                found = flat[ends[i] - count[i] : ends[i]].tolist()
                free = len(words[i]) - len(cut[i])
                if found[0] < unknown and self.pieces[found[0]] == SPACE:
                    free, found = free + 1, found[1:]
                odd[i] = [self.number.get(p, unknown) for p in _merge(SPACE * free, self.rank)] + found
        missing = np.unique(np.searchsorted(ends, np.flatnonzero(flat == unknown), "right"))
        for i in {*missing.tolist(), *odd}:
            found, whole, at = odd.get(i, flat[ends[i] - count[i] : ends[i]].tolist()), [], 0
            for p in found:
                if p < unknown:
                    whole.append(p)
                    at += len(self.pieces[p])
                    continue
                if self.byte_fallback:
                    whole.extend(self.bytes_at[list(words[i][at].encode("utf-8", "surrogatepass"))].tolist())
                elif not whole or whole[-1] != self.unknown:
                    whole.append(self.unknown)
                at += 1
            odd[i] = whole
        if odd:
            parts, at = [], 0
            for i in sorted(odd):
                parts += [flat[at : ends[i] - count[i]], np.array(odd[i], np.int64)]
                at = ends[i]
            flat = np.concatenate([*parts, flat[at:]])
            count = count.copy()
            count[list(odd)] = [len(x) for x in odd.values()]
        return flat.astype(np.int32), count

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece lies across, with spaces as they are."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.collapse_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.parts.findall(" " + text if self.dummy_prefix else text)

    def encode(self, texts: pa.Array, memory: Memory) -> pa.Array:
        """Identifiers of each text; null stays null. ``memory`` keeps the words met."""
        split = [None if t is None else self.words(t) for t in texts.to_pylist()]
        met = [w for ws in split if ws for w in ws]
        at = memory.places(met, self)
        sizes = memory.count[at]
        flat = _gather(memory.flat, memory.start, memory.count, at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0] + [len(ws or ()) for ws in split])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array([ws is None for ws in split]))

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of identifiers; null stays null. Bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(lists.flatten())
        count = self.byte_counts
        data = _gather(self.piece_bytes, self.byte_starts, count, ids).tobytes()
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        out = []
        for lo, hi, valid in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True):
            text = data[lo:hi].decode("utf-8", "replace") if valid else None
            out.append(text[1:] if valid and self.dummy_prefix and text[:1] == " " else text)
        return pa.array(out, pa.string())


class Memory(dict):
    """Places of the words met so far, and their identifiers; forgets all once they take too much."""

    def __init__(self):
        self.new: list[str] = []
        self.size = 0
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word.replace(" ", SPACE))
        self.size += 180 + len(word)
        place = self[word] = len(self)
        return place

    def places(self, words: list[str], model: Model) -> np.ndarray:
        if self.size > REMEMBERED:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            flat, count = model.encode_words(self.new)
            start = len(self.flat) + np.cumsum(count) - count
            self.flat, self.start, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.start, start]), np.concatenate([self.count, count])
            self.new = []
        return at


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The items of the lists numbered ``at``; each begins in ``flat`` at its ``start``."""
    sizes = count[at]
    return flat[np.repeat(start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _sized(h: np.ndarray, size: int) -> np.ndarray:
    """A hash that tells lengths apart and spreads over the top bits."""
    return (h + np.uint64(size * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)


def hash_prefixes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over characters, and what turns differences into hashes."""
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars + np.uint64(0x51ED270B)) * powers(_BASE, len(chars)), out=sums[1:])
    return sums, powers(_INVERSE, len(chars) + 1)


def hash_piece(piece: str) -> np.uint64:
    sums, _ = hash_prefixes(np.array([ord(c) for c in piece], np.uint64))
    return _sized(sums[-1:], len(piece))[0]


def _chunks(column: pa.Array, rows: int = 512):
    for lo in range(0, max(1, len(column)), rows):
        yield column.slice(lo, rows)


def encode(text: Column, model: Model) -> Column:
    """The identifiers of a text as array<int>; null stays null, an empty text has none. No text is cut."""
    bound_batches()

    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for texts in batches:
            for part in _chunks(texts):
                yield model.encode(part, memory)

    return run(text)


def decode(ids: Column, model: Model) -> Column:
    """The text of identifiers; null stays null."""
    bound_batches()

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for part in _chunks(lists):
                yield model.decode(part)

    return run(ids)


def encode_and_decode(text: Column, model: Model) -> Column:
    """A struct of ``ids`` and of ``decoded``, the text that they decode to, in one pass through Python."""
    bound_batches()

    @arrow_udf("struct<ids array<int>, decoded string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for texts in batches:
            for part in _chunks(texts):
                ids = model.encode(part, memory)
                yield pa.StructArray.from_arrays([ids, model.decode(ids)], ["ids", "decoded"])

    return run(text)
