"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens without a regex: each code point gets a class (letter, number, white space, other, and
the few that need a look ahead), each class is a function from scanner state to scanner state, and since composing
functions is associative, a blocked prefix scan over the functions gives the state at every code point of a whole
chunk at once. The slices between boundaries are merged pair by pair, lowest rank first, behind a bounded cache.

Null texts encode as empty; empty texts give empty arrays. Ids may be null or repeated: rows are handled one by one. An
empty table gives no rows; texts are read whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import chunks, id_and_text, list_array

# Scanner states: what the token that the last code point belongs to looks like.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, JOINABLE, TAIL2, TAIL1 = range(8)
# Code point classes. A white-space character directly before a visible one is the run's last; a plain space there
# may be joined by what follows. QUOTE1 and QUOTE2 are apostrophes followed by a contraction of one or two letters.
LETTER, NUMBER, OTHER, WHITE, LAST_SPACE, LAST_WHITE, QUOTE1, QUOTE2, BREAK = range(9)
_N_STATES, _N_CLASSES = 8, 9
NEVER = np.iinfo(np.int32).max

# fixed values: white space as the pattern's \s has it
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if kind == BREAK:
        return FRESH, True
    if state in (TAIL2, TAIL1):  # letters of a contraction
        return (TAIL1 if state == TAIL2 else FRESH), False
    if kind == LETTER:
        return LETTERS, state not in (LETTERS, JOINABLE)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, JOINABLE)
    if kind in (QUOTE1, QUOTE2) and state not in (OTHERS, JOINABLE):
        return (TAIL1 if kind == QUOTE1 else TAIL2), True
    if kind in (OTHER, QUOTE1, QUOTE2):
        return OTHERS, state not in (OTHERS, JOINABLE)
    if kind == WHITE:
        return SPACES, state != SPACES
    return (JOINABLE if kind == LAST_SPACE else FRESH), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the class functions: table[f, g] is "f, then g"; each class's element; state after f."""
    base = [tuple(_step(s, k)[0] for s in range(_N_STATES)) for k in range(_N_CLASSES)]
    index: dict[tuple, int] = {}
    elements: list[tuple] = []
    for f in [tuple(range(_N_STATES)), *base]:
        if f not in index:
            index[f] = len(elements)
            elements.append(f)
    done = 0
    while done < len(elements):
        for g in base:
            h = tuple(g[s] for s in elements[done])
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
        done += 1
    table = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    return table, np.array([index[f] for f in base], np.uint16), np.array(elements, np.uint8)


_TABLE, _OF_CLASS, _APPLY = _monoid()
_STARTS = np.array([[_step(s, k)[1] for k in range(_N_CLASSES)] for s in range(_N_STATES)])
_FLAT, _WIDTH = _TABLE.ravel(), len(_TABLE)


def _scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of a sequence of functions, in blocks."""
    n, block = len(f), 128
    if n <= block:
        out = f.copy()
        for i in range(1, n):
            out[i] = _TABLE[out[i - 1], f[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros((block, rows), np.uint16)  # element 0 is the identity
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = f
    grid[:] = padded.reshape(rows, block).T
    for i in range(1, block):
        grid[i] = _FLAT[grid[i - 1].astype(np.intp) * _WIDTH + grid[i]]
    before = np.zeros(rows, np.intp)
    before[1:] = _scan(np.ascontiguousarray(grid[-1]))[:-1]
    return _FLAT[(before * _WIDTH)[:, None] + grid.T].reshape(-1)[:n]


_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for every code point."""
    global _classes
    if _classes is None:
        major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
        _classes = np.where(major == "L", LETTER, np.where(major == "N", NUMBER, OTHER)).astype(np.uint8)
        _classes[WHITE_SPACE] = WHITE
    return _classes


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where tokens start in an array of code points; at ``breaks`` stand separators, each a token of its own."""
    n = len(points)
    kind = code_point_classes()[points]
    kind[breaks] = BREAK
    following = np.zeros(n + 2, points.dtype)
    following[:n] = points
    following[breaks] = 0
    a, b = following[1 : n + 1], following[2 : n + 2]
    white = kind == WHITE
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = ~(white | (kind == BREAK))[1:]
    last = white & visible_next
    kind[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        x, y = a[quote], b[quote]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        kind[quote[one]], kind[quote[two]] = QUOTE1, QUOTE2
    state = _APPLY[_scan(_OF_CLASS[kind]), FRESH]
    previous = np.full(n, FRESH, np.uint8)
    previous[1:] = state[:-1]
    return np.flatnonzero(_STARTS[previous, kind])


class Vocabulary:
    """Ranks by token bytes, read once per Python worker from a file in the tiktoken format."""

    loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str, cached: int = 100_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        joins = {(self.ranks[t[:k]] << 32) | self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair_keys = np.sort(np.fromiter(joins, np.int64, len(joins)))
        self.pair_ranks = np.array([joins[k] for k in self.pair_keys.tolist()], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cached, self.young, self.old = cached, {}, {}

    @classmethod
    def at(cls, path: str) -> "Vocabulary":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens at once. In every piece the adjacent pair of lowest rank (leftmost among
        equals) is joined until none is left; pieces of about equal length are the rows of one array."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces])
        for low, high in ((0, 8), (8, 16), (16, 64)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                for k, ids in zip(rows.tolist(), self._merge_rows([pieces[k] for k in rows.tolist()], size[rows])):
                    out[k] = ids
        for k in np.flatnonzero(size > 64).tolist():
            out[k] = np.array(self._merge_long(pieces[k]), np.int32).tobytes()
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens join to, or NEVER."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NEVER)

    def _merge_rows(self, pieces: list[bytes], size: np.ndarray) -> list[bytes]:
        width = int(size.max())
        held = np.arange(width) < size[:, None]
        parts = np.full((len(pieces), width + 1), -1, np.int32)
        parts[:, :width][held] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width + 1), NEVER, np.int32)
        ranks[:, : width - 1] = self._rank(parts[:, : width - 1], parts[:, 1:width])
        out: list[bytes] = [b""] * len(pieces)
        rows, columns = np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            going = best < NEVER
            for k in np.flatnonzero(~going).tolist():
                out[rows[k]] = parts[k, : size[k]].tobytes()
            rows, parts, ranks, at, best, size = rows[going], parts[going], ranks[going], at[going], best[going], size[going] - 1
            row = np.arange(len(rows))
            source = columns + (columns > at[:, None])
            parts[:, :width] = np.take_along_axis(parts, source, 1)
            source = columns + (columns >= at[:, None])
            ranks[:, :width] = np.take_along_axis(ranks, source, 1)
            parts[row, at] = best
            ranks[row, at] = self._rank(best, parts[row, at + 1])
            left = row[at > 0]
            ranks[left, at[left] - 1] = self._rank(parts[left, at[left] - 1], best[left])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list: n log n for pieces of any length."""
        get, n = self.ranks.get, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := before[i]) >= 0 and (r := get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of all pieces: from the two cache generations, or merged now and cached unless long."""
        young, old = self.young, self.old
        missing = [p for p in set(pieces) if p not in young]
        fresh = [p for p in missing if p not in old]
        found = {p: old[p] for p in missing if p in old}
        found.update(zip(fresh, self.merge_all([p.encode() for p in fresh])))
        if long := {p: ids for p, ids in found.items() if len(p) > 48}:
            return {p: young[p] if p in young else found[p] for p in set(pieces)} | long
        if len(young) + len(found) > self.cached:
            self.old, self.young = young, found
            return {p: young[p] if p in young else found[p] for p in set(pieces)}
        young.update(found)
        return young

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of the texts and each text's number of ids."""
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the separators' places
        starts = boundaries(points, ends)
        cuts = starts.tolist()
        pieces, at = [joined[a:b] for a, b in zip(cuts, cuts[1:])], 0
        pieces.append(joined[cuts[-1] :])
        known = self._learn(pieces)
        packed, counts = [], np.zeros(len(texts), np.int64)
        for k, stop in enumerate(np.searchsorted(starts, ends).tolist()):
            got = b"".join([known[p] for p in pieces[at:stop]])
            packed.append(got)
            counts[k], at = len(got) // 4, stop + 1
        return np.frombuffer(b"".join(packed), np.int32), counts

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each id the byte offset in its own text at which its token ends."""
        stop = np.cumsum(self.lengths[ids])
        first = np.cumsum(counts) - counts
        base = np.where(first > 0, stop[np.maximum(first, 1) - 1] if len(stop) else 0, 0)
        return (stop - np.repeat(base, counts)).astype(np.int32)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of one text, each token's placed by its retained offset."""
        length = self.lengths[ids]
        shift = np.repeat(self.begins[ids] - (ends - length), length)
        return self.bytes[shift + np.arange(len(shift))]


def _decoded(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of each text."""
    cuts = np.concatenate(([0], np.cumsum(counts)))
    return pa.array([vocab.decode(ids[a:b], ends[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, ends array<int> (the byte offset after each token) of every whole text.

    ``vocabulary`` is the path of a rank file that every executor can open (it comes with a Python package)."""
    return _encode(docs, vocabulary, id_col, text_col, False)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, ends, decoded binary: ``encode`` and ``decode`` chunk by chunk in one task, so that token arrays of
    a whole batch never wait between two workers."""
    return _encode(docs, vocabulary, id_col, text_col, True)


def _encode(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    docs = id_and_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.at(vocabulary)
        for part in chunks(batches):
            ids, counts = vocab.encode(part.column(1).to_pylist())
            ends = vocab.ends(ids, counts)
            columns = {"doc_id": part.column(0), "ids": list_array(ids, counts), "ends": list_array(ends, counts)}
            if back:
                columns["decoded"] = _decoded(vocab, ids, ends, counts)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, ends array<int>" + ", decoded binary" * back)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for; null ids decode as empty, null ends are found."""
    kind = encoded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.at(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in part.column(1)]
                counts, flat = np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
                held = [np.asarray(x.values) if x.is_valid else None for x in part.column(2)]
                ends = vocab.ends(flat, counts) if any(x is None for x in held) else np.concatenate(held)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _decoded(vocab, flat, ends, counts)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids", "ends").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, decoded binary")
