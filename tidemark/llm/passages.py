"""Suffix-array deduplication: bytes covered by a string of ``length`` bytes that also starts in an earlier document.

Winnowed hash grouping instead of prefix doubling (ranks of all byte positions would be 14 times the input on disk):
hashes stand for ranks, and each round is a Spark shuffle by hash.

1. In every window of ``length`` bytes the 16-byte string with the smallest hash is its anchor, so equal windows have
   equal anchors at equal offsets. The anchors' names are dealt by Spark into buckets by hash; a name of one document
   only is unique and its windows drop out.
2. The remaining windows go along as bytes, again dealt by bucket, and are grouped by a hash of their first half; the
   unique ones drop out, the others are grouped by a hash of the full ``length``.
3. In every class of equal ``length``-byte strings all but the smallest document's are removed.

Copies within one bin of documents are settled before the shuffle, so a string that a third of the documents share
moves once per bin. Names are hashes of 64 bits, in round 1 of 40 and more, where a collision merely lets a unique anchor
pass to the next round; before anything is removed the bytes themselves are compared. Bins and buckets hold about 4 MB
of text each, so a task's memory does not grow with the input.

Rows without an id are left out; a null text is empty; rows that repeat an id do not count as earlier than each other.
Matches never cross documents; spans are byte offsets. Ids are whole numbers (or text of such). An empty table gives no
rows; texts are read whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SliceHash, Texts, bucket_bits, chunks, mix

ANCHOR = 16
_U = np.uint64


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


class _Part:
    """Anchors of the texts of one chunk: their document (row number), name, and first and last window start."""

    def __init__(self, batch: pa.RecordBatch, first_row: int, length: int):
        texts = Texts(batch.column(1))
        self.texts, self.hash, n = texts, SliceHash(texts.data), len(texts.data)
        self.row = self.name = self.low = self.high = np.zeros(0, np.int64)
        if n < length:
            return
        at = np.arange(n - ANCHOR + 1)
        grams = self.hash(at, at + ANCHOR)
        bits = _U(max(24, n.bit_length()))
        order = (grams >> bits << bits) | at.astype(np.uint64)
        best = _sliding_min(order, length - ANCHOR + 1)
        start = np.flatnonzero(np.repeat(texts.offsets[1:], np.diff(texts.offsets))[: len(best)] >= np.arange(len(best)) + length)
        if not len(start):
            return
        anchor = (best[start] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        row = np.searchsorted(texts.offsets, start, side="right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(new)
        self.low, self.high = start[cut], start[np.append(cut[1:], len(start)) - 1]
        self.name, self.row = mix(grams[anchor[cut]]), row[cut] + first_row


def _parts(rows: pa.Table, length: int):
    done = 0
    for batch in chunks(iter(rows.select(["doc_id", "text"]).combine_chunks().to_batches())):
        yield _Part(batch, done, length), batch
        done += batch.num_rows


def _ordered(rows: pa.Table) -> pa.Table:
    """The same row numbers in every round."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and each element's run number."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, concatenated."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes (8 at least) at places a and b are the same; eight bytes at once."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    eight = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), 0, (1,))  # the eight bytes from each place on, without a copy
    for k in (*range(0, length - 7, 8), length - 8):
        out &= eight[a + k] == eight[b + k]
    return out


def _later(name: np.ndarray, doc: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether a smaller document has the same name and the same string of ``length`` bytes at its place."""
    order = np.lexsort((doc, name))
    begin, run = _runs(name[order])
    first, out = order[begin][run], np.zeros(len(name), bool)
    later = doc[order] > doc[first]
    one, other = order[later], first[later]
    out[one] = _equal(data, at[one], at[other], length)
    return out


def _classes(name: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal strings of ``length`` bytes are neighbours, the start of each run of equal ones, and each
    element's run. Names bring them together; where a name stands for several strings, these are told apart."""
    order = np.argsort(name, kind="stable")
    begin, run = _runs(name[order])
    same = _equal(data, at[order], at[order][begin][run], length)
    if not same.all():
        mixed = np.flatnonzero(np.isin(run, run[~same]))
        strings = data[at[order[mixed]][:, None] + np.arange(length)]
        _, back = np.unique(strings, axis=0, return_inverse=True)
        name = np.zeros(len(order), np.int64)
        name[order] = run
        name[order[mixed]] = len(begin) + back.ravel()
        order = np.argsort(name, kind="stable")
        begin, run = _runs(name[order])
    return order, begin, run


def _merge(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs (row, start, end) of overlapping or touching spans."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return np.zeros((0, 3), np.int64)
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(row)) - 1
    return np.stack([row[cut], start[cut], reach[last] - shift[last]], 1)


def _to_characters(spans: np.ndarray, raw: bytes) -> np.ndarray:
    """Spans of a text in UTF-8, grown to the borders of its characters."""
    inner = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
    border = np.append(np.flatnonzero(~inner), len(raw))
    starts = border[np.searchsorted(border, spans[:, 0], side="right") - 1]
    return _merge(np.zeros(len(spans), np.int64), starts, border[np.searchsorted(border, spans[:, 1])])[:, 1:]


def _window_runs(anchor: np.ndarray, step: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits at consecutive steps of one anchor: anchor, first and last step."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]])
    cut = np.flatnonzero(new)
    return anchor[at[cut]], step[at[cut]], step[at[np.append(cut[1:], len(at)) - 1]]


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], kind) for k, kind in kinds.items()})


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes long, spans array<struct<start,end>> (maximal removed runs, in bytes), kept binary (the rest),
    carried array<string> (the ``carry`` columns as text, so that a caller need not join them back). With
    ``whole_characters`` the rest also lacks what a span leaves of a character that it cuts."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    carried = F.array(*(F.col(c).cast("string") for c in carry)).cast("array<string>")
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
    bits = bucket_bits(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    docs = docs.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << bits)).cast("int"))
    key_shift, bucket_shift = _U(32 - bits), _U(64 - bits)

    def names(rows: pa.Table) -> pa.Table:
        """Round 1, per bin: each bucket's anchor names, those of one row and those of several apart."""
        found = [(p.name, p.row) for p, _ in _parts(rows, length) if len(p.name)]
        kinds = {"bin": pa.int32(), "bucket": pa.int32(), "once": pa.binary(), "more": pa.binary()}
        out: dict[str, list] = {k: [] for k in kinds}
        if found:
            key, row = np.concatenate([x[0] for x in found]) >> key_shift, np.concatenate([x[1] for x in found])
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            begin, _ = _runs(key)
            several = row[begin] != row[np.append(begin[1:], len(key)) - 1]
            key = key[begin]
            bucket, short = (key >> _U(32)).astype(np.int64), key.astype(np.uint32)
            cut, _ = _runs(bucket)
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist()):
                out["bucket"].append(int(bucket[a]))
                out["once"].append(short[a:b][~several[a:b]].tobytes())
                out["more"].append(short[a:b][several[a:b]].tobytes())
            out["bin"] = [rows["bin"][0].as_py()] * len(out["bucket"])
        return _table(out, kinds)

    def shared(rows: pa.Table) -> pa.Table:
        """Round 1, per bucket: the names that more than one row has, sent back to the bins that hold them."""
        once = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["once"]]
        more = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["more"]]
        every = np.concatenate([*once, *more])
        value, count = np.unique(every, return_counts=True)
        value = np.union1d(value[count > 1], np.unique(np.concatenate(more)))
        kept = []
        for a, b in zip(once, more):
            mine = np.concatenate([a, b])
            kept.append(mine[np.isin(mine, value, assume_unique=True)].tobytes() if len(value) else b"")
        return pa.table({"bin": rows["bin"], "bucket": rows["bucket"], "names": pa.array(kept, pa.binary())}).filter(pa.array([len(x) > 0 for x in kept]))

    suffix_kinds = {"bucket": pa.int32(), "bin": pa.int32()} | {k: pa.binary() for k in ("ids", "rows", "starts", "sizes", "strings", "spans")}

    def suffixes(rows: pa.Table, flags: pa.Table) -> pa.Table:
        """Round 2, per bin: strings that hold the windows of shared anchors, but for windows that an earlier document
        of the same bin settles; those are spans already."""
        out: dict[str, list] = {k: [] for k in suffix_kinds}
        if not rows.num_rows or not flags.num_rows:
            return _table(out, suffix_kinds)
        rows = _ordered(rows)
        bin_ = rows["bin"][0].as_py()
        active = np.sort(np.concatenate([np.frombuffer(n.as_buffer(), np.uint32).astype(np.uint64) | (_U(b.as_py()) << _U(32)) for b, n in zip(flags["bucket"], flags["names"])]))
        ids = np.asarray(rows["doc_id"].combine_chunks())
        grams, held, strings = [], [], []
        for part, _ in _parts(rows, length):
            if not len(part.name):
                continue
            key = part.name >> key_shift
            keep = active[np.minimum(np.searchsorted(active, key), len(active) - 1)] == key
            low, high, row = part.low[keep], part.high[keep], part.row[keep]
            counts = high - low + 1
            start = np.repeat(low, counts) + _spread(counts)
            grams.append(part.hash(start, start + length))
            base = part.texts.offsets[np.searchsorted(part.texts.offsets, low, side="right") - 1]
            held.append((row, low - base, high - base, part.name[keep]))
            strings.append(part.texts.data[np.repeat(low, counts + length - 1) + _spread(counts + length - 1)])
        if not held:
            return _table(out, suffix_kinds)
        row, low, high, name = (np.concatenate([x[i] for x in held]) for i in range(4))
        gram, string = np.concatenate(grams), np.concatenate(strings)
        counts = high - low + 1
        anchor, step = np.repeat(np.arange(len(row)), counts), _spread(counts)
        inner = np.repeat(np.cumsum(counts + length - 1) - (counts + length - 1), counts) + step
        settled = _later(gram, ids[row][anchor], string, inner, length)
        a, first, last = _window_runs(anchor, step, settled)
        merged = _merge(row[a], low[a] + first, low[a] + last + length)
        if len(merged):
            out["bucket"].append(bin_)
            out["spans"].append(merged.tobytes())
        open_ = ~settled
        least, most = np.full(len(row), 1 << 40), np.full(len(row), -1)
        np.minimum.at(least, anchor[open_], step[open_])
        np.maximum.at(most, anchor[open_], step[open_])
        go = np.flatnonzero(most >= 0)
        begin = (np.cumsum(counts + length - 1) - (counts + length - 1))[go] + least[go]
        size = most[go] - least[go] + length
        bucket = (name[go] >> bucket_shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        go, begin, size, bucket = go[order], begin[order], size[order], bucket[order]
        cut, _ = _runs(bucket)
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist()):
            pick, lengths = go[a:b], size[a:b]
            out["bucket"].append(int(bucket[a]))
            out["ids"].append(ids[row[pick]].tobytes())
            out["rows"].append(row[pick].astype(np.uint32).tobytes())
            out["starts"].append((low[pick] + least[pick]).astype(np.uint32).tobytes())
            out["sizes"].append(lengths.astype(np.uint16).tobytes())
            out["strings"].append(string[np.repeat(begin[a:b], lengths) + _spread(lengths)].tobytes())
        out["bin"] = [bin_] * len(out["bucket"])
        empty = len(out["bucket"]) - len(out["ids"])
        for k in ("ids", "rows", "starts", "sizes", "strings"):
            out[k] = [b""] * empty + out[k]
        out["spans"] += [b""] * (len(out["bucket"]) - len(out["spans"]))
        return _table(out, suffix_kinds)

    def ranks(rows: pa.Table) -> pa.Table:
        """Round 2, per bucket: doubling to the full length; windows of all but the smallest document are spans."""
        kinds = {"bin": pa.int32(), "spans": pa.binary()}
        out: dict[str, list] = {"bin": [b.as_py() for b, s in zip(rows["bin"], rows["spans"]) if len(s.as_buffer())], "spans": [s.as_py() for s in rows["spans"] if len(s.as_buffer())]}
        column = lambda k, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows[k]])
        doc, size = column("ids", np.int64), column("sizes", np.uint16).astype(np.int64)
        if len(doc):
            own_bin = np.repeat(np.asarray(rows["bin"].combine_chunks()), [len(x.as_buffer()) // 8 for x in rows["ids"]])
            row, start = column("rows", np.uint32).astype(np.int64), column("starts", np.uint32).astype(np.int64)
            data = column("strings", np.uint8)
            hashed = SliceHash(data)
            counts = size - length + 1
            anchor, step = np.repeat(np.arange(len(doc)), counts), _spread(counts)
            at = (np.cumsum(size) - size)[anchor] + step
            alive, hit = np.arange(len(at)), np.zeros(len(at), bool)
            half = length // 2
            rank = hashed(at, at + half)
            for reach in (half, length):
                if reach > half:  # the pair of the rank so far and the rank at that offset
                    rank = mix(rank[alive] + mix(hashed(at[alive] + half, at[alive] + length)))
                if reach == length:
                    order, begin, run = _classes(rank, data, at[alive], length)
                else:
                    order = np.argsort(rank, kind="stable")
                    begin, run = _runs(rank[order])
                owner = doc[anchor[alive[order]]]
                low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
                if reach == length:
                    hit[alive[order]] = owner > low[run]
                else:
                    alive = np.sort(alive[order][(low < high)[run]])
                if not len(alive):
                    break
            a, first, last = _window_runs(anchor, step, hit)
            place = own_bin[a]
            for b in np.unique(place).tolist():
                mine = place == b
                out["bin"].append(int(b))
                out["spans"].append(_merge(row[a[mine]], start[a[mine]] + first[mine], start[a[mine]] + last[mine] + length).tobytes())
        return _table(out, kinds)

    def cut(rows: pa.Table, spans: pa.Table) -> pa.Table:
        """Per bin: the texts without their spans."""
        rows = _ordered(rows)
        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in spans["spans"]] if spans.num_rows else []
        every = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        every = _merge(every[:, 0], every[:, 1], every[:, 2])
        bounds = np.searchsorted(every[:, 0], np.arange(rows.num_rows + 1))
        kept, lengths, at = [], [], 0
        for column in rows["text"].cast(pa.binary()).chunks:
            for text in column:
                mine, raw = every[bounds[at] : bounds[at + 1], 1:], text.as_py()
                at += 1
                lengths.append(len(raw))
                if len(mine):
                    if whole_characters:
                        mine = _to_characters(mine, raw)
                    edges = [0, *mine.ravel().tolist(), len(raw)]
                    raw = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])])
                kept.append(raw)
        counts = np.diff(bounds)
        starts, ends = pa.array(every[:, 1].astype(np.int32)), pa.array(every[:, 2].astype(np.int32))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        values = pa.StructArray.from_arrays([starts, ends], names=["start", "end"])
        return pa.table({"doc_id": rows["doc_id"].combine_chunks(), "n_bytes": pa.array(lengths, pa.int64()), "spans": pa.ListArray.from_arrays(offsets, values), "kept": pa.array(kept, pa.binary()), "carried": rows["carried"].combine_chunks()})

    by_bin = docs.groupBy("bin")
    flags = by_bin.applyInArrow(names, "bin int, bucket int, once binary, more binary").groupBy("bucket").applyInArrow(shared, "bin int, bucket int, names binary")
    strings = by_bin.cogroup(flags.groupBy("bin")).applyInArrow(suffixes, "bucket int, bin int, ids binary, rows binary, starts binary, sizes binary, strings binary, spans binary")
    spans = strings.groupBy("bucket").applyInArrow(ranks, "bin int, spans binary")
    return by_bin.cogroup(spans.groupBy("bin")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, carried array<string>")
