"""Removal of long substrings that occur more than once, by induced suffix sorting.

Only some suffixes are sorted outright: each string of `length` bytes has one anchor, the place in
it whose following half has the smallest hash, so equal strings have equal anchors. Anchors whose
half occurs once cannot lie in a repeated string and go no further. The others are sorted by what
follows them, externally by Spark, and neighbours' common prefixes are taken. The order of the
suffixes that begin 1, 2, 3 ... bytes before the anchors is induced from that: one stable pass
over the preceding bytes for each step, in which common prefixes are carried as range minima. A
suffix whose common prefix with a neighbour reaches `length` begins a repeated string.

An anchor may belong to any number of documents. From HOT occurrences on its strings are compared
one by one instead, by their hashes: of equal ones a task sends one, and different ones go to
different tasks, so no group that meets in a task is larger than HOT.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import bytes_of, partitions_of, texts_of
from tabprobe.llm.ngram_join import _place
from tabprobe.llm.pieces import mixed, powers
from tabprobe.llm.token_counts import held
from tabprobe.llm.tokens import (
    mapped, mounted_folder, packed, unpacked, write_array,
)

#: Bytes handled at once; a longer text is handled in overlapping parts.
PART_BYTES = 1_000_000
#: Sorted suffixes induced together, and from how many on their bytes lie in a file.
TOGETHER, IN_MEMORY = 30_000, 400_000
#: Occurrences of an anchor from which on its strings are compared one by one.
HOT = 5_000

_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 24) - 1)
ANCHOR, WHOLE, MARK, STRING = 0, 1, 2, 3
RECORDS = ("key long, kind int, right binary, left binary, high long, low long, lo long, hi long")


def parts_of(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, to) of about PART_BYTES; parts of a text overlap by length - 1."""
    out, size = [], 0
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        at = 0
        while at + length <= b - a:
            end = min(b - a, at + PART_BYTES + length - 1)
            out.append((row, int(at), int(end)))
            size += end - at
            at = end - length + 1
            if size >= PART_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


class Anchors:
    """Anchors of all strings of `length` bytes in some parts of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: list, length: int):
        half = length // 2
        rows, froms, tos = (np.array(x, np.int64) for x in zip(*parts))
        sizes = tos - froms
        self.data = np.concatenate([data[offsets[r] + a:offsets[r] + b] for r, a, b in parts])
        begin = np.cumsum(sizes) - sizes
        n = len(self.data)
        ups, downs = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[self.data] * ups[:-1], out=self._sums[1:])
        self._downs = downs
        m = n - half + 1
        hashes = mixed((self._sums[half:] - self._sums[:m]) * downs[:m])
        keyed = (hashes & ~_PLACE) | np.arange(m, dtype=np.uint64)
        width = length - half + 1  # places of a string where its half can begin
        lowest = _sliding_min(keyed, width)
        inside = np.ones(len(lowest), bool)
        last = begin + sizes - length  # last place of a part where a string begins
        for a, b in zip(last[:-1] + 1, begin[1:]):
            inside[a:b] = False
        starts = np.flatnonzero(inside)
        chosen = (lowest[starts] & _PLACE).astype(np.int64)
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(starts)) - 1
        self.at = chosen[first]
        self.start, self.stop = starts[first], starts[final] + length  # bytes of its strings
        part = np.searchsorted(begin, self.at, side="right") - 1
        self.row, self.shift = rows[part], froms[part] - begin[part]
        self.hash = hashes[self.at]

    def strings(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, begin and hash of each string of the given anchors."""
        n = self.stop[which] - self.start[which] - length + 1
        own = np.repeat(which, n)
        at = np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return own, at, mixed((self._sums[at + length] - self._sums[at]) * self._downs[at])

    def spans(self) -> np.ndarray:
        """Hashes of all bytes of each anchor's strings."""
        return mixed((self._sums[self.stop] - self._sums[self.start]) * self._downs[self.start])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbouring values."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1:width - 1 + m])


def binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings cut out of `data`."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def digest_of(text: bytes) -> tuple[int, int]:
    a = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(a[:8], "big", signed=True), int.from_bytes(a[8:], "big", signed=True)


def _distinct(batch: pa.RecordBatch):
    """Bytes and bounds of the batch's texts, and for each digest the first row and the number."""
    data, offsets = bytes_of(batch.column("text"))
    seen: dict[tuple[int, int], list[int]] = {}
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own = seen.setdefault(digest_of(data[a:b].tobytes()), [row, 0])
        own[1] += 1
    return data, offsets, seen


def _only(offsets: np.ndarray, data: np.ndarray, rows: list[int]):
    """The named rows end to end."""
    own = [data[offsets[r]:offsets[r + 1]] for r in rows]
    bounds = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(x) for x in own], out=bounds[1:])
    return np.concatenate(own) if own else data[:0], bounds


class Repeated:
    """How often the half behind an anchor occurs (with those that share 32 bits): 0 for once,
    1 for more often, 2 from HOT on."""

    def __init__(self, folder: str, shards: int):
        self.shards = shards
        paths = [f"{folder}/halves/{s}.npy" for s in range(shards)]
        self.keys = [mapped(p) if os.path.exists(p) else np.zeros(0, np.uint32) for p in paths]
        self.hot = [np.array(mapped(p.replace(".npy", ".hot.npy"))) if os.path.exists(p)
                    else np.zeros(0, np.uint32) for p in paths]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        own, back = np.unique(hashes, return_inverse=True)
        shard, place = _place(own, self.shards)
        out = np.zeros(len(own), np.int8)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s, keys in enumerate(self.keys):
            a, b = cut[s], cut[s + 1]
            if b > a and len(keys):
                at = np.minimum(np.searchsorted(keys, place[a:b]), len(keys) - 1)
                out[a:b] = keys[at] == place[a:b]
                out[a:b] += np.isin(place[a:b], self.hot[s])
        return out[back]


def induced(lcp: np.ndarray, left: np.ndarray, highs: np.ndarray, length: int,
            folder: str | None = None) -> np.ndarray:
    """For each sorted anchor and each step before it, whether a repeated string begins there.

    lcp: common prefix with the anchor before it in sorted order, -1 where another group begins;
    left: bytes before each anchor, nearest first; highs: how many of them there are.
    """
    n, steps = left.shape
    found = _array((n, steps + 1), bool, folder)
    alive, common = np.arange(n), lcp.astype(np.int32)
    for step in range(steps + 1):
        if step:
            use = np.flatnonzero(highs[alive] >= step)
            group = np.cumsum(common < 0)
            key = group[use] * 256 + left[alive[use], step - 1]
            order = np.argsort(key, kind="stable")
            rank, key = use[order], key[order]
            same = np.r_[False, key[1:] == key[:-1]][:len(key)]
            pair = same | np.r_[same[1:], False][:len(key)]
            rank, same = rank[pair], same[pair]
            now = np.full(len(rank), -1, np.int32)
            at = np.flatnonzero(same)
            near = rank[at] == rank[at - 1] + 1
            now[at[near]] = common[rank[at[near]]]
            far = at[~near]
            if len(far):  # smallest common prefix on the way from one to the next
                edges = np.stack([rank[far - 1] + 1, rank[far] + 1], axis=1).ravel()
                padded = np.append(common, np.int32(np.iinfo(np.int32).max))
                now[far] = np.minimum.reduceat(padded, edges)[::2]
            alive, common = alive[rank], now
        if not len(alive):
            break
        hit = common >= length - step
        found[alive[hit | np.r_[hit[1:], False]], step] = True
    return found


def _array(shape: tuple[int, ...], kind, folder: str | None) -> np.ndarray:
    """Zeros; if there are many, in a file of the shared folder that nothing else can name."""
    if shape[0] <= IN_MEMORY or folder is None:
        return np.zeros(shape, kind)
    path = f"{folder}/scratch-{uuid.uuid4().hex}"
    found = np.memmap(path, kind, "w+", shape=shape)
    os.unlink(path)  # it goes with the last array that maps it, or with its task
    return found


def matrix(strings: pa.Array, width: int, backwards: bool,
           folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, filled up with 0, and their sizes."""
    strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    data, offsets = bytes_of(strings)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    if backwards:
        at = np.repeat(size, size) - 1 - at
    out = _array((len(size), width), np.uint8, folder)
    out[row, at] = data
    return out, size


def _induce(rows: pa.Table, length: int, folder: str | None = None) -> pa.Table:
    """Repeated stretches (high, low, lo, hi) of some whole groups of sorted anchors.

    Anchors with all the same bytes around them are one, and repeated throughout.
    """
    key = rows.column("key").to_numpy()
    kind = rows.column("kind").to_numpy()
    lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    anchors = kind == ANCHOR
    right, size = matrix(rows.column("right"), length, False, folder)
    n = len(key)
    whole = np.minimum(size[1:], size[:-1])
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, whole)
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where((key[1:] == key[:-1]) & anchors[1:] & anchors[:-1], common, -1)
    left, highs = matrix(rows.column("left"), length - length // 2, True, folder)
    equal = np.zeros(n, bool)  # the same bytes as the one before
    equal[1:] = ((lcp[1:] >= 0) & (size[1:] == size[:-1]) & (common == size[1:])
                 & (highs[1:] == highs[:-1]) & (left[1:] == left[:-1]).all(axis=1))
    twice = equal | np.r_[equal[1:], False]
    same_text = np.zeros(n, bool)
    same_text[1:] = ((kind[1:] == kind[:-1]) & np.isin(kind[1:], (WHOLE, STRING))
                     & (key[1:] == key[:-1]))
    twice |= same_text | np.r_[same_text[1:], False]
    one = np.flatnonzero(anchors & ~equal)
    found = induced(lcp[one], left[one], highs[one], length, folder)
    edge = np.zeros((len(one), found.shape[1] + 2), np.int8)
    edge[:, 1:-1] = found
    step = np.diff(edge, axis=1)
    who, first = np.nonzero(step == 1)
    _, final = np.nonzero(step == -1)  # one step beyond
    at = lo[one] + highs[one]  # the anchor itself
    single = ~twice[one[who]]
    who, first, final = who[single], first[single], final[single]
    direct = np.flatnonzero(twice | (kind == MARK))
    take = np.concatenate([direct, one[who]])
    return pa.table({
        "high": rows.column("high").to_numpy()[take], "low": rows.column("low").to_numpy()[take],
        "lo": np.concatenate([lo[direct], at[who] - final + 1]),
        "hi": np.concatenate([hi[direct], at[who] - first + length])})


def united(rows: pd.DataFrame) -> pd.DataFrame:
    """Stretches of each text, sorted, with those that meet or overlap made one."""
    rows = rows.sort_values(["high", "low", "lo", "hi"], kind="stable")
    text = rows.groupby(["high", "low"], sort=False).ngroup().to_numpy()
    lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
    wide = int(hi.max(initial=0)) + 1
    reach = np.maximum.accumulate(hi + text * wide) if len(hi) else hi
    new = np.r_[True, (lo[1:] + text[1:] * wide > reach[:-1])][:len(lo)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    out = rows.iloc[first].copy()
    out["hi"] = reach[last] - text[last] * wide
    return out


class Stretches:
    """The stretches to remove from a text, by its digest."""

    def __init__(self, folder: str, shards: int):
        paths = [f"{folder}/stretches/{s}.npy" for s in range(shards)]
        self.parts = [mapped(p) if os.path.exists(p) else None for p in paths]

    def of(self, digest: tuple[int, int]) -> np.ndarray:
        part = self.parts[digest[0] % len(self.parts)]
        if part is None:
            return np.zeros((0, 2), np.int64)
        a, b = (np.searchsorted(part[0], digest[0], side=s) for s in ("left", "right"))
        own = np.array(part[:, a:b])
        return own[2:, own[1] == digest[1]].T


def repeated_spans(docs: DataFrame, length: int = 400, shards: int | None = None) -> str:
    """Finds all repeated strings and returns the folder with the stretches they cover.

    Three shuffles: the halves behind anchors (4 bytes each), the sorted anchors with the bytes of
    their strings (only where the half is repeated, the same bytes once for each batch of rows),
    and the stretches found. Copies of a text within a batch are handled once.
    """
    spark = docs.sparkSession
    shards = shards or partitions_of(spark)
    folder = mounted_folder(spark, "substrings")
    texts = texts_of(docs).select("text")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = bytes_of(batch.column("text")) + (None,)
            own = [Anchors(data, offsets, p, length).hash for p in parts_of(offsets, length)]
            values = np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)
            shard, place = _place(values, shards)
            which, first = np.unique(shard, return_index=True)
            cut = [*first, len(values)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(which.astype(np.int32)),
                "places": pa.array([packed(place[a:b]) for a, b in zip(cut, cut[1:])],
                                   pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        places = np.sort(np.concatenate([unpacked(b, np.uint32) for b in rows["places"]]))
        again, n = np.unique(places[1:][places[1:] == places[:-1]], return_counts=True)
        write_array(f"{folder}/halves/{shard}.hot.npy", again[n + 1 >= HOT])
        write_array(f"{folder}/halves/{shard}.npy", again)
        return pd.DataFrame({"shard": [shard], "repeated": [len(again)]})

    texts.mapInArrow(halves, "shard int, places binary").groupBy("shard").applyInPandas(
        merge, "shard int, repeated long").agg(F.sum("repeated")).collect()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = held("halves", folder, lambda: Repeated(folder, shards))
        for batch in batches:
            data, offsets, seen = _distinct(batch)
            rows = [row for row, _ in seen.values()]
            data, offsets = _only(offsets, data, rows)
            high, low = (np.array([d[k] for d in seen], np.int64) for k in (0, 1))
            size = np.diff(offsets)
            long = np.flatnonzero(size >= length)
            copies = np.array([n for _, n in seen.values()], np.int64)[long] > 1
            none = pa.array([b""] * len(long), pa.binary())
            yield _batch(high[long], np.where(copies, MARK, WHOLE), none, none, high[long],
                         low[long], np.zeros(len(long), np.int64), size[long])
            if copies.any():  # copies elsewhere have to find one here
                some = long[copies]
                none = pa.array([b""] * len(some), pa.binary())
                yield _batch(high[some], np.full(len(some), WHOLE), none, none, high[some],
                             low[some], np.zeros(len(some), np.int64), size[some])
            for parts in parts_of(offsets, length):
                found = Anchors(data, offsets, parts, length)
                often = again(found.hash)
                hot = np.flatnonzero(often == 2)
                if len(hot):
                    yield _strings(found, hot, length, high, low)
                use = np.flatnonzero(often == 1)
                if not len(use):
                    continue
                at, start, stop = found.at[use], found.start[use], found.stop[use]
                row, shift = found.row[use], found.shift[use]
                _, first, back, n = np.unique(
                    np.stack([found.spans()[use], (at - start).astype(np.uint64)]), axis=1,
                    return_index=True, return_inverse=True, return_counts=True)
                kinds = np.full(len(use), MARK)
                kinds[n[back.ravel()] == 1] = ANCHOR
                marks = np.flatnonzero(kinds == MARK)
                empty = pa.array([b""] * len(marks), pa.binary())
                if len(marks):  # these meet with nothing, so their key is any
                    m = marks
                    spread = mixed(high[row[m]].view(np.uint64)
                                   + start[m].astype(np.uint64)).view(np.int64)
                    yield _batch(spread, kinds[m], empty, empty,
                                 high[row[m]], low[row[m]], (start + shift)[m], (stop + shift)[m])
                f = first
                for k in range(0, len(f), 20_000):
                    g = f[k:k + 20_000]
                    yield _batch(
                        found.hash[use][g].view(np.int64), np.full(len(g), ANCHOR),
                        binary(found.data, at[g], stop[g]), binary(found.data, start[g], at[g]),
                        high[row[g]], low[row[g]], (start + shift)[g], (stop + shift)[g])

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n < TOGETHER:
                continue
            rows = pa.Table.from_batches(waiting)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield from _shards(_induce(rows.slice(0, cut), length, folder), shards)
            waiting = rows.slice(cut).to_batches()
            n = len(rows) - cut
        if n:
            yield from _shards(_induce(pa.Table.from_batches(waiting), length, folder), shards)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = united(rows)
        write_array(f"{folder}/stretches/{shard}.npy",
                    rows[["high", "low", "lo", "hi"]].to_numpy(np.int64).T.copy())
        return pd.DataFrame({"shard": [shard], "stretches": [len(rows)]})

    stretches = (
        texts.mapInArrow(records, RECORDS).repartition(shards, "key")
        .sortWithinPartitions("key", "kind", "right", "left").mapInArrow(
            induce, "shard int, high long, low long, lo long, hi long"))
    stretches.groupBy("shard").applyInPandas(
        write, "shard int, stretches long").agg(F.sum("stretches")).collect()
    return folder


def _strings(found: Anchors, hot: np.ndarray, length: int, high: np.ndarray,
             low: np.ndarray) -> pa.RecordBatch:
    """Each string of hot anchors; of equal ones here the first, and all of them as repeated."""
    own, at, hashes = found.strings(hot, length)
    _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True,
                                  return_counts=True)
    again = np.flatnonzero(n[back] > 1)
    # Neighbouring repeated strings are one stretch.
    new = np.r_[True, (own[again][1:] != own[again][:-1]) | (np.diff(at[again]) != 1)][:len(again)]
    begin = again[new]
    end = again[np.r_[np.flatnonzero(new)[1:] - 1, len(again) - 1]] if len(again) else again
    take = np.concatenate([first, begin])
    row, shift = found.row[own[take]], found.shift[own[take]]
    lo = at[take] + shift
    hi = np.concatenate([at[first], at[end]]) + shift + length
    kind = np.repeat([STRING, MARK], [len(first), len(begin)])
    key = hashes[take]
    marks = kind == MARK  # these meet with nothing, so their key is any
    key[marks] = mixed(high[row[marks]].view(np.uint64) + lo[marks].astype(np.uint64))
    none = pa.array([b""] * len(take), pa.binary())
    return _batch(key.view(np.int64), kind, none, none, high[row], low[row], lo, hi)


def _batch(key, kind, right, left, high, low, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(kind.astype(np.int32)), right, left, pa.array(high),
         pa.array(low), pa.array(lo), pa.array(hi)],
        names=["key", "kind", "right", "left", "high", "low", "lo", "hi"])


def _shards(rows: pa.Table, shards: int) -> Iterator[pa.RecordBatch]:
    shard = pa.array((rows.column("high").to_numpy() % shards).astype(np.int32))
    yield from rows.add_column(0, "shard", shard).to_batches()


def without_repeats(docs: DataFrame, length: int = 400, shards: int | None = None) -> DataFrame:
    """Each text without the bytes covered by a string of `length` bytes that occurs again.

    Returns doc_id, n_bytes, kept (the remaining bytes), spans (array of the removed runs' bounds).
    Strings are compared as UTF-8 bytes, never across documents, in the input as it is; overlaps
    count, and so do two places of one document. A null text is an empty one. Rows that repeat a
    text are copies of each other, so all their strings occur again. Further columns are ignored.
    """
    plain = texts_of(docs)
    shards = shards or partitions_of(docs.sparkSession)
    folder = repeated_spans(docs, length, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = held("stretches", folder, lambda: Stretches(folder, shards))
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for first in range(0, len(batch), 500):
                kept, spans = [], []
                rows = range(first, min(first + 500, len(batch)))
                for row in rows:
                    text = data[offsets[row]:offsets[row + 1]]
                    own = stretches.of(digest_of(text.tobytes()))
                    stay = np.ones(len(text), bool)
                    for lo, hi in own:
                        stay[lo:hi] = False
                    kept.append(text[stay].tobytes())
                    spans.append([{"from": int(a), "to": int(b)} for a, b in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(rows)),
                     pa.array(np.diff(offsets[first:first + len(rows) + 1])),
                     pa.array(kept, pa.binary()),
                     pa.array(spans, pa.list_(pa.struct(
                         [("from", pa.int64()), ("to", pa.int64())])))],
                    names=["doc_id", "n_bytes", "kept", "spans"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, kept binary, "
             "spans array<struct<`from`: long, `to`: long>>")
