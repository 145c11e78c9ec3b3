"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and mapped into
memory.

Words are hashed to 64 bits; a word's place in the sorted hash array is its id. A bigram is the id
of its first word times 2^32 plus that of its second, so bigrams of a context lie together in the
sorted array. A trigram is the place of its first bigram and the id of its last word, packed
alike. Tasks count in arrays, sum up before they shuffle, and each shard of the model is
merged and written by one task. Scoring maps the arrays and searches them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import bytes_of, chunks, partitions_of, texts_of
from tabprobe.llm.letters import found_in, frame
from tabprobe.llm.token_counts import held
from tabprobe.llm.tokens import (
    let_go, mapped, mounted_folder, packed, planes, summed, unpacked, unplaned, word_hashes,
    write_array,
)

#: Hash of the end token; hashes of words are taken to be others.
END = np.uint64(0x8000000000000001)
#: Different entries that a task holds before it sends them on.
HELD_ENTRIES = 1_000_000
#: Training tokens for each shard of trigrams, of which a task merges one at a time.
MERGED_TOKENS = 500_000
#: Bytes of text that are hashed at once; a longer text is hashed by itself.
HASHED_BYTES = 200_000
#: Bounds of the sample that splitters between shards come from.
SPLITTER_DOCS, SPLITTER_KEYS = 2_000, 200_000

BLOBS = "shard int, keys binary, counts binary"
_SHIFT, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, in order."""
    return ((hashes >> _SHIFT) * np.uint64(shards)) >> _SHIFT


def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of a chunk, its token hashes (an end after each text), tokens a row."""
    data, offsets = bytes_of(batch.column("text"))
    for first, last in chunks(offsets):
        own = offsets[first:last + 1]
        # Hashing needs some 80 bytes a byte of text, so it takes less of it at once than lookups.
        parts = [word_hashes(data[own[a]:own[b]], own[a:b + 1] - own[a])
                 for a, b in chunks(own, HASHED_BYTES)]
        words, n = (np.concatenate(x) for x in zip(*parts))
        yield first, last, np.insert(words, np.cumsum(n), END), n + 1


def sealed(data: bytes) -> bytes:
    """Bytes with their length, compressed with an entropy code, which Spark's shuffle lacks."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def opened(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: their first halves as differences, their second halves as they are."""
    return sealed(packed((keys >> _SHIFT).astype(np.uint32)) + planes((keys & _LOW).astype(np.uint32)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    data = opened(blob)
    half = len(data) // 2
    return (unpacked(data[:half], np.uint32).astype(np.uint64) << _SHIFT) | unplaned(data[half:])


class Counter:
    """Sums of counts by key, sent on as blobs when there are many."""

    def __init__(self, shard):
        self.shard, self.parts, self.size = shard, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n.astype(np.uint32)))
        self.size += len(keys)
        if self.size > HELD_ENTRIES:
            self.parts = [self._sum()]
            self.size = len(self.parts[0][0])
            if self.size > HELD_ENTRIES // 2:
                yield self.sent()

    def _sum(self):
        return summed(np.concatenate([k for k, _ in self.parts]),
                      np.concatenate([n for _, n in self.parts]))

    def sent(self) -> pa.RecordBatch:
        keys, n = self._sum() if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.parts, self.size = [], 0
        n = n.astype(np.uint32)  # sums are wider
        of = self.shard(keys)
        own, first = np.unique(of, return_index=True)
        cut = [*first, len(keys)]
        return pa.RecordBatch.from_pydict({
            "shard": pa.array(own.astype(np.int32)),
            "keys": pa.array([packed_keys(keys[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
            "counts": pa.array([sealed(planes(n[a:b])) for a, b in zip(cut, cut[1:])], pa.binary()),
        })


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unpacked_keys(b) for b in rows["keys"]]),
                  np.concatenate([unplaned(opened(b)) for b in rows["counts"]]).astype(np.int64))


class WordTable:
    """Places of words: shard files of sorted hashes, one after the other."""

    def __init__(self, folder: str, sizes: tuple[int, ...]):
        self.parts = [mapped(f"{folder}/words/{s}.npy") if n else np.zeros(0, np.uint64)
                      for s, n in enumerate(sizes)]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        wanted, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(wanted), -1, np.int64)
        cut = np.searchsorted(shard_of(wanted, len(self.parts)), np.arange(len(self.parts) + 1))
        for s, part in enumerate(self.parts):
            own = wanted[cut[s]:cut[s + 1]]
            if len(own) and len(part):
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                out[cut[s]:cut[s + 1]] = np.where(part[at] == own, at + self.base[s], -1)
                let_go(part)
        return out[back]


class PairTable:
    """Places of bigrams: shard files of sorted keys, one after the other."""

    def __init__(self, folder: str, splitters: np.ndarray, sizes: tuple[int, ...]):
        self.splitters = splitters
        self.parts = [mapped(f"{folder}/bigrams/{s}.npy") if n else np.zeros(0, np.uint64)
                      for s, n in enumerate(sizes)]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        wanted, back = np.unique(keys, return_inverse=True)
        return self.sorted_places(wanted)[back]

    def sorted_places(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each of sorted different keys, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        cut = [0, *np.searchsorted(wanted, self.splitters), len(wanted)]
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            own, part = wanted[a:b], self.parts[s]
            if len(own) and len(part):
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                out[a:b] = np.where(part[at] == own, at + self.base[s], -1)
                let_go(part)
        return out

    def last_words(self, places: np.ndarray) -> np.ndarray:
        """Id of the second word at sorted places."""
        out = np.zeros(len(places), np.uint64)
        cut = np.searchsorted(places, self.base)
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                out[a:b] = self.parts[s][places[a:b] - self.base[s]] & _LOW
                let_go(self.parts[s])
        return out


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in four bytes each where they fit."""
    return n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64)


def write_counts(path: str, n: np.ndarray) -> None:
    """Counts in a byte each; those beyond it lie in a file of their own."""
    large = np.flatnonzero(n >= 255)
    write_array(f"{path}.count.npy", np.minimum(n, 255).astype(np.uint8))
    write_array(f"{path}.large.npy", np.stack([large, n[large]]))


def write_keys(path: str, keys: np.ndarray) -> None:
    """Sorted keys in as few bytes as the shard needs, the highest byte first, so that they sort as
    strings: the first half less that of the first key, then as many bits as the second half has."""
    least, bits = int(keys[0] >> _SHIFT), int((keys & _LOW).max()).bit_length()
    short = ((keys >> _SHIFT) - np.uint64(least) << np.uint64(bits)) | (keys & _LOW)
    width = max(-(-int(short[-1]).bit_length() // 8), 1)
    write_array(f"{path}.bits.npy", np.array([least, bits], np.uint64))
    write_array(f"{path}.npy", as_strings(short, width))


def as_strings(numbers: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bytes each, the highest first."""
    rows = numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:]
    return np.ascontiguousarray(rows).view(f"S{width}").ravel()


class ShortKeys:
    """Mapped sorted keys of write_keys."""

    def __init__(self, path: str):
        self.rows = mapped(f"{path}.npy")
        self.least, self.bits = np.load(f"{path}.bits.npy")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are there."""
        first, second, width = keys >> _SHIFT, keys & _LOW, self.rows.itemsize
        fits = (first >= self.least) & (second >> self.bits == 0)
        first = np.where(fits, first, self.least) - self.least
        if width < 8:  # larger numbers than any of the shard
            fits &= first >> np.uint64(min(max(8 * width - int(self.bits), 0), 63)) == 0
        short = as_strings(np.where(fits, first << self.bits | second, np.uint64(0)), width)
        at = np.minimum(np.searchsorted(self.rows, short), len(self.rows) - 1)
        return at, fits & (self.rows[at] == short)


class Counts:
    """Mapped shards of sorted keys with their counts; `short` keys are those of write_keys."""

    def __init__(self, keys: str, counts: str, splitters: np.ndarray, sizes: tuple[int, ...],
                 short: bool = False):
        self.splitters = splitters
        self.keys, self.counts, self.large = (
            [mapped(f"{path}/{s}{end}.npy") if n and path else None for s, n in enumerate(sizes)]
            for path, end in (("" if short else keys, ""), (counts, ".count"), (counts, ".large")))
        if short:
            self.keys = [ShortKeys(f"{keys}/{s}") if n else None for s, n in enumerate(sizes)]

    def values(self, s: int, at: np.ndarray) -> np.ndarray:
        """Counts at places of a shard."""
        n, large = self.counts[s][at].astype(np.int64), np.asarray(self.large[s])
        if len(large[0]):
            spot = np.minimum(np.searchsorted(large[0], at), len(large[0]) - 1)
            n = np.where((n == 255) & (large[0][spot] == at), large[1][spot], n)
        return n

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys), np.int64)
        cut = [0, *np.searchsorted(keys, self.splitters), len(keys)]
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a and self.keys[s] is not None:
                own = self.keys[s]
                at, known = (own.find if isinstance(own, ShortKeys) else
                             partial(found_in, own))(keys[a:b])
                out[a:b] = np.where(known, self.values(s, at), 0)
                for part in (getattr(own, "rows", own), self.counts[s], self.large[s]):
                    let_go(part)
        return out


def write_followers(path: str, per: np.ndarray) -> None:
    """How many continuations of each context occur once, twice and more often, in a byte each.

    Four bits, two and two; contexts beyond that lie in a file of their own.
    """
    small = (per[:, 0] < 16) & (per[:, 1] < 4) & (per[:, 2] < 4)
    code = per[:, 0] + 16 * per[:, 1] + 64 * per[:, 2]
    large = np.flatnonzero(~small | (code == 255))
    code[large] = 255
    write_array(f"{path}.follow.npy", code.astype(np.uint8))
    write_array(f"{path}.follow.large.npy", np.column_stack([large, per[large]]).astype(np.uint32))


class Followers:
    """Per context of two words: the sum of the counts behind it, and how many are 1, 2 and more.

    Contexts are places of bigrams. The sum is the bigram's own count, as every occurrence is
    followed by a token; the numbers were counted once, when the trigrams were merged. A lookup
    reads a few bytes per context, however many continuations it has.
    """

    def __init__(self, folder: str, pairs: PairTable, raw: Counts):
        self.base, self.raw = pairs.base, raw
        self.codes, self.large = (
            [mapped(f"{folder}/pairs/{s}.follow{end}.npy") if len(part) else None
             for s, part in enumerate(pairs.parts)] for end in ("", ".large"))

    def of(self, heads: np.ndarray) -> np.ndarray:
        """Rows of sum, n1, n2, n3+ for sorted places."""
        out = np.zeros((len(heads), 4), np.int64)
        cut = np.searchsorted(heads, self.base)
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b <= a:
                continue
            at = heads[a:b] - self.base[s]
            code = np.asarray(self.codes[s][at]).astype(np.int64)
            out[a:b] = np.stack(
                [self.raw.values(s, at), code & 15, code >> 4 & 3, code >> 6], axis=1)
            rows = a + np.flatnonzero(code == 255)
            if len(rows):
                large = self.large[s]
                spot = np.searchsorted(large[:, 0], heads[rows] - self.base[s])
                out[rows, 1:] = large[spot, 1:]
            for part in (self.codes[s], self.large[s], self.raw.counts[s], self.raw.large[s]):
                let_go(part)
        return out


def contexts(places: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """Place of the token before each one; `begin` at the start of a text."""
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[np.cumsum(n) - n] = begin
    return before


@dataclass(frozen=True)
class BigramModel:
    """Where the model lies, and its totals."""

    folder: str
    sizes: tuple[int, ...]      # words in each shard
    splitters: np.ndarray       # first bigram of each shard but the first
    bigrams: tuple[int, ...]    # bigrams in each shard
    train_tokens: int
    discounts: tuple[tuple[float, float, float], ...]  # one entry for each order
    of_count: tuple[int, int, int]  # words with 1, 2 and more continuations
    trigrams: tuple[int, ...] = ()  # trigrams in each shard; none for order 2
    trigram_splitters: np.ndarray | None = None

    @property
    def words(self) -> int:
        return sum(self.sizes)


def discounts_of(n: np.ndarray) -> tuple[float, float, float]:
    """The three discounts from how many entries have count 1, 2, 3 and 4.

    A count-of-counts of 0 (small corpora) leaves a discount of 0.5, 1 or 1.5.
    """
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k - 0.01) for d, k in zip(found, (1, 2, 3)))


def discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.asarray((0.0, *d))[np.minimum(counts, 3)], 0)


def count_of_counts(counts: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    return [int(x) for x in n[1:5]]


def train(docs: DataFrame, shards: int | None = None, order: int = 2) -> BigramModel:
    """Counts all texts of `docs` (null: empty) and writes the model to the shared folder.

    A pass for words, one for bigrams and, if `order` is 3, one for trigrams; bigrams then count by
    the words they follow, but those at the beginning of texts by how often they occur. A task holds at most HELD_ENTRIES different entries and a
    merging task one shard; frequent words are summed up before the shuffle, and bigram shards are
    key ranges between sampled splitters, so a frequent context is spread over several. Only
    totals and the bounded sample of keys come to the driver.
    """
    spark = docs.sparkSession
    shards = shards or partitions_of(spark)
    folder = mounted_folder(spark, "bigrams")
    texts = texts_of(docs).select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lambda keys: shard_of(keys, shards))
        for batch in batches:
            for _, _, tokens, _ in tokens_of(batch):
                yield from counter.add(tokens)
        yield counter.sent()

    def merge_words(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged(rows)
        shard = int(rows["shard"].iloc[0])
        write_array(f"{folder}/words/{shard}.npy", keys)
        write_array(f"{folder}/words/{shard}.count.npy", narrow(n))
        return pd.DataFrame({"shard": [shard], "size": [len(keys)], "total": [int(n.sum())]})

    found = (texts.mapInArrow(count_words, BLOBS).groupBy("shard")
             .applyInPandas(merge_words, "shard int, size long, total long").collect())
    size_of = {r.shard: r["size"] for r in found}
    sizes = tuple(size_of.get(s, 0) for s in range(shards))
    total, begin = sum(r.total for r in found), sum(sizes)
    if begin >= 1 << 32:
        raise ValueError("more than 2^32 different words")

    def keys_of(table: WordTable, tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
        places = table.places(tokens)
        return (contexts(places, n, begin).astype(np.uint64) << _SHIFT) | places.astype(np.uint64)

    share = min(1.0, SPLITTER_DOCS / max(docs.count(), 1))

    def splitters_of(keys_in, parts: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = held("words", folder, lambda: WordTable(folder, sizes))
            for batch in batches:
                for _, _, tokens, n in tokens_of(batch):
                    yield frame({"key": keys_in(table, tokens, n).view(np.int64)})

        sample = (texts.sample(share, seed=5).mapInArrow(run, "key long")
                  .orderBy(F.xxhash64("key", F.monotonically_increasing_id()))
                  .limit(SPLITTER_KEYS).toArrow().column("key").to_numpy().view(np.uint64))
        sample = np.unique(sample)
        cut = np.linspace(0, len(sample), parts + 1).astype(int)[1:-1]
        return np.unique(sample[cut]) if len(sample) else sample

    splitters = splitters_of(keys_of, shards)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held("words", folder, lambda: WordTable(folder, sizes))
        counter = Counter(lambda keys: np.searchsorted(splitters, keys, side="right"))
        for batch in batches:
            for _, _, tokens, n in tokens_of(batch):
                yield from counter.add(keys_of(table, tokens, n))
        yield counter.sent()

    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def by_words(kind: str, places: np.ndarray, values: np.ndarray) -> list[dict]:
        """Rows for the shards of words whose places are given (sorted); `begin` joins the last."""
        cut = np.searchsorted(places, base)
        cut[-1] = len(places)
        return [{"part": s, "kind": kind, "places": sealed(packed(places[a:b].astype(np.uint64))),
                 "numbers": sealed(planes(
                     np.ascontiguousarray(values[a:b].astype(np.uint64)).ravel()))}
                for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    def by_context(keys: np.ndarray, n: np.ndarray) -> list[dict]:
        context = (keys >> _SHIFT).astype(np.int64)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][:len(keys)])
        per = np.stack([np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
        return by_words("context", context[first], per)

    def merge_bigrams(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged(rows)
        shard = int(rows["shard"].iloc[0])
        write_array(f"{folder}/bigrams/{shard}.npy", keys)
        write_counts(f"{folder}/bigrams/{shard}", n)
        ends, of_end = summed(keys & _LOW, np.ones(len(keys), np.int64))
        out = by_context(keys, n) if order == 2 else []  # order 3 needs those of continuations
        out += by_words("ending", ends.astype(np.int64), of_end[:, None])
        out.append({"part": -1, "kind": f"{shard}:{len(keys)}", "places": b"",
                    "numbers": sealed(planes(np.array(count_of_counts(n), np.uint64)))})
        return pd.DataFrame(out)

    def merge_places(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        if part < 0:
            n = np.sum([unplaned(opened(b), np.uint64) for b in rows["numbers"]], axis=0, dtype=np.int64)
            return pd.DataFrame({"part": [part], "counts": [n.tolist()],
                                 "sizes": [",".join(sorted(rows["kind"]))]})
        size = int(sizes[part]) + 1  # the last entry is for the beginning of texts
        per, endings = np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
        for kind, places, numbers in zip(rows["kind"], rows["places"], rows["numbers"]):
            at = unpacked(opened(places)).astype(np.int64) - base[part]
            values = unplaned(opened(numbers), np.uint64).astype(np.int64)
            if kind == "context":
                per[at] += values.reshape(-1, 4)
            else:
                endings[at] += values
        if order == 2:
            write_array(f"{folder}/contexts/{part}.npy", narrow(per))
        write_array(f"{folder}/endings/{part}.npy", narrow(endings))
        n = [*count_of_counts(endings), int((endings >= 3).sum())]
        return pd.DataFrame({"part": [part], "counts": [n], "sizes": [""]})

    ended = (
        texts.mapInArrow(count_bigrams, BLOBS).groupBy("shard")
        .applyInPandas(merge_bigrams, "part int, kind string, places binary, numbers binary")
        .groupBy("part")
        .applyInPandas(merge_places, "part int, counts array<long>, sizes string").collect())
    of_bigrams = next((r for r in ended if r.part < 0), None)
    in_shard = dict(x.split(":") for x in of_bigrams.sizes.split(",")) if of_bigrams else {}
    bigrams = tuple(int(in_shard.get(str(s), 0)) for s in range(len(splitters) + 1))
    of_words = np.sum([r.counts for r in ended if r.part >= 0] or [[0] * 5], axis=0)
    of_count = (int(of_words[0]), int(of_words[1]), int(of_words[4]))
    lowest = discounts_of(of_words)
    if order == 2 or not of_bigrams:
        return BigramModel(
            folder, sizes, splitters, bigrams, total,
            (lowest, discounts_of(np.array(of_bigrams.counts if of_bigrams else [0] * 4))),
            of_count)
    if sum(bigrams) >= 1 << 32:
        raise ValueError("more than 2^32 different bigrams")

    def pair_table() -> PairTable:
        return held("pairs", folder, lambda: PairTable(folder, splitters, bigrams))

    def triples_of(table: WordTable, tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
        keys = keys_of(table, tokens, n)
        head = contexts(pair_table().places(keys), n, -1)
        good = head >= 0
        return (head[good].astype(np.uint64) << _SHIFT) | (keys[good] & _LOW)

    triple_splitters = splitters_of(triples_of, max(shards, -(-total // MERGED_TOKENS)))

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held("words", folder, lambda: WordTable(folder, sizes))
        counter = Counter(lambda keys: np.searchsorted(triple_splitters, keys, side="right"))
        for batch in batches:
            for _, _, tokens, n in tokens_of(batch):
                yield from counter.add(triples_of(table, tokens, n))
        yield counter.sent()

    def merge_trigrams(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged(rows)
        shard = int(rows["shard"].iloc[0])
        write_keys(f"{folder}/trigrams/{shard}", keys)
        write_counts(f"{folder}/trigrams/{shard}", n)
        table = pair_table()
        head = (keys >> _SHIFT).astype(np.int64)
        first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]][:len(head)])
        per = np.stack([np.add.reduceat(x, first) for x in (n == 1, n == 2, n >= 3)], axis=1)
        middle = table.last_words((keys >> _SHIFT).astype(np.int64))
        ends = table.places((middle << _SHIFT) | (keys & _LOW)).astype(np.uint64)
        ends, of_end = summed(ends, np.ones(len(ends), np.int64))
        out = []
        for kind, places, numbers in (("ending", ends, of_end[:, None]),
                                      ("follow", head[first].astype(np.uint64), per)):
            cut = np.searchsorted(places, table.base.astype(np.uint64))
            out += [{"part": s, "kind": kind, "places": sealed(packed(places[a:b])),
                     "numbers": sealed(planes(
                         np.ascontiguousarray(numbers[a:b].astype(np.uint64)).ravel()))}
                    for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        out.append({"part": -1, "kind": f"{shard}:{len(keys)}", "places": b"",
                    "numbers": sealed(planes(np.array(count_of_counts(n), np.uint64)))})
        return pd.DataFrame(out)

    def merge_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        if part < 0:  # totals go on as they are, one shard below the others
            return rows.assign(part=-2)
        table = pair_table()
        keys = np.asarray(table.parts[part])
        followed = np.zeros(len(keys), np.int64)
        behind = np.zeros((len(keys), 3), np.int64)
        for kind, places, numbers in zip(rows["kind"], rows["places"], rows["numbers"]):
            if kind in ("ending", "follow"):
                at = unpacked(opened(places)).astype(np.int64) - table.base[part]
                values = unplaned(opened(numbers), np.uint64).astype(np.int64)
                if kind == "ending":
                    followed[at] += values
                else:
                    behind[at] += values.reshape(-1, 3)
        write_followers(f"{folder}/pairs/{part}", behind)
        at = np.flatnonzero((keys >> _SHIFT) == np.uint64(begin))
        raw = Counts(f"{folder}/bigrams", f"{folder}/bigrams", splitters, bigrams)
        followed[at] = raw.values(part, at)
        write_counts(f"{folder}/pairs/{part}", followed)
        out = by_context(keys, followed)
        out.append({"part": -1, "kind": "", "places": b"",
                    "numbers": sealed(planes(np.array(count_of_counts(followed), np.uint64)))})
        return pd.DataFrame(out)

    def merge_heads(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        if part < 0:
            n = np.sum([unplaned(opened(b), np.uint64) for b in rows["numbers"]], axis=0, dtype=np.int64)
            return pd.DataFrame({"part": [part], "counts": [n.tolist()],
                                 "sizes": [",".join(sorted(rows["kind"]))]})
        per = np.zeros((int(sizes[part]) + 1, 4), np.int64)
        for places, numbers in zip(rows["places"], rows["numbers"]):
            at = unpacked(opened(places)).astype(np.int64) - base[part]
            per[at] += unplaned(opened(numbers), np.uint64).astype(np.int64).reshape(-1, 4)
        write_array(f"{folder}/heads/{part}.npy", narrow(per))
        return pd.DataFrame({"part": [part], "counts": [[0] * 4], "sizes": [""]})

    blobs = "part int, kind string, places binary, numbers binary"
    every = spark.createDataFrame([(s, "none", b"", b"") for s, n in enumerate(bigrams) if n], blobs)
    ended = {r.part: r for r in (
        texts.mapInArrow(count_trigrams, BLOBS).groupBy("shard")
        .applyInPandas(merge_trigrams, blobs).unionByName(every).groupBy("part")
        .applyInPandas(merge_pairs, blobs).groupBy("part")
        .applyInPandas(merge_heads, "part int, counts array<long>, sizes string").collect())}
    in_shard = dict(x.split(":") for x in ended[-2].sizes.split(",")) if -2 in ended else {}
    trigrams = tuple(int(in_shard.get(str(s), 0)) for s in range(len(triple_splitters) + 1))
    return BigramModel(
        folder, sizes, splitters, bigrams, total,
        (lowest, discounts_of(np.array(ended[-1].counts)),
         discounts_of(np.array(ended[-2].counts if -2 in ended else [0] * 4))),
        of_count, trigrams, triple_splitters)


class Scorer:
    """The mapped arrays of a model."""

    def __init__(self, model: BigramModel):
        self.model = model
        self.table = WordTable(model.folder, model.sizes)
        folder = model.folder

        def parts(name: str) -> list[np.ndarray]:
            paths = [f"{folder}/{name.format(s)}.npy" for s in range(len(model.sizes))]
            return [mapped(p) if os.path.exists(p) else None for p in paths]

        self.counts, self.endings = parts("words/{}.count"), parts("endings/{}")
        whole = model.trigram_splitters is None
        self.contexts = parts("contexts/{}" if whole else "heads/{}")
        self.bigrams = Counts(f"{folder}/bigrams", f"{folder}/{'bigrams' if whole else 'pairs'}",
                              model.splitters, model.bigrams)
        self.pairs = self.trigrams = None
        if not whole:
            self.pairs = PairTable(folder, model.splitters, model.bigrams)
            self.trigrams = Counts(f"{folder}/trigrams", f"{folder}/trigrams",
                                   model.trigram_splitters, model.trigrams, short=True)
            raw = Counts(f"{folder}/bigrams", f"{folder}/bigrams", model.splitters, model.bigrams)
            self.followers = Followers(folder, self.pairs, raw)
        self.distinct = sum(model.bigrams)

    def at(self, parts: list[np.ndarray], places: np.ndarray, width: int = 1) -> np.ndarray:
        """Values at sorted places; those of -1 are 0. The beginning of texts is the last place."""
        base = self.table.base
        out = np.zeros((len(places), width), np.int64)
        cut = np.searchsorted(places, base)
        cut[-1] = len(places)
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a and parts[s] is not None:
                out[a:b] = parts[s][places[a:b] - base[s]].reshape(b - a, width)
                let_go(parts[s])
        return out

    def log10(self, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token: log10 probability, its training count, log10 of the smoothed frequency."""
        model, vocabulary = self.model, self.model.words + 1
        places = self.table.places(tokens)
        own, back = np.unique(places, return_inverse=True)
        count = self.at(self.counts, own)[:, 0]
        total = model.train_tokens
        base = np.log10((count + 0.5) / (total + 0.5 * vocabulary))
        d = model.discounts[0]
        if self.distinct:
            mass = float(np.dot(d, model.of_count)) / self.distinct
            lower = discounted(self.at(self.endings, own)[:, 0], d) / self.distinct
            lower = lower + mass / vocabulary
        else:
            lower = np.full(len(own), 1 / vocabulary)
        before = contexts(places, n, model.words)
        known = (before >= 0) & (places >= 0)
        keys = np.where(known, (before << 32) | places, 0).astype(np.uint64)
        pairs, to_pair = np.unique(keys[known], return_inverse=True)
        seen = np.zeros(len(places), np.int64)
        seen[known] = self.bigrams.of(pairs)[to_pair]
        # Contexts are the batch's words, which are sorted already, and the beginning of texts.
        to_head = contexts(back, n, len(own))
        per = self.at(self.contexts, np.append(own, model.words), 4)
        d = model.discounts[1]
        size = np.maximum(per[:, 0], 1)
        rest = np.where(per[:, 0] > 0, per[:, 1:] @ np.asarray(d) / size, 1.0)
        chance = discounted(seen, d) / size[to_head] + rest[to_head] * lower[back]
        if self.trigrams is not None:
            place = self.pairs.sorted_places(pairs)
            seen_pair = place >= 0
            pair, nth = (np.full(len(places), -1, np.int64) for _ in range(2))
            pair[known], nth[known] = place[to_pair], (np.cumsum(seen_pair) - 1)[to_pair]
            head = contexts(pair, n, -1)
            has = head >= 0
            to_head = contexts(nth, n, -1)[has]  # the batch's pairs, which are sorted already
            per, d = self.followers.of(place[seen_pair]), model.discounts[2]
            size = np.maximum(per[:, 0], 1)
            rest = np.where(per[:, 0] > 0, per[:, 1:] @ np.asarray(d) / size, 1.0)
            seen, both = np.zeros(len(places), np.int64), has & (places >= 0)
            triples, to_triple = np.unique(
                ((head[both] << 32) | places[both]).astype(np.uint64), return_inverse=True)
            seen[both] = self.trigrams.of(triples)[to_triple]
            chance[has] = (discounted(seen[has], d) / size[to_head]
                           + rest[to_head] * chance[has])
        return np.log10(chance), count[back], base[back]


def scored(docs: DataFrame, model: BigramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    A null text is an empty one, whose only token is the end. Words that training did not see
    share one place of the vocabulary. With no training texts at all every token has the same
    probability. Repeated rows get the same scores; further columns are ignored.
    """
    plain = texts_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held("scorer", model.folder, lambda: Scorer(model))
        for batch in batches:
            for first, last, tokens, n in tokens_of(batch):
                logs, counts, base = scorer.log10(tokens, n)
                start = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(n),
                     pa.array(np.add.reduceat((counts > 0).astype(np.int64), start)),
                     pa.array(np.full(len(n), model.train_tokens, np.int64)),
                     pa.array(np.add.reduceat(base, start)),
                     pa.array(np.add.reduceat(logs, start))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
