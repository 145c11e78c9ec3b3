"""Toxicity by noisy-channel deobfuscation.

Spans that are no plain words (leetspeak, letters set apart, letters repeated) become lattices of
the letters that may have been meant, and words cut by spaces are joined. A Viterbi pass under a character trigram model picks the most
likely reading, and the restored words are scored together with the plain ones.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import partitions_of, stored, texts_of
from tabprobe.llm.language_model import WordTable
from tabprobe.llm.letters import Words, found_in, frame, text_chunks
from tabprobe.llm.pieces import LETTER, SPACE, mixed, powers
from tabprobe.llm.token_counts import held
from tabprobe.llm.tokens import let_go, mapped, mounted_folder, write_array

#: fixed values: letters that a sign may stand for
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = " .-_*/'~,"
#: Signs of LEET that may also be punctuation beside a word.
MARKS = "@$!|+€("
#: Log costs of the channel: a sign read as a letter, one left out, a separator left out, and a
#: letter left out that repeats the one before (the second of a run, a later one).
AS_LETTER, NO_LETTER, NO_SEPARATOR, REPEATED, REPEATED_AGAIN = -1.0, -7.0, -0.3, -3.0, -0.2

#: Log cost of a space put into a word, and into how many parts a word may be cut.
CUT, MOST_PARTS = -7.0, 4

ALPHABET = 0x250  # code points of Latin letters lie below
PREFIXES = (4, 5, 6, 7)
#: Min-hashes by which near copies are told: those that share SHARED of them.
MIN_HASHES, SHARED = 6, 3
BORDER = 0
#: Different words in a mapped shard of their counts.
SHARD_WORDS = 500_000
#: Bits a word, and two to this power at most (32 MB), of the filter before a search for words.
FILTER_BITS, MOST_FILTER_BITS = 8, 28
_SIGNS = np.zeros(0x110000, np.uint8)  # 1: a sign of LEET, 2: one of MARKS
_SIGNS[[ord(x) for x in LEET]] = 1
_SIGNS[[ord(x) for x in MARKS]] = 2


class WordCounts(WordTable):
    """Mapped counts of words, by the place of the word's hash."""

    def __init__(self, folder: str, sizes: tuple[int, ...]):
        super().__init__(folder, sizes)
        self.counts = [mapped(f"{folder}/words/{s}.count.npy") if n else None
                       for s, n in enumerate(sizes)]
        bits = min(max((FILTER_BITS * sum(sizes)).bit_length(), 16), MOST_FILTER_BITS)
        self._shift, self._bytes = np.uint64(64 - bits), 1 << bits - 3

    @cached_property
    def _filter(self) -> np.ndarray:
        """A bit for each range of hashes, set if there is a word in it."""
        out = np.zeros(self._bytes, np.uint8)
        for part in self.parts:
            at = (part >> self._shift).astype(np.int64)  # sorted
            if len(at):
                first, last = int(at[0]) >> 3, int(at[-1]) >> 3
                found = np.zeros((last - first + 1) * 8, bool)
                found[at - first * 8] = True
                out[first:last + 1] |= np.packbits(found, bitorder="little")
                let_go(part)
        return out

    def perhaps(self, hashes: np.ndarray) -> np.ndarray:
        """False only where a hash is unknown; it need not be so wherever one is."""
        at = hashes >> self._shift
        return self._filter[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each hash; 0 for an unknown one."""
        wanted, back = np.unique(self.places(hashes), return_inverse=True)
        out = np.zeros(len(wanted))
        cut = np.searchsorted(wanted, self.base)
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                out[a:b] = self.counts[s][wanted[a:b] - self.base[s]]
                let_go(self.counts[s])
        return out[back]


@dataclass(frozen=True)
class Vocabulary:
    """Where the counts of words lie in the shared folder; small enough to be sent to tasks."""

    folder: str
    sizes: tuple[int, ...]  # words in each shard
    total: int              # sum of all counts

    def _held(self) -> WordCounts:
        return held("vocabulary", self.folder, lambda: WordCounts(self.folder, self.sizes))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self._held().of(hashes)

    def perhaps(self, hashes: np.ndarray) -> np.ndarray:
        return self._held().perhaps(hashes)


@dataclass(frozen=True)
class CharacterModel:
    """Interpolated trigram log probabilities of letters, with BORDER around words; words' counts."""

    index: dict[str, int]
    logs: np.ndarray  # [before, before that one's right neighbour, letter]
    words: Vocabulary | None = None

    @staticmethod
    def of(trigrams: np.ndarray, counts: np.ndarray, letters: list[int]) -> "CharacterModel":
        c = trigrams % ALPHABET
        place = np.full(ALPHABET, -1)
        place[[BORDER, *letters]] = range(len(letters) + 1)
        size = len(letters) + 1
        a, b = place[trigrams // ALPHABET**2], place[trigrams // ALPHABET % ALPHABET]
        c = place[c]
        keep = (a >= 0) & (b >= 0) & (c >= 0)
        n3 = np.zeros((size, size, size))
        np.add.at(n3, (a[keep], b[keep], c[keep]), counts[keep])
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1 + 1).sum()
        p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
        return CharacterModel({chr(x): i + 1 for i, x in enumerate(letters)}, np.log(p3))

    @cached_property
    def _rows(self) -> list[list[list[float]]]:
        return self.logs.tolist()  # single numbers are read faster from lists than from arrays

    @cached_property
    def _read(self) -> dict[str, tuple]:
        return {}  # what _readings has said

    def _readings(self, char: str) -> tuple[list[tuple[str, int]], float, float | None, bool]:
        """Letters that may be meant and their places, the cost of one, that of leaving the sign
        out (None for a letter), and whether a second one like it may be left out."""
        letters, cost, skip = char, 0.0, None
        if char in LEET:
            letters, cost, skip = LEET[char], AS_LETTER, NO_LETTER
        elif char in SEPARATORS:
            letters, skip = "", NO_SEPARATOR
        elif char not in self.index:
            letters, skip = "", NO_LETTER
        return [(x, self.index[x]) for x in letters if x in self.index], cost, skip, bool(letters)

    def decode(self, span: str) -> str:
        """The most likely letters behind a span; ties go to the first reading by the alphabet."""
        best = {(BORDER, BORDER): (0.0, "")}
        logs, read = self._rows, self._read
        before, run = "", 0
        for char in span:
            run = run + 1 if char == before else 1
            before = char
            if char not in read:
                read[char] = self._readings(char)
            letters, cost, skip, repeats = read[char]
            if run > 1 and repeats:
                skip = REPEATED if run == 2 else REPEATED_AGAIN
            if skip is None and len(best) == 1:  # one state and, without a skip, one letter
                ((a, b), (score, word)), = best.items()
                (x, place), = letters
                best = {(b, place): (score + cost + logs[a][b][place], word + x)}
                continue
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, word) in best.items():
                row = logs[a][b]
                options = [(score + cost + row[place], word + x, (b, place)) for x, place in letters]
                if skip is not None:
                    options.append((score + skip, word, (a, b)))
                for new, text, state in options:
                    old = step.get(state)
                    if old is None or new > old[0] or new == old[0] and text < old[1]:
                        step[state] = (new, text)
            best = step
        ended = [(score + logs[a][b][BORDER], word) for (a, b), (score, word) in best.items()]
        return min(ended, key=lambda x: (-x[0], x[1]))[1]


def disguised(texts: list[str]) -> list[list[str]]:
    """The spans (disguises) of each lower-cased text."""
    out: list[list[str]] = [[] for _ in texts]
    words = Words(texts)
    for text, a, b in zip(*disguises(words)):
        out[text].append(words.whole[a:b])
    return out


def disguises(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the spans of some texts that have more than one reading.

    Between white space, without what is neither a letter nor a sign of LEET at the edges: those
    with a letter and either anything else or a letter twice in a row; once more without MARKS at
    the edges, as they may be punctuation. Across white space: three or more single characters one
    after the other, with punctuation behind them or not.
    """
    codes, kinds, edge, n = words.codes, words.kinds, words.edge, len(words.codes)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = kinds != SPACE
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:n]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    if not len(starts):
        return starts, starts, starts

    def sums(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total

    def within(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of a flag in each run, as a span; an empty one if there is none."""
        total, places = sums(flags), np.append(np.flatnonzero(flags), 0)
        first, last = total[starts], total[ends]
        has = last > first
        return np.where(has, places[first], starts), np.where(has, places[last - 1] + 1, starts)

    letter = kinds == LETTER
    sign = _SIGNS[codes]
    double = np.zeros(n, bool)
    double[1:] = letter[1:] & (codes[1:] == codes[:-1]) & ~edge[1:n]
    letters, doubles = sums(letter), sums(double)
    of = np.searchsorted(words.bounds, starts, side="right") - 1
    outer, inner = within(letter | (sign > 0)), within(letter | (sign == 1))
    found = []
    for k, (a, b) in enumerate((outer, inner)):
        n_letters = letters[b] - letters[a]
        odd = (n_letters > 0) & ((n_letters < b - a) | (doubles[b] - doubles[a] > 0))
        if k:
            odd &= (a != outer[0]) | (b != outer[1])
        found.append((of[odd], a[odd], b[odd]))
    few = inner[1] - inner[0] == 1
    single = (outer[1] - outer[0] == 1) | few
    stop = np.where(few, inner[1], outer[1])
    joined = single[1:] & single[:-1] & (of[1:] == of[:-1])
    first = np.flatnonzero(single & ~np.r_[False, joined])
    final = np.flatnonzero(single & ~np.r_[joined, False])
    long = final - first >= 2
    first, final = first[long], final[long]
    found.append((of[first], starts[first], stop[final]))
    return tuple(np.concatenate(x) for x in zip(*found))


def cut_words(words: Words, model: CharacterModel) -> list[tuple[int, str]]:
    """Text and reading of the words that single spaces cut into up to MOST_PARTS parts.

    A known word is read across the spaces if it and the spaces put into it are likelier than the
    parts as words of their own (half a count for an unknown one).
    """
    out: list[tuple[int, str]] = []
    if model.words is None or not model.words.total or not len(words.starts):
        return out
    total = np.log(model.words.total)
    one, back = words.different
    times = model.words.counts(words.hashes(words.starts[one], words.ends[one]))
    own = np.log(np.maximum(times, 0.5))[back]
    raw, size = words.raw(words.starts, words.ends), words.ends - words.starts
    spaced = np.r_[(words.starts[1:] - words.ends[:-1] == 1) & (words.of[1:] == words.of[:-1]),
                   False]
    spaced[:-1] &= words.kinds[words.ends[:-1]] == SPACE
    ups = powers(len(words.codes) + 1)[0]
    at = np.arange(len(raw))
    joint, length = raw, size
    for part in range(1, MOST_PARTS):
        go = spaced[at + part - 1]
        at, joint, length = at[go], joint[go], length[go]
        joint = joint + raw[at + part] * ups[length]
        length = length + size[at + part]
        hashes = mixed(joint)
        likely = np.flatnonzero(model.words.perhaps(hashes))
        times, first = model.words.counts(hashes[likely]), at[likely]
        apart = own[first]
        for more in range(1, part + 1):
            apart = apart + own[first + more]
        good = (times > 0) & (np.log(np.maximum(times, 1)) + part * (total + CUT) > apart)
        for i in first[good].tolist():
            out.append((int(words.of[i]), "".join(
                words.whole[words.starts[j]:words.ends[j]] for j in range(i, i + part + 1))))
    return out


class Restorer:
    """Readings of the disguised spans of texts; remembers some of them."""

    def __init__(self, model: CharacterModel, most: int = 100_000):
        self.model, self.most = model, most
        self.known: OrderedDict[str, str] = OrderedDict()

    def readings(self, words: Words) -> dict[int, list[str]]:
        """What may have been meant besides, by the place of the text."""
        out: dict[int, list[str]] = {}
        for text, read in cut_words(words, self.model):
            out.setdefault(text, []).append(read)
        known, whole = self.known, words.whole
        for text, a, b in zip(*(x.tolist() for x in disguises(words))):
            span = whole[a:b]
            read = known.get(span)
            if read is None:
                if len(known) >= self.most:
                    known.popitem(last=False)
                read = known[span] = self.model.decode(span)
            if read != span:
                out.setdefault(text, []).append(read)
        return out

    def words(self, texts: list[str | None]) -> tuple[Words, Words]:
        """Words of the texts, and of the readings of each."""
        plain = Words([t or "" for t in texts])
        found = self.readings(plain)
        read = Words([" ".join(x) for x in found.values()])
        read.of, read.rows = np.fromiter(found, np.int64, len(found))[read.of], plain.rows
        return plain, read

    def __call__(self, texts: list[str | None]) -> list[str]:
        """Lower-cased texts with the readings behind them."""
        words = Words([t or "" for t in texts])
        found, bounds = self.readings(words), words.bounds.tolist()
        return [" ".join([words.whole[a:b], *found.get(i, ())])
                for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each different word and of each one's first letters, and which word has it."""
    one, _ = words.different
    starts, ends = words.starts[one], words.ends[one]
    keys, of = [words.hashes(starts, ends)], [np.arange(len(one))]
    for length in PREFIXES:
        long = np.flatnonzero(ends - starts >= length)
        keys.append(words.hashes(starts[long], starts[long] + length) ^ np.uint64(length))
        of.append(long)
    return np.concatenate(keys), np.concatenate(of)


def spread(words: Words, of: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and mark for every text that has a different word (`of`) with a mark."""
    one, back = words.different
    order = np.argsort(of, kind="stable")
    marks, n = marks[order], np.bincount(of, minlength=len(one))
    first = np.cumsum(n) - n
    some = (n > 0)[back]
    own = once(words.of[some] * max(len(one), 1) + back[some])
    text, word = np.divmod(own, max(len(one), 1))
    times = n[word]
    at = np.repeat(first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return np.repeat(text, times), marks[at]


def once(values: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]][:len(values)]]


def min_hashes(texts: list[str]) -> np.ndarray:
    """Smallest hashes of each text's words and pairs of words under MIN_HASHES orders."""
    words = Words(texts)
    keys = words.hashes(words.starts, words.ends)
    keys[1:] += keys[:-1] * np.uint64(3)
    out = np.zeros((len(texts), MIN_HASHES), np.uint64)
    first = np.searchsorted(words.of, np.arange(len(texts)))
    some = np.bincount(words.of, minlength=len(texts)) > 0
    for j in range(MIN_HASHES if some.any() else 0):
        own = mixed(keys + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        out[some, j] = np.minimum.reduceat(own, first[some])
    return out


def unlike(hashes: DataFrame) -> DataFrame:
    """doc_id of the rows (doc_id, h0, h1, ...) that share fewer than SHARED min-hashes with any
    row of a smaller doc_id that is kept.

    Equal rows are one. Rows that share a key (SHARED min-hashes) are decided in rounds: the first
    of all its keys is kept, and what shares a key with it is not; the others wait for the next.
    """
    names = [f"h{j}" for j in range(MIN_HASHES)]
    node = ["doc_id", "code"]
    rows = stored(hashes.groupBy(*names).agg(F.min("doc_id").alias("doc_id"))
                  .withColumn("code", F.xxhash64(*names)), "min-hashes")
    keys = rows.select(*node, F.explode(F.array(*(
        F.xxhash64(F.lit(i), *own) for i, own in enumerate(combinations(names, SHARED)))))
        .alias("key"))
    common = keys.groupBy("key").count().filter("count > 1")
    waiting = stored(keys.join(common, "key", "left_semi"), "near-copies")
    kept = rows.select(*node).join(waiting.select(*node).distinct(), node, "left_anti")
    while not waiting.isEmpty():
        first = waiting.groupBy("key").agg(F.min(F.struct(*node)).alias("first"))
        marked = waiting.join(first, "key").select(*node, "first")
        ahead = stored(marked.groupBy(*node).agg(
            F.min(F.col("first") == F.struct(*node)).alias("ahead")).filter("ahead").drop("ahead"),
            "near-copies")
        done = marked.join(ahead.select(F.struct(*node).alias("first")), "first", "left_semi")
        waiting = stored(waiting.join(done.select(*node).distinct(), node, "left_anti"),
                         "near-copies")
        kept = kept.unionByName(ahead)
    return kept.select("doc_id").distinct()


def signs_of(n1: np.ndarray, n0: np.ndarray, times: np.ndarray, share: float) -> np.ndarray:
    """Chance that a feature is a sign of label 1, from how many texts of either label have it.

    Of all features (`times` have these counts) an unknown part are signs, of which any share
    above `share` of texts has label 1; the others have label 1 as often as all training
    texts. That part is found by expectation maximization, so what passes follows from the
    number of features and of labels.
    """
    n = n1 + n0
    logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, n.max(initial=0) + 2)))]

    def chance(k: np.ndarray, n: int) -> np.ndarray:
        return np.exp(logs[n] - logs[k] - logs[n - k] + k * np.log(share)
                      + (n - k) * np.log1p(-share))

    def up_to(a: int, n: int) -> float:
        """Chance of at most a; what lies 40 deviations off the mean, or off a, adds nothing."""
        reach = 40 * np.sqrt(n * share * (1 - share)) + 50
        return chance(np.arange(max(int(min(a, n * share) - reach), 0),
                                min(a, int(n * share + reach) + 1) + 1), n).sum()

    above = np.array([up_to(a, b + 1) for a, b in zip(n1, n)])
    plain = np.array([chance(np.array([a]), b)[0] for a, b in zip(n1, n)])
    with np.errstate(divide="ignore"):
        ratio = np.exp(np.clip(np.log(above) - np.log((n + 1) * (1 - share)) - np.log(plain),
                               -500, 500))
    part = 0.01
    for _ in range(200):
        signs = part * ratio / (part * ratio + 1 - part)
        part = min(max(np.dot(signs, times) / times.sum(), 1e-12), 0.5)
    return signs


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    keys: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)
    without: float = 0.0  # score of a text without evidence

    def evidence(self, parts: tuple[Words, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of the different known features of each text's words, of all parts,
        and its number of words."""
        size, rows = max(len(self.keys), 1), parts[0].rows
        pairs = []
        for words in parts:
            keys, of = features(words)
            places, known = found_in(self.keys, keys)
            text, place = spread(words, of[known], places[known])
            pairs.append(text * size + place)
        pairs = once(np.concatenate(pairs))
        n = sum(np.bincount(words.of, minlength=rows) for words in parts)
        return np.bincount(pairs // size, weights=self.weights[pairs % size],
                           minlength=rows).astype(float), n

    def scores(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        curve = np.clip(a * np.log1p(evidence) + b * np.log1p(n) + c, -30, 30)
        return np.where(evidence > 0, np.maximum(1 / (1 + np.exp(-curve)), self.without),
                        self.without)


def fitted(seen: DataFrame) -> tuple[tuple[float, float, float], float]:
    """A logistic curve over the logs of evidence and words, where there is evidence (ridge of
    0.01), and the share of label 1 where there is none, below 0.5.

    `seen` has evidence, n and toxic of every training text. Each of Newton's steps sums up the
    slope and the curvature in Spark, in decimals, so that the order of the rows does not matter.
    """
    none = seen.filter("evidence = 0").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    without = min(((none.n1 or 0) + 0.5) / (none.n + 1), 0.49)
    x = [F.log1p("evidence"), F.log1p("n"), F.lit(1.0)]
    some = seen.filter("evidence > 0").select("toxic", *(c.alias(f"x{k}") for k, c in enumerate(x)))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]

    def total(value):
        return F.sum(value.cast("decimal(30,18)"))

    w = np.zeros(3)
    for _ in range(30):
        line = sum((F.lit(float(v)) * F.col(f"x{k}") for k, v in enumerate(w)), F.lit(0.0))
        line = F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))
        sums = some.withColumn("p", 1 / (1 + F.exp(-line))).agg(
            *(total((F.col("toxic") - F.col("p")) * F.col(f"x{k}")) for k in range(3)),
            *(total(F.col(f"x{i}") * F.col(f"x{j}") * F.col("p") * (1 - F.col("p")))
              for i, j in pairs)).first()
        sums = [float(v or 0) for v in sums]
        curve = 0.01 * np.eye(3)
        for (i, j), v in zip(pairs, sums[3:]):
            curve[i, j] += v
            curve[j, i] = curve[i, j]
        step = np.linalg.solve(curve, np.array(sums[:3]) - 0.01 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w), float(without)


def vocabulary(words: DataFrame) -> Vocabulary:
    """Writes the counts of `words` (word: hash, n) to the shared folder, in shards of hashes."""
    spark = words.sparkSession
    words = stored(words, "word-counts")
    shards = max(partitions_of(spark), -(-words.count() // SHARD_WORDS))
    folder = mounted_folder(spark, "vocabulary")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        keys, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        write_array(f"{folder}/words/{shard}.npy", keys[order])
        write_array(f"{folder}/words/{shard}.count.npy", n[order])
        return pd.DataFrame({"shard": [shard], "size": [len(keys)], "total": [int(n.sum())]})

    # the same ranges as shard_of
    shard = F.shiftright(F.shiftrightunsigned("word", 32) * shards, 32).cast("int")
    found = (words.withColumn("shard", shard).groupBy("shard")
             .applyInPandas(write, "shard int, size long, total long").collect())
    size_of = {r.shard: r["size"] for r in found}
    return Vocabulary(folder, tuple(size_of.get(s, 0) for s in range(shards)),
                      sum(r.total for r in found))


def chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `texts` (doc_id, text) whose doc_id `ids` (doc_id, toxic; once each) has, and
    toxic.

    Texts are not shuffled: the ids lie in mapped files, by their hashes, which for one 64-bit
    number are one to one.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"))
    marks = vocabulary(ids.filter("doc_id is not null").select(
        key.alias("word"), (F.col("toxic") + 1).cast("long").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("word").to_numpy(zero_copy_only=False).astype(np.int64)
            found = marks.counts(hashes.view(np.uint64)).astype(np.int32)
            own = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("text").take(own),
                 pa.array(found[found > 0] - 1, pa.int32())], names=["doc_id", "text", "toxic"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return (texts.filter("doc_id is not null").withColumn("word", key)
            .mapInArrow(run, f"doc_id {kind}, text string, toxic int"))


def train(labelled: DataFrame, docs: DataFrame, most_letters: int = 80,
          most_features: int = 50_000) -> ToxicityModel | None:
    """Fits on all of `labelled` (doc_id, toxic 0 or 1); None if a class is missing.

    Near copies count once (else the words of a text with many copies would look like signs of its
    label). The character model counts the letters (the `most_letters` most frequent ones) and all
    words of the texts. A feature's weight is its log odds of being in a toxic text times the
    chance that it is a sign (signs_of); kept are those that are rather signs than not, the
    `most_features` strongest (ties: smaller hash). What comes to the driver is bounded by letters,
    by different pairs of counts and by features, not by texts.
    """
    ids = (labelled.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id")
           .agg(F.max("toxic").alias("toxic")))
    texts = stored(chosen(texts_of(docs), ids), "labelled-texts")
    hashes = texts.mapInArrow(
        lambda batches: (frame({"doc_id": np.array(part.column("doc_id").to_pylist(), np.int64)} | {
            f"h{j}": h for j, h in enumerate(min_hashes(texts).view(np.int64).T)})
            for part, texts in text_chunks(batches)),
        "doc_id long, " + ", ".join(f"h{j} long" for j in range(MIN_HASHES)))
    alone = unlike(hashes).join(ids, "doc_id")
    sample = stored(chosen(texts.drop("toxic"), alone), "unlike-texts")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return None

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            words = Words(texts)
            codes = np.r_[words.codes, 0].astype(np.int64)
            size = words.ends - words.starts
            at = np.repeat(words.starts - (np.cumsum(size + 1) - size - 1), size + 1)
            at = at + np.arange((size + 1).sum())
            begin, end = np.repeat(words.starts, size + 1), np.repeat(words.ends, size + 1)
            c = np.where(at < end, codes[at], BORDER)
            b = np.where(at - 1 >= begin, codes[at - 1], BORDER)
            a = np.where(at - 2 >= begin, codes[at - 2], BORDER)
            good = (c < ALPHABET) & (b < ALPHABET) & (a < ALPHABET)
            keys, n = np.unique((a[good] * ALPHABET + b[good]) * ALPHABET + c[good],
                                return_counts=True)
            yield frame({"trigram": keys, "n": n.astype(np.int64)})

    grams = stored(sample.mapInArrow(trigrams, "trigram long, n long").groupBy("trigram")
                   .agg(F.sum("n").alias("n")), "letter-trigrams")
    letter = F.col("trigram") % ALPHABET
    letters = [r.letter for r in grams.filter(letter != BORDER).groupBy(letter.alias("letter"))
               .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(most_letters)
               .collect()]
    places = [letter, F.expr(f"trigram div {ALPHABET} % {ALPHABET}"),
              F.expr(f"trigram div {ALPHABET ** 2}")]
    grams = grams.filter(
        places[0].isin(BORDER, *letters) & places[1].isin(BORDER, *letters)
        & places[2].isin(BORDER, *letters)).toArrow().to_pandas()
    characters = CharacterModel.of(grams["trigram"].to_numpy(np.int64),
                                   grams["n"].to_numpy(float), letters)

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            words = Words(texts)
            keys, n = np.unique(words.hashes(words.starts, words.ends), return_counts=True)
            yield frame({"word": keys.view(np.int64), "n": n.astype(np.int64)})

    characters = replace(characters, words=vocabulary(
        sample.mapInArrow(own_words, "word long, n long").groupBy("word")
        .agg(F.sum("n").alias("n"))))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(characters)
        for part, texts in text_chunks(batches):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = restore.words(texts)
            found = [features(words) for words in parts]
            number, own = pd.factorize(np.concatenate([keys for keys, _ in found]))
            numbers = np.split(number, [len(found[0][0])])
            pairs = [spread(words, of, own_numbers)
                     for words, (_, of), own_numbers in zip(parts, found, numbers)]
            pairs = once(np.concatenate([mark * len(texts) + text for text, mark in pairs]))
            mark, text = np.divmod(pairs, len(texts))
            n1 = np.bincount(mark, weights=toxic[text], minlength=len(own)).astype(np.int64)
            n = np.bincount(mark, minlength=len(own)).astype(np.int64)
            yield frame({"key": own.view(np.int64), "n1": n1, "n0": n - n1})

    counted = stored(
        sample.mapInArrow(present, "key long, n1 long, n0 long").groupBy("key")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter("n1 + n0 > 1"), "features")
    kinds = (counted.groupBy("n1", "n0").agg(F.count("*").alias("times")).toArrow().to_pandas()
             .sort_values(["n1", "n0"]))
    n1, n0, times = (kinds[x].to_numpy(np.int64) for x in ("n1", "n0", "times"))
    t, c = totals[1], totals[0]
    weight = signs = np.zeros(0)
    if len(kinds):
        signs = signs_of(n1, n0, times, t / (t + c))
        weight = signs * (np.log((n1 + 0.5) / (t + 1)) - np.log((n0 + 0.5) / (c + 1)))
    kept = [(int(a), int(b), float(w)) for a, b, w, x in zip(n1, n0, weight, signs)
            if w > 0 and x >= 0.5]
    kept = docs.sparkSession.createDataFrame(kept, "n1 long, n0 long, weight double")
    rows = (counted.join(F.broadcast(kept), ["n1", "n0"])
            .orderBy(F.desc("weight"), "key").limit(most_features).toArrow().to_pandas())
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = ToxicityModel(characters, keys[order], rows["weight"].to_numpy(float)[order])

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(characters)
        for part, texts in text_chunks(batches):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            found, n = model.evidence(restore.words(texts))
            yield frame({"evidence": found, "n": n, "toxic": toxic})

    seen = stored(sample.mapInArrow(evidence, "evidence double, n long, toxic long"), "evidence")
    curve, without = fitted(seen)
    return ToxicityModel(model.characters, model.keys, model.weights, curve, without)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of each whole text.

    A null text is an empty one; it and any text without known features get the lowest score.
    Without a model (no labels of one class) every score is 0. Repeated rows get the same score;
    further columns are ignored.
    """
    plain = texts_of(docs)
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(sent.value.characters)
        for part, texts in text_chunks(batches):
            found = sent.value.scores(*sent.value.evidence(restore.words(texts)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found),
                 pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
