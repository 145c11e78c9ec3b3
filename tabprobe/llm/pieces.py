"""Pieces that a byte-level BPE tokenizer splits text into, found with array operations.

The splitting pattern of these tokenizers takes, at each place, the first of: an English
contraction ('s 't 're 've 'm 'll 'd), letters, digits or other marks (each with one space before,
if there is one), white space. White space before anything else leaves its last character over,
which is a piece of its own unless it is that one space.
"""

from __future__ import annotations

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
BLANK, APOSTROPHE = ord(" "), ord("'")
#: fixed values: endings of contractions that are pieces
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_MIX = np.uint64(0xD6E8FEB86659FD93)
_state: dict = {}


def _classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _state:
        kinds = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            kinds[[ord(x) for x in regex.findall(pattern, every)]] = kind
        _state["classes"] = kinds
    return _state["classes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, n of each."""
    if len(_state.get("powers", ())) < n:
        size = max(n, 1 << 16)
        ups = np.full(size, _STEP, np.uint64)
        downs = np.full(size, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
        ups[0] = downs[0] = 1
        _state["powers"] = np.multiply.accumulate(ups)
        _state["inverse"] = np.multiply.accumulate(downs)
    return _state["powers"][:n], _state["inverse"][:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value; keeps different values different."""
    values = values * _MIX
    values ^= values >> np.uint64(32)
    values *= _STEP
    values ^= values >> np.uint64(29)
    return values


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of `values`, alike wherever a span lies."""
    ups, downs = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ups[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * downs[starts])


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts end to end, starts and ends of the pieces, and each one's text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    if not n:
        none = np.zeros(0, np.int64)
        return codes, none, none, none
    kinds = _classes()[codes]
    edge = np.zeros(n + 1, bool)  # where a text begins or ends
    edge[bounds] = True
    new = edge[:n].copy()
    new[1:] |= kinds[1:] != kinds[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    kind = kinds[first]
    begins = np.zeros(n + 1, bool)
    solid = first[kind != SPACE]
    after_blank = ~edge[solid] & (codes[solid - 1] == BLANK)
    begins[solid - after_blank] = True
    gap, gap_end = first[kind == SPACE], last[kind == SPACE]
    final, blank = edge[gap_end], codes[gap_end - 1] == BLANK
    begins[gap[(gap_end - gap >= 2) | final | ~blank]] = True
    begins[gap_end[~final & ~blank] - 1] = True
    mark = np.flatnonzero((kind == OTHER) & (last - first == 1) & (codes[first] == APOSTROPHE))
    mark = mark[~edge[last[mark]]]  # something follows, so there is a next run
    mark = mark[kind[mark + 1] == LETTER]
    for i in mark:
        at, end = first[i], last[i + 1]
        if not edge[at] and codes[at - 1] == BLANK:
            continue
        two = "".join(map(chr, codes[at + 1:min(at + 3, end)]))
        taken = 1 if two[0] in ONE_LETTER else 2 if two in TWO_LETTERS else 0
        if taken:
            begins[at + 1] = False
            if at + 1 + taken < end:
                begins[at + 1 + taken] = True
    starts = np.flatnonzero(begins[:n])
    ends = np.append(starts[1:], n)
    return codes, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def piece_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), starts, ends)


class PieceTable:
    """What an encoder says of pieces, remembered for the first `most` different ones.

    `encode` takes a list of strings and returns a list of arrays of token ids, or of counts.
    A piece beyond those remembered is encoded anew in each batch, so memory is bounded.
    """

    def __init__(self, encode, most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.values: list[np.ndarray] = []
        self.pool = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def of(self, codes, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece its place in the offsets, which say where its values lie in the pool."""
        keys = piece_hashes(codes, starts, ends)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(found, len(self.keys) - 1)] == keys
        places = np.empty(len(keys), np.int64)
        places[known] = self.places[found[known]]
        pool, at = self.pool, self.at
        if not known.all():
            new, where, back = np.unique(keys[~known], return_index=True, return_inverse=True)
            where = np.flatnonzero(~known)[where]
            whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
            values = self.encode([whole[a:b] for a, b in zip(starts[where], ends[where])])
            more = np.zeros(len(values), np.int64)
            np.cumsum([len(v) for v in values], out=more)
            pool = np.concatenate([pool, *values]).astype(np.uint32, copy=False)
            places[~known] = len(at) - 1 + back
            here = len(at) - 1 + np.arange(len(new))
            at = np.concatenate([at, at[-1] + more])
            if len(self.keys) + len(new) <= self.most:
                order = np.searchsorted(self.keys, new)
                self.keys = np.insert(self.keys, order, new)
                self.places = np.insert(self.places, order, here)
                self.pool, self.at = pool, at
        return places, at, pool
