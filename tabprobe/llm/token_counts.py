"""Token counts by heap-and-linked-list byte-pair merging, without token identifiers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabprobe.llm.common import bytes_of, chunks, texts_of
from tabprobe.llm.pieces import PieceTable, split


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the files of byte-level tokenizers.

    Fixed values: the bytes ! to ~, 0xA1 to 0xAC and 0xAE to 0xFF stand for themselves, the others
    in order for the code points from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs, and the special strings, of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special_ids = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.special = list(self.special_ids)
        self.vocab = rules["model"]["vocab"]
        self._letters = {i: c for i, c in enumerate(byte_letters())}

    def symbols(self, piece: str) -> list[str]:
        return list(piece.encode("utf-8", "surrogatepass").decode("latin-1")
                    .translate(self._letters))

    def count(self, piece: str) -> int:
        """Symbols left once no adjacent pair has a rank: those at first minus the merges.

        The symbols form a linked list; a heap gives the pair of lowest rank, the leftmost first.
        A pair whose symbols have changed meanwhile is out of date and is skipped.
        """
        symbol, rank = self.symbols(piece), self.rank
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = (symbol[i], symbol[i + 1])
            if (r := rank.get(pair)) is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] != pair[0] or symbol[j] != pair[1]:
                continue
            merges += 1
            symbol[i], symbol[j] = pair[0] + pair[1], ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = (symbol[i], symbol[k])
                if (r := rank.get(new)) is not None:
                    heapq.heappush(heap, (r, i, new))
            if (h := before[i]) >= 0:
                new = (symbol[h], symbol[i])
                if (r := rank.get(new)) is not None:
                    heapq.heappush(heap, (r, h, new))
        return n - merges

    def counts(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array([self.count(p)], np.uint32) for p in pieces]


def segments(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the segments, each one's text, and specials per text."""
    found = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[str] = []
    for row, text in enumerate(texts):
        own = [text]
        for s in special:
            if s in text:
                own = [x for part in own for x in part.split(s)]
        found[row] = len(own) - 1
        rows += [row] * len(own)
        parts += own
    return parts, np.array(rows, np.int64), found


_held: dict = {}


def held(kind: str, key, make):
    """One object per Python worker and kind: that of the last key, an earlier one is let go."""
    if kind not in _held or _held[kind][0] != key:
        _held.pop(kind, None)
        _held[kind] = (key, make())
    return _held[kind][1]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    `tokenizer`: path of a byte-level BPE file (.json) on every machine. A null text is an empty
    one, with no bytes and no tokens. Special strings inside texts are one token each. Repeated
    rows give repeated results, further columns are ignored. Every text is read whole; a worker
    remembers a bounded number of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = held("merges", tokenizer, lambda: Merges(tokenizer))
        known = held("counts", tokenizer, lambda: PieceTable(merges.counts))
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            total = np.zeros(batch.num_rows, np.int64)
            for first, last in chunks(offsets):
                texts = batch.column("text").slice(first, last - first).to_pylist()
                parts, rows, found = segments(texts, merges.special)
                codes, starts, ends, of = split(parts)
                places, at, pool = known.of(codes, starts, ends)
                n = np.bincount(rows[of], weights=pool[at[places]], minlength=len(texts))
                total[first:last] = n.astype(np.int64) + found
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total),
                 pa.array(total > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    plain = texts_of(docs)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
