"""Packing of examples into sequences under several limits at once (vector bin packing).

Each example is a vector of what it takes of the limits: tokens, segments and loss-bearing tokens.
It goes to the open sequence whose free room has the largest dot product with that vector, of
those where it fits whole. Where it fits nowhere it is cut: the sequence with the largest product
is filled up to a limit and the rest goes on as an example of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import bytes_of, chunks, texts_of
from tabprobe.llm.pieces import PieceTable, split
from tabprobe.llm.token_counts import Merges, byte_letters, held, segments

#: The splitting pattern that pieces.split follows.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence; all at least 1."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class Encoder:
    """Token ids of texts by the vocabulary of a byte-level BPE file."""

    def __init__(self, path: str):
        rules = Merges(path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in rules.vocab.items()
                 if token not in rules.special}
        self._bpe = tiktoken.Encoding(
            "pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = rules.special
        self.special_ids = rules.special_ids
        self.known = PieceTable(lambda pieces: [self._bpe.encode_ordinary(p) for p in pieces])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special strings inside give their own id."""
        parts, rows, found = segments(texts, self.special)
        codes, starts, ends, of = split(parts)
        places, at, pool = self.known.of(codes, starts, ends)
        size = at[places + 1] - at[places]
        stop = np.cumsum(size)
        flat = pool[np.repeat(at[places] - (stop - size), size) + np.arange(size.sum())]
        n = np.bincount(of, weights=size, minlength=len(parts)).astype(np.int64)
        own = np.split(flat, np.cumsum(n)[:-1])
        if not found.any():
            return own
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for row, ids in zip(rows, own):
            out[row].append(ids)
        return [x[0] if len(x) == 1 else self._joined(t, x) for t, x in zip(texts, out)]

    def _joined(self, text: str, parts: list[np.ndarray]) -> np.ndarray:
        between, at = [], 0
        for ids in parts[1:]:
            at, word = min((text.find(s, at), s) for s in self.special if text.find(s, at) >= 0)
            between.append(np.array([self.special_ids[word]], np.uint32))
            at += len(word)
        return np.concatenate([x for pair in zip(parts, [*between, parts[0][:0]]) for x in pair])


@dataclass
class Piece:
    """Ids of an example from `start` on, `loss` of which bear loss (the last ones)."""

    doc: object
    start: int
    ids: np.ndarray
    loss: int
    total: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        loss = max(0, n - (len(self.ids) - self.loss))
        return (Piece(self.doc, self.start, self.ids[:n], loss, self.total),
                Piece(self.doc, self.start + n, self.ids[n:], self.loss - loss, self.total))

    def most(self, room: np.ndarray) -> int:
        """How many of its ids fit: without loss up to the tokens, with loss up to both."""
        if room[1] < 1:
            return 0
        return int(min(len(self.ids), room[0], len(self.ids) - self.loss + room[2]))


@dataclass
class Packer:
    """Fills up to `width` open sequences; `done` gets (piece, sequence, offset)."""

    limits: Limits
    first_id: int = 0
    width: int = 16
    open: list[list[Piece]] = field(default_factory=list)
    done: list[tuple[Piece, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens],
                             np.int64)
        self.room = np.zeros((0, 3), np.int64)
        self.next_id = self.first_id

    def add(self, piece: Piece) -> None:
        while len(piece.ids):
            need = np.array([len(piece.ids), 1, piece.loss], np.int64)
            if (need > self.full).any():  # longer than a sequence: whole sequences first
                n = piece.most(self.full)
                part, piece = piece.cut(n)
                self._close([part])
                continue
            products = ((self.room / self.full) @ (need / self.full))
            fits = (self.room >= need).all(axis=1)
            if fits.any():
                i = int(np.flatnonzero(fits)[np.argmax(products[fits])])
                self._put(i, piece)
                return
            if len(self.open) < self.width:
                self.open.append([])
                self.room = np.vstack([self.room, self.full])
                self._put(len(self.open) - 1, piece)
                return
            i = int(np.argmax(products))
            part, piece = piece.cut(piece.most(self.room[i]))
            self._put(i, part)

    def _put(self, i: int, piece: Piece) -> None:
        self.open[i].append(piece)
        self.room[i] -= (len(piece.ids), 1, piece.loss)
        if (self.room[i] < 1).any():
            self._close(self.open.pop(i))
            self.room = np.delete(self.room, i, axis=0)

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((piece, self.next_id, offset))
            offset += len(piece.ids)
        self.next_id += 1

    def finish(self) -> None:
        """Fills sequences with what is still open; the last is split at powers of two."""
        rest = [p for pieces in self.open for p in pieces]
        self.open, self.room = [], self.room[:0]
        while rest:
            want = min(sum(len(p.ids) for p in rest), self.limits.tokens)
            if want < self.limits.tokens:
                want = 1 << (want.bit_length() - 1)
            room = np.array([want, self.limits.segments, self.limits.loss_tokens], np.int64)
            own: list[Piece] = []
            while rest and (room >= 1).all():
                part, after = rest[0].cut(rest[0].most(room))
                if not len(part.ids):
                    break
                room -= (len(part.ids), 1, part.loss)
                own.append(part)
                rest[:1] = [after] if len(after.ids) else []
            self._close(own)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(),
         prompt_tokens: str | None = None) -> DataFrame:
    """Pieces of all documents, each in one place of one sequence.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Ids are those of the tokenizer file without added tokens, then `end_id`; special
    strings inside texts give their own id. A null text is an empty one (only `end_id`). The
    column `prompt_tokens`, if named, says how many leading tokens of an example bear no loss
    (null: none). Repeated rows are examples of their own; further columns are ignored.

    Each partition of the input is packed by itself, in its order, with a bounded number of open
    sequences: nothing is shuffled, and a lost task packs the same rows in the same way again. A
    sequence that ends before the token limit did so at another limit; what is left at the end of
    a partition fills sequences whose lengths are powers of two.
    """
    wanted = [F.col(prompt_tokens).cast("long").alias("prompt")] if prompt_tokens else []
    plain = texts_of(docs, *wanted)
    kind = plain.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows_of(done: list[tuple[Piece, int, int]], doc_type: pa.DataType) -> pa.RecordBatch:
        pieces, ids, offsets = zip(*done)
        long = pa.int64()
        return pa.RecordBatch.from_arrays([
            pa.array([p.doc for p in pieces], doc_type),
            pa.array([p.start for p in pieces], long),
            pa.array([len(p.ids) for p in pieces], long),
            pa.array([p.ids.astype("<u4").tobytes() for p in pieces], pa.binary()),
            pa.array([p.total for p in pieces], long),
            pa.array(ids, long), pa.array(offsets, long),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held("encoder", tokenizer, lambda: Encoder(tokenizer))
        packer = Packer(limits, TaskContext.get().partitionId() << 32)
        doc_type = None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            _, offsets = bytes_of(batch.column("text"))
            for first, last in chunks(offsets):
                part = batch.slice(first, last - first)
                prompts = part.column("prompt").to_pylist() if prompt_tokens else [0] * len(part)
                ids_of = encoder.ids(part.column("text").to_pylist())
                for doc, ids, prompt in zip(part.column("doc_id").to_pylist(), ids_of, prompts):
                    ids = np.append(ids, np.uint32(end_id))
                    loss = len(ids) - min(max(prompt or 0, 0), len(ids))
                    packer.add(Piece(doc, 0, ids, loss, len(ids)))
                if packer.done:
                    yield rows_of(packer.done, doc_type)
                    packer.done = []
        packer.finish()
        if packer.done:
            yield rows_of(packer.done, doc_type)

    return plain.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
             "sequence_id long, offset long")
