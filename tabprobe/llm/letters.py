"""Words of letters as spans of code points, and tables that are looked up by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import bytes_of, chunks
from tabprobe.llm.pieces import LETTER, _classes, mixed, powers

_state: dict = {}


def _mixed_codes() -> np.ndarray:
    """Mix of each code point."""
    if "mixed" not in _state:
        _state["mixed"] = mixed(np.arange(1, 0x110001, dtype=np.uint64))
    return _state["mixed"]


class Words:
    """Lower-cased runs of letters of some texts, and hashes of any spans inside them."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.rows = len(texts)
        self.whole = "".join(lower)
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.zeros(len(lower) + 1, np.int64)
        np.cumsum([len(t) for t in lower], out=self.bounds[1:])
        self.kinds = _classes()[self.codes]
        n = len(self.codes)
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = self.kinds == LETTER
        self.edge = np.zeros(n + 1, bool)  # where a text begins or ends
        self.edge[self.bounds] = True
        self.starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | self.edge[:n]))
        self.ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | self.edge[1:])) + 1
        self.of = np.searchsorted(self.bounds, self.starts, side="right") - 1
        ups, self._downs = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed_codes()[self.codes] * ups[:-1], out=self._sums[1:])

    @cached_property
    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different word, and for every word which of these it equals."""
        back, keys = pd.factorize(self.hashes(self.starts, self.ends))
        one = np.zeros(len(keys), np.int64)
        one[back] = np.arange(len(back))
        return one, back

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends))

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums before mixing: that of two spans end to end is the first's plus the second's times
        the power of the first's length."""
        return (self._sums[ends] - self._sums[starts]) * self._downs[starts]


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `keys`, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    places = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return places, keys[places] == wanted


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with a bounded amount of text, and that text."""
    for batch in batches:
        _, offsets = bytes_of(batch.column("text"))
        for first, last in chunks(offsets):
            part = batch.slice(first, last - first)
            yield part, part.column("text").to_pylist()


def bounded_sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows: those whose doc_id has the smallest keyed hash; the same at each run.

    `rows` has doc_id and no texts yet, so that only ids are sorted.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    return rows.withColumn("_key", key).orderBy("_key", "doc_id").limit(most).drop("_key")


def frame(batch: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(batch), preserve_index=False)
