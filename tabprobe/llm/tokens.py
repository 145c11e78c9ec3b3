"""Words between ASCII white space as 64-bit hashes, and compact blobs of sorted numbers."""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np
from pyspark.sql import SparkSession

from tabprobe.llm.pieces import mixed, powers
from tabprobe.sources.shared import shared_folder

#: A-Z lower-cased, every other byte as it is.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A"):ord("Z") + 1] += 32
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that lie end to end, and how many each has."""
    n = len(data)
    data = LOWERED[data]
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:n]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    ups, downs = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * ups[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * downs[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def packed(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers as the byte planes of their differences, which compress well."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T.tobytes()


def unpacked(blob: bytes, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in any order as byte planes."""
    return numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T.tobytes()


def unplaned(blob: bytes, kind=np.uint32) -> np.ndarray:
    parts = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(parts.T).view(kind).ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that workers open as files (to map them into memory).

    The shared folder has to be mounted on all machines; an object store cannot be mapped.
    """
    named = shared_folder(spark)
    path = named.removeprefix("file://") if named.startswith("file://") else named
    path = path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"memory-mapped tables need a mounted shared folder, not {named}")
    path = os.path.join(path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def write_array(path: str, values: np.ndarray) -> None:
    """Appears whole or not at all, and a second attempt of a task replaces it by the same."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, path)


def let_go(array: np.ndarray | None) -> None:
    """Take the pages of a mapped file out of this process; they stay in the machine's cache.

    Lookups go through the shards of a table in order, so a worker needs the pages of one at a time.
    """
    place = getattr(array, "_mmap", None)
    if place is not None and hasattr(mmap, "MADV_DONTNEED"):
        place.madvise(mmap.MADV_DONTNEED)


def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")
