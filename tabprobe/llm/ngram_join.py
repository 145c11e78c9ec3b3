"""Documents linked by the Jaccard similarity of their word n-grams, and what they form together.

The incidence matrix of documents by n-grams is multiplied with its transpose block by block, and
only where a pair can still reach the bound that the two sizes set:

* Documents with equal sets are one row of the matrix.
* Columns are ordered by how many rows they have. A pair above the similarity shares one of the
  first n - ceil(s n) + 1 columns of each, so only those entries are multiplied, and no column
  with a single row.
* Within a column the rows are first multiplied with one of them only. Rows that are linked need
  no further products between them, so a group of near copies costs as many products as it has
  members and not their square.
* Columns that still hold rows of different components are multiplied in blocks: rows that share
  their first such column are put into the same blocks, a column is one entry for each block
  that has it, and each pair of blocks adds up the overlaps of its rows in one matrix.
* The overlap of a pair that passes the size bounds is accumulated over the whole rows, which lie
  as sorted arrays in the shared folder.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import bytes_of, chunks, partitions_of, stored, texts_of
from tabprobe.llm.components import components
from tabprobe.llm.letters import frame
from tabprobe.llm.pieces import mixed
from tabprobe.llm.token_counts import held
from tabprobe.llm.tokens import (
    mapped, mounted_folder, packed, unpacked, word_hashes, write_array,
)

#: Rounds in which a column is multiplied with one row only.
STAR_ROUNDS = 2
#: Rows of a block, about.
BLOCK_ROWS = 256
#: Columns that a product of blocks takes at a time.
COLUMNS = 4_096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(40)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Distinct shingles of each text as sorted hashes, one after the other, and how many."""
    hashes, n = word_hashes(data, offsets)
    first = np.cumsum(n) - n
    total = np.zeros(len(hashes), np.uint64)
    short = np.minimum(n, words)  # a text with fewer words is one shingle
    reach = np.repeat(short, n)
    place = np.arange(len(hashes)) - np.repeat(first, n)
    whole = place + reach <= np.repeat(n, n)
    for k in range(words):
        use = np.flatnonzero(whole & (k < reach))
        total[use] = mixed(total[use] * _ODD + hashes[use + k] + np.uint64(k + 1))
    row = np.repeat(np.arange(len(n)), n)[whole]
    values = total[whole]
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])][:len(row)]
    return values[new], np.bincount(row[new], minlength=len(n))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many columns of a row have to be multiplied: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def _sets_of(batch: pa.RecordBatch, words: int):
    data, offsets = bytes_of(batch.column("text"))
    for first, last in chunks(offsets):
        own = offsets[first:last + 1]
        values, n = shingle_sets(data[own[0]:own[-1]], own - own[0], words)
        yield batch.slice(first, last - first), values, n


def _place(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each hash (equal ranges) and 32 bits of its place in there, in order."""
    x = (values >> np.uint64(24)) * np.uint64(shards)
    return (x >> _PLACE_BITS).astype(np.int64), (x >> np.uint64(8)).astype(np.uint32)


class Frequencies:
    """How many rows a column has, coarsely (a power of 2^(1/8)); 0: one."""

    def __init__(self, folder: str, shards: int):
        self.shards = shards
        paths = [f"{folder}/columns/{s}.npy" for s in range(shards)]
        there = [os.path.exists(p) for p in paths]
        self.keys = [mapped(p) if ok else None for p, ok in zip(paths, there)]
        self.levels = [mapped(p.replace(".npy", ".level.npy")) if ok else None
                       for p, ok in zip(paths, there)]

    def of(self, values: np.ndarray) -> np.ndarray:
        own, back = np.unique(values, return_inverse=True)
        shard, place = _place(own, self.shards)
        out = np.zeros(len(own), np.uint8)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s, keys in enumerate(self.keys):
            a, b = cut[s], cut[s + 1]
            if b > a and keys is not None and len(keys):
                at = np.minimum(np.searchsorted(keys, place[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == place[a:b], self.levels[s][at], 0)
        return out[back]


class Nodes:
    """Membership in sorted ids that lie in range-partitioned files."""

    def __init__(self, folder: str, lows: list[tuple[int, int]]):
        self.lows = np.array([low for low, _ in lows], np.int64)
        self.parts = [mapped(f"{folder}/nodes/{number}.npy") for _, number in lows]

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        part = np.searchsorted(self.lows, ids, side="right") - 1
        for p in np.unique(part[part >= 0]):
            own = part == p
            at = np.minimum(np.searchsorted(self.parts[p], ids[own]), len(self.parts[p]) - 1)
            out[own] = self.parts[p][at] == ids[own]
        return out


def _write_nodes(nodes: DataFrame, folder: str, ranges: int) -> list[tuple[int, int]]:
    """Writes sorted ids in ranges, 8 bytes each; returns each file's first id and number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column("node").to_numpy(zero_copy_only=False) for b in batches]
        ids = np.sort(np.concatenate(own)) if own else np.zeros(0, np.int64)
        number = TaskContext.get().partitionId()
        if len(ids):
            write_array(f"{folder}/nodes/{number}.npy", ids)
            yield frame({"low": ids[:1], "number": np.array([number], np.int64)})

    files = nodes.select(F.col("node").cast("long")).repartitionByRange(ranges, "node")
    found = files.mapInArrow(write, "low long, number long").collect()
    return sorted((r.low, r.number) for r in found)


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of each document's set."""
    plain = texts_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, n in _sets_of(batch, words):
                cut = np.cumsum(n)
                digest = [hashlib.blake2b(values[b - k:b].tobytes(), digest_size=16).digest()
                          for b, k in zip(cut, n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)),
                     pa.array(digest, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary")


def _entries(docs: DataFrame, nodes: list[tuple[int, int]], folder: str, words: int,
             percent: int, shards: int) -> DataFrame:
    """Entries to multiply: shingle, node, n (row's size) and place (of the row in the files).

    `folder` has the files of the nodes and gets the columns' frequencies and the rows.
    """
    texts = texts_of(docs).filter("doc_id is not null")

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = held("nodes", folder, lambda: Nodes(folder, nodes))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        return batch.filter(pa.array(known.has(ids)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_parts = []
            for _, values, _ in _sets_of(chosen(batch), words):
                held_parts.append(values)
            values = np.sort(np.concatenate(held_parts)) if held_parts else np.zeros(0, np.uint64)
            shard, place = _place(values, shards)
            own, first = np.unique(shard, return_index=True)
            cut = [*first, len(values)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(own.astype(np.int32)),
                "places": pa.array([packed(place[a:b]) for a, b in zip(cut, cut[1:])],
                                   pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        places = np.sort(np.concatenate([unpacked(b, np.uint32) for b in rows["places"]]))
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]][:len(places)])
        n = np.diff(first, append=len(places))
        again = n >= 2
        level = np.minimum(np.floor(np.log2(np.maximum(n[again], 1)) * 8), 255)
        write_array(f"{folder}/columns/{shard}.level.npy", level.astype(np.uint8))
        write_array(f"{folder}/columns/{shard}.npy", places[first][again])
        return pd.DataFrame({"shard": [shard], "columns": [int(again.sum())]})

    texts.mapInArrow(spread, "shard int, places binary").groupBy("shard").applyInPandas(
        merge, "shard int, columns long").agg(F.sum("columns")).collect()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = held("columns", folder, lambda: Frequencies(folder, shards))
        number = TaskContext.get().partitionId()
        os.makedirs(f"{folder}/rows", exist_ok=True)
        part = f"{folder}/rows/{number}.{uuid.uuid4().hex}.part"
        written = 0
        with open(part, "wb") as file:
            for batch in batches:
                for own, values, n in _sets_of(chosen(batch), words):
                    row = np.repeat(np.arange(len(n)), n)
                    level = levels.of(values)
                    order = np.lexsort((values, level, row))
                    begin = np.cumsum(n) - n
                    nth = np.arange(len(values)) - np.repeat(begin, n)
                    use = (nth < np.repeat(prefix_size(n, percent), n)) & (level[order] > 0)
                    of = row[order][use]
                    kept = np.zeros(len(n), bool)
                    kept[of] = True
                    size = np.where(kept, n, 0)
                    at = written + np.cumsum(size) - size
                    values[np.repeat(kept, n)].tofile(file)
                    written += int(size.sum())
                    ids = own.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield frame({
                        "shingle": values[order][use].view(np.int64), "node": ids[of],
                        "n": n[of].astype(np.int64), "place": (number << 40) + at[of]})
        os.replace(part, f"{folder}/rows/{number}")

    return stored(texts.mapInArrow(emit, "shingle long, node long, n long, place long"),
                  "entries")


class Rows:
    """Rows of the matrix by their places in the files."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def of(self, place: int, n: int) -> np.ndarray:
        number, at = int(place) >> 40, int(place) & ((1 << 40) - 1)
        if number not in self.files:
            if len(self.files) > 256:
                self.files.clear()
            self.files[number] = np.memmap(f"{self.folder}/rows/{number}", np.uint64, "r")
        return self.files[number][at:at + int(n)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Columns that two rows share."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _linked(pairs: DataFrame, folder: str, percent: int) -> DataFrame:
    """Of pairs (a, b with sizes and places) those whose overlap reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(folder)
        for batch in batches:
            pdf = batch.to_pandas()
            good, last, a = [], None, None
            for place_a, na, place_b, nb in zip(*(pdf[c] for c in (
                    "place_a", "n_a", "place_b", "n_b"))):
                if last != place_a:
                    last, a = place_a, np.array(rows.of(place_a, na))
                both = overlap(a, rows.of(place_b, nb))
                good.append(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_pandas(pdf[["a", "b"]][good], preserve_index=False)

    return pairs.mapInArrow(run, "a long, b long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Columns shared by each row of `a` and each of `b`: a matrix product over slices of columns."""
    columns = np.unique(np.concatenate(a))
    places = []
    for rows in (a, b):
        flat = np.concatenate(rows)
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        there = columns[at] == flat
        order = np.argsort(at[there], kind="stable")
        places.append((at[there][order], row[there][order]))
    total = np.zeros((len(a), len(b)), np.float32)  # whole numbers, exact up to 2^24
    for low in range(0, len(columns), COLUMNS):
        sides = []
        for (at, row), n in zip(places, total.shape):
            x, y = np.searchsorted(at, (low, low + COLUMNS))
            side = np.zeros((n, COLUMNS), np.float32)
            side[row[x:y], at[x:y] - low] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def _blocks_of(entries: DataFrame) -> DataFrame:
    """A block for each node: about BLOCK_ROWS nodes that share their first column, if possible."""
    first = entries.groupBy("node").agg(F.min("shingle").alias("first"))
    blocks = -(-first.count() // BLOCK_ROWS)
    sizes = first.groupBy("first").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    many = F.xxhash64("first", F.pmod(F.xxhash64("node"), F.col("parts")))
    few = F.pmod(F.xxhash64("first"), F.lit(max(blocks, 1)))
    return first.join(sizes, "first").select(
        F.col("node").alias("of"), F.when(F.col("parts") > 1, many).otherwise(few).alias("block"))


def _blocked_links(entries: DataFrame, blocks: DataFrame, within: bool, folder: str,
                   percent: int) -> DataFrame:
    """Links between rows of different components that share a column of `entries`.

    Either those within a block or those between blocks.
    """
    row = F.struct("node", "n", "place", "component")
    tiles = entries.join(blocks, F.col("node") == F.col("of")).groupBy("shingle", "block").agg(
        F.collect_list(row).alias("rows"), F.min("component").alias("low"),
        F.max("component").alias("high"))

    def side(name: str) -> DataFrame:
        return tiles.select("shingle", *[
            F.col(c).alias(f"{c}_{name}") for c in ("block", "low", "high")], *[
            F.col(f"rows.{c}").alias(f"{c}_{name}") for c in ("node", "n", "place", "component")])

    if within:
        pairs = side("a").filter("low_a < high_a").withColumns({
            f"{c}_b": F.col(f"{c}_a") for c in ("block", "node", "n", "place", "component")})
    else:
        pairs = side("a").join(side("b"), "shingle").filter(
            (F.col("block_a") < F.col("block_b"))
            & (F.least("low_a", "low_b") < F.greatest("high_a", "high_b")))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        def rows_of(name: str) -> pd.DataFrame:
            return pd.DataFrame({c: np.concatenate(pdf[f"{c}_{name}"].to_numpy())
                                 for c in ("node", "n", "place", "component")}
                                ).drop_duplicates("node").sort_values("node")

        a, b = rows_of("a"), rows_of("b")
        product = np.zeros((len(a), len(b)), np.int32)
        for left, right in zip(pdf["node_a"], pdf["node_b"]):
            product[np.ix_(np.searchsorted(a["node"], left),
                           np.searchsorted(b["node"], right))] += 1
        na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None]
        rest = np.maximum(na - prefix_size(na, percent), nb - prefix_size(nb, percent))
        # 100 o >= percent (na + nb - o), with what the first columns leave open added to o
        able = ((product > 0) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                & ((100 + percent) * (product + rest) >= percent * (na + nb))
                & (a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None]))
        if within:
            able = np.triu(able, 1)
        i, j = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if not len(i):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        rows = Rows(folder)
        both = overlaps([np.array(rows.of(a["place"].iat[x], na[x, 0])) for x in i],
                        [np.array(rows.of(b["place"].iat[x], nb[0, x])) for x in j])
        sizes = na[i] + nb[:, j]
        good = able[np.ix_(i, j)] & (100 * both >= percent * (sizes - both))
        x, y = np.nonzero(good)
        return pd.DataFrame({"a": a["node"].to_numpy()[i[x]], "b": b["node"].to_numpy()[j[y]]})

    return pairs.groupBy("block_a", "block_b").applyInPandas(multiply, "a long, b long")


def _pairs(centre: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of a shingle's centre and another row whose sizes allow a link, each once."""
    a = centre.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place")],
                    F.col("component").alias("component_a"))
    b = entries.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place")],
                     F.col("component").alias("component_b"))
    bound = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return a.join(b, "shingle").filter(
        (F.col("component_a") != F.col("component_b")) & bound
    ).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        *[F.min(c).alias(c) for c in ("n_a", "n_b", "place_a", "place_b")])


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 75,
                   shards: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are what ASCII white space separates, A-Z lower-cased; a set holds the distinct shingles
    of `words` words, or the whole text as one if it is shorter. Two documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. A
    document without words (or with null text) is linked with nothing. A row without doc_id takes
    part in nothing and has a null component_id. Rows that repeat a doc_id are one node of the
    graph. Further columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or partitions_of(spark)
    folder = mounted_folder(spark, "shingles")
    rows = stored(_rows(docs, words), "shingle-rows")
    solid = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(solid.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    nodes = _write_nodes(classes, folder, shards)
    entries = _entries(docs, nodes, folder, words, percent, shards)
    shared = entries.groupBy("shingle").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    entries = stored(entries.join(shared.select("shingle"), "shingle"), "shared-entries")
    links, found = None, None
    for turn in range(STAR_ROUNDS + 2):
        if found is None:
            now = entries.withColumn("component", F.col("node"))
        else:
            labels = found.withColumnRenamed("node", "of")
            now = entries.join(labels, F.col("node") == F.col("of"), "left").select(
                "shingle", "node", "n", "place",
                F.coalesce("component", "node").alias("component"))
            open_ = now.groupBy("shingle").agg(
                F.min("component").alias("low"), F.max("component").alias("high")
            ).filter("low < high").select("shingle")
            now = stored(now.join(open_, "shingle"), "open-entries")
        if turn < STAR_ROUNDS:
            first = F.struct(F.xxhash64(F.lit(turn), "node").alias("key"),
                             "node", "n", "place", "component")
            centre = now.groupBy("shingle").agg(F.min(first).alias("c")).select("shingle", "c.*")
            pairs = _pairs(centre, now, percent)
            new = _linked(pairs.repartition(shards, "a").sortWithinPartitions("a"), folder,
                          percent)
        else:
            if turn == STAR_ROUNDS:
                blocks = stored(_blocks_of(now), "blocks")
            new = _blocked_links(now, blocks, turn == STAR_ROUNDS, folder, percent)
        new = stored(new, "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
    labels = classes.join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id"))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return rows.join(labels, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id"))
        .alias("component_id"))


