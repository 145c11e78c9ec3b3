"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams: at each place the longest known one, from `longest` letters down to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import stored, texts_of
from tabprobe.llm.letters import Words, found_in, frame, text_chunks

UNKNOWN = "und"
#: Added to each count of the language with the most; its share is added in the others.
SMOOTHING = 0.1


@dataclass(frozen=True)
class LanguageModel:
    """Languages, and per length (0: whole words) sorted hashes with a log frequency a language."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language for each text (equal priors), and its number of words."""
        words = Words(texts)
        total = np.zeros((len(texts), len(self.langs)))
        count = np.bincount(words.of, minlength=len(texts))
        keys, logs = self.tables[0]
        places, known = found_in(keys, words.hashes(words.starts, words.ends))
        self._add(total, words.of[known], logs[places[known]])
        starts, ends, of = (x[~known] for x in (words.starts, words.ends, words.of))
        size = ends - starts
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        stop, row = np.repeat(ends, size), np.repeat(of, size)
        share = np.repeat(1 / size, size)  # an unseen word counts as much as a known one
        for length in sorted((n for n in self.tables if n), reverse=True):
            keys, logs = self.tables[length]
            fits = at + length <= stop
            places, known = found_in(keys, words.hashes(at, np.minimum(at + length, stop)))
            known &= fits
            self._add(total, row[known], logs[places[known]] * share[known, None])
            at, stop, row, share = (x[~known] for x in (at, stop, row, share))
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        return odds / odds.sum(axis=1, keepdims=True), count

    @staticmethod
    def _add(total: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> None:
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(rows, weights=logs[:, k], minlength=len(total))


def train(labelled: DataFrame, docs: DataFrame, most_docs: int = 2_000, longest: int = 5,
          most_entries: int = 50_000, seed: int = 1) -> LanguageModel | None:
    """Counts words and n-grams per language; None if there is no labelled text.

    `labelled`: doc_id and lang (not null) of the rows to learn from; `docs` has their texts.
    Fits on a bounded sample: of every language the `most_docs` rows with the smallest keyed hash
    of doc_id, so that a rare language is learned from all its rows. The table of each length
    keeps the `most_entries` most frequent entries of every language (ties: smaller hash), so its
    size is bounded as well. An entry that a language lacks is as unlikely in it as in any other.
    A language whose sampled texts hold no letters is not learned; None if that leaves none.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ids = (labelled.select("doc_id", "lang").distinct()
           .withColumn("place", F.row_number().over(order))
           .filter(F.col("place") <= most_docs).drop("place"))
    ids = stored(ids, "lang-sample")
    sample = texts_of(docs).filter("text <> ''").join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            words = Words(texts)
            for length in range(longest + 1):
                if length:
                    size = np.maximum(words.ends - words.starts - length + 1, 0)
                    begin = np.cumsum(size) - size
                    at = np.repeat(words.starts - begin, size) + np.arange(size.sum())
                    keys, of = words.hashes(at, at + length), np.repeat(words.of, size)
                else:
                    keys, of = words.hashes(words.starts, words.ends), words.of
                for lang in sorted(set(langs)):
                    own, n = np.unique(keys[langs[of] == lang], return_counts=True)
                    if not len(own):  # no word of this length in the texts of the language
                        continue
                    yield frame({"length": np.full(len(own), length, np.int32),
                                 "key": own.view(np.int64),
                                 "lang": np.full(len(own), lang, object), "n": n.astype(np.int64)})

    counts = sample.mapInArrow(count, "length int, key long, lang string, n long")
    langs = [r.lang for r in ids.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    of_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}")
               for i, x in enumerate(langs)]
    wide = stored(counts.groupBy("length", "key").agg(*of_lang), "lang-counts")
    words = wide.filter("length = 0").agg(
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(langs))]).first()
    learned = [i for i in range(len(langs)) if words[i]]
    if not learned:
        return None
    tables = {}
    for length in range(longest + 1):
        own = wide.filter(F.col("length") == length)
        top = reduce(DataFrame.union, [
            own.filter(F.col(f"n{i}") > 0).orderBy(F.desc(f"n{i}"), "key").limit(most_entries)
            for i in learned])
        rows = top.dropDuplicates(["key"]).toArrow()
        keys = rows.column("key").to_numpy().view(np.uint64)
        n = np.stack([rows.column(f"n{i}").to_numpy() for i in learned], axis=1)
        order, total = np.argsort(keys), n.sum(axis=0)
        least = SMOOTHING / max(total.max(), 1)
        logs = np.log((n / np.maximum(total, 1) + least) / (1 + least * max(len(n), 1)))
        tables[length] = (keys[order], logs[order])
    return LanguageModel([langs[i] for i in learned], tables)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1, the posterior of that language) of each whole text.

    A text that is null or has no letter is `und` with score 0, and so is every text where there
    is no model. Of equally likely languages the first by name is taken. All columns of `docs`
    stay but those two, which are replaced; repeated rows stay.
    """
    rows = docs.drop("lang_pred", "score")
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, top = [], []
            for _, texts in text_chunks([batch]):
                scores, words = sent.value.scores([t or "" for t in texts])
                best.append(np.where(words > 0, scores.argmax(axis=1), len(names) - 1))
                top.append(np.where(words > 0, scores.max(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[np.concatenate(best)], pa.string()),
                 pa.array(np.concatenate(top))],
                names=[*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
