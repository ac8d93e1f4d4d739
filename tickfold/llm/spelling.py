"""Spelling variants: words one edit apart, and the frequent form of each.

The edits of a word are never written out. Their hashes follow from that of the word, and
are looked up in Bloom filters of the vocabulary, one for each length. Only edits found
there become rows, and an equi-join with the vocabulary removes those found wrongly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.llm.bloom import BLOCK_BYTES, SEGMENT_BLOCKS, Bloom, blocks_for, build_segments, loaded, mixed
from tickfold.llm.common import small_batches, stored

RUN = "[a-zÀ-ÿ]+"  # of lower-cased text
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]

# Bits of a filter for each word: some 1 of 10,000 edits is found wrongly.
BITS = 24
# Filters that a task holds at a time; a larger vocabulary is asked in several passes.
PASS_BYTES = 32 << 20
# Distinct words a task counts before it sends them.
FLUSH = 1 << 17
# Words whose edits one task looks up; many edits come from few bytes.
TASK_WORDS = 1 << 15
# Hashes of edits that a task works out at a time.
TILE = 1 << 20
# Lengths up to this have a filter of their own, longer ones one for each power of two.
OWN_SHARD = 64

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def shard_of(length: int) -> int:
    return length if length <= OWN_SHARD else OWN_SHARD + (length - 1).bit_length()


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), -1).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    powers = np.full(length, BASE, np.uint64)
    return np.cumprod(powers, dtype=np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Hash of every beginning of the words: column ``i`` is that of the first ``i``."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(codes * _powers(codes.shape[1]), axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words of one length; the sum over letters of letter times power of place."""
    return mixed(_sums(code_points(words))[:, -1])


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


# -- vocabulary -----------------------------------------------------------------


def _altered(word: str, h: int, every: int) -> str:
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, every: int = 31, least: int = 7) -> DataFrame:
    """``word, n``: how often the words of at least ``least`` letters occur.

    A word is a run of letters with A-Z lower-cased. Where the crc32 of ``<doc_id>:<run>``
    is a multiple of ``every``, the letter it points at is left out of the run first.
    """
    run_of = re.compile(RUN)

    def emit(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
            names=["word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in small_batches(batches, 64):
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, body in zip(batch.column(0).to_pylist(), bodies):
                # Lower-casing bytes touches A-Z only.
                text = (body or b"").lower().decode("utf-8", "replace")
                start = zlib.crc32(f"{doc_id}:".encode())
                found = Counter(m.group() for m in run_of.finditer(text)) if len(text) > TILE \
                    else Counter(run_of.findall(text))
                for word, n in found.items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        word = _altered(word, h, every)
                        if len(word) < least:
                            continue
                    counts[word] = counts.get(word, 0) + n
            if len(counts) >= FLUSH:
                yield emit(counts)
                counts = {}
        yield emit(counts)

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return named.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# -- edits looked up in the filters --------------------------------------------------


@dataclass(frozen=True)
class Part:
    """The filter of a shard, or a range of its segments."""

    shard: int
    blocks: int
    first: int
    last: int

    @property
    def size(self) -> int:
        held = min(self.last * SEGMENT_BLOCKS, self.blocks) - self.first * SEGMENT_BLOCKS
        return held * BLOCK_BYTES


def plan_passes(blocks: dict[int, int], limit: int) -> list[list[Part]]:
    """Filters put together to passes of at most ``limit`` bytes; large ones are cut."""
    step = max(1, limit // (SEGMENT_BLOCKS * BLOCK_BYTES))
    parts = [
        Part(shard, n, first, min(first + step, -(-n // SEGMENT_BLOCKS)))
        for shard, n in sorted(blocks.items())
        for first in range(0, -(-n // SEGMENT_BLOCKS), step)
    ]
    passes: list[list[Part]] = []
    room = 0
    for part in parts:
        if not passes or part.size > room:
            passes.append([])
            room = limit
        passes[-1].append(part)
        room -= part.size
    return passes


def _deleted(codes, sums, filters: list[Bloom]):
    """Words of the group and places whose letter may be left out."""
    n, size = codes.shape
    whole = sums[:, -1:]
    rows = max(1, TILE // size)
    for lo in range(0, n, rows):
        part = slice(lo, lo + rows)
        h = mixed(sums[part, :-1] + (whole[part] - sums[part, 1:]) * INVERSE)
        # Of equal letters in a row it makes no difference which one goes.
        differs = np.ones(h.shape, bool)
        differs[:, :-1] = codes[part, :-1] != codes[part, 1:]
        word, at = np.nonzero(differs)
        found = _in_any(filters, h[word, at])
        yield from zip((word[found] + lo).tolist(), at[found].tolist())


def _replaced(codes, sums, filters: list[Bloom], letters: np.ndarray):
    """Words, places and larger letters that may stand there instead."""
    n, size = codes.shape
    powers = _powers(size)
    places = max(1, min(size, TILE // len(letters)))
    rows = max(1, TILE // (places * len(letters)))
    for lo in range(0, n, rows):
        for left in range(0, size, places):
            own = codes[lo : lo + rows, left : left + places, None]
            word, at, letter = np.nonzero(letters > own)
            step = letters[letter] - own[word, at, 0]
            h = mixed(sums[word + lo, -1] + step * powers[at + left])
            found = _in_any(filters, h)
            yield from zip(
                (word[found] + lo).tolist(), (at[found] + left).tolist(), letters[letter[found]].tolist()
            )


def _in_any(filters: list[Bloom], h: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(h), bool)
    for one in filters:
        mask |= one.contains(h)
    return np.nonzero(mask)[0]


def _probe(words: DataFrame, shared: Broadcast, letters: list[int]) -> DataFrame:
    """Rows ``word, n, other``: edits of the words that are in the filters of the pass."""
    choice = np.array(sorted(letters), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, list[Bloom]] = shared.value
        for batch in small_batches(batches, 4096):
            all_words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            source, other = [], []
            for size, group in _by_length(all_words).items():
                shorter, equal = filters.get(shard_of(size - 1)), filters.get(shard_of(size))
                if not shorter and not equal:
                    continue
                some = [all_words[i] for i in group]
                codes = code_points(some)
                sums = _sums(codes)
                if shorter:
                    for w, at in _deleted(codes, sums, shorter):
                        source.append(group[w])
                        other.append(some[w][:at] + some[w][at + 1 :])
                if equal:
                    for w, at, letter in _replaced(codes, sums, equal, choice):
                        source.append(group[w])
                        other.append(some[w][:at] + chr(letter) + some[w][at + 1 :])
            yield pa.RecordBatch.from_arrays(
                [pa.array([all_words[i] for i in source], pa.string()),
                 pa.array([counts[i] for i in source], pa.int64()),
                 pa.array(other, pa.string())],
                names=["word", "n", "other"],
            )

    return words.mapInArrow(run, "word string, n bigint, other string")


def _hashed(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8192):
            some = batch.column(0).to_pylist()
            h = np.zeros(len(some), np.uint64)
            shard = np.zeros(len(some), np.int32)
            for size, group in _by_length(some).items():
                h[group] = word_hashes([some[i] for i in group])
                shard[group] = shard_of(size)
            room = np.array([blocks[s] for s in shard.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(room), pa.array(h.view(np.int64))],
                names=["shard", "blocks", "h"],
            )

    return words.select("word").mapInArrow(run, "shard int, blocks bigint, h bigint")


def near_words(words: DataFrame, letters: list[int] = LETTERS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of stored ``words`` (``word, n``, each once) one edit apart: ``word, n, other, other_n``.

    Each pair is given once: the longer word first, or that with the smaller letter where
    they differ. Nothing but ``letters`` may stand in a word.
    """
    spark: SparkSession = words.sparkSession
    by_size = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n"))
    held: Counter = Counter()
    for row in by_size.toLocalIterator():
        held[shard_of(row["size"])] += row["n"]
    blocks = {shard: blocks_for(n, BITS) for shard, n in held.items()}
    spread = words.repartition(-(-sum(held.values()) // TASK_WORDS) or 1, "word")
    found = spark.createDataFrame([], "word string, n bigint, other string")
    if blocks:
        segments = stored(build_segments(_hashed(words, blocks)), "word-filters")
        for parts in plan_passes(blocks, pass_bytes):
            filters: dict[int, list[Bloom]] = {}
            for p in parts:
                filters.setdefault(p.shard, []).append(loaded(segments, p.shard, p.blocks, p.first, p.last))
            some = _probe(spread, spark.sparkContext.broadcast(filters), letters)
            # One pass is on the driver at a time.
            found = found.unionByName(stored(some, "word-edits"))
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


# -- forms ------------------------------------------------------------------------


def variants(words: DataFrame, near: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for all ``words``, from the pairs ``near``.

    ``form`` is the near word of largest ``n`` (the smallest in code-point order of
    several), if that is at least ``ratio`` times the word's own; ``root`` is where
    forms lead in the end.
    """
    ways = F.explode(F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("best")),
        F.struct(
            F.col("other").alias("word"),
            F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best"),
        ),
    )).alias("e")
    best = near.select(ways).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min("best").alias("best")
    )
    frequent = (-F.col("best.less")) >= ratio * F.col("n")
    told = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best.form")).alias("form"),
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``; every round doubles the steps followed.

    Counts grow with every step, so there are no circles and few rounds.
    """
    roots = forms.withColumnRenamed("form", "root")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(
            roots.join(onward, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "word-roots",
        )
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """Near words, frequent form and root of the words of whole texts.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. A null text has
    no words, a null id counts as the empty text. Rows that are repeated count again.
    Words may be of any length: work grows with length times letters, and only edits that
    exist become rows. No word gives no rows.
    """
    counted = count_words(docs, every, least).where(F.col("n") >= least_n)
    words = stored(counted, "vocabulary")
    return variants(words, near_words(words))
