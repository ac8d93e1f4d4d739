"""Blocked Bloom filters over 64-bit hashes, as numpy arrays, and their building on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 64-bit words of a block; a key sets one bit in each word of its block.
WORDS = 8
BLOCK_BYTES = WORDS * 8
# A filter is built in parts of so many blocks (256 KB), each by one group of keys.
SEGMENT_BLOCKS = 4096
LEAST_BLOCKS = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the answer depends on every bit of ``h`` (unsigned 64-bit)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks_for(keys: int, bits_per_key: int) -> int:
    return max(LEAST_BLOCKS, -(-keys * bits_per_key // (BLOCK_BYTES * 8)))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each hash, from its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


class Bloom:
    """The blocks ``first`` to ``first + len / 8`` of a filter of ``blocks`` blocks.

    Hashes whose block is not held are not contained, so a filter too large for one
    task can be asked part by part.
    """

    def __init__(self, blocks: int, first: int = 0, words: np.ndarray | None = None):
        self.blocks, self.first = blocks, np.uint64(first)
        self.words = np.zeros(blocks * WORDS, np.uint64) if words is None else words

    def add(self, h: np.ndarray) -> None:
        at = (block_of(h, self.blocks) - self.first) * np.uint64(WORDS)
        g = mixed(h)
        for j in range(WORDS):
            bit = np.uint64(1) << ((g >> np.uint64(6 * j)) & np.uint64(63))
            np.bitwise_or.at(self.words, at + np.uint64(j), bit)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Mask of the hashes that may have been added; those added always are in it."""
        block = block_of(h, self.blocks) - self.first
        found = np.nonzero(block < np.uint64(len(self.words) // WORDS))[0]
        at, g = block[found] * np.uint64(WORDS), mixed(h[found])
        for j in range(WORDS):
            bit = (g >> np.uint64(6 * j)) & np.uint64(63)
            hit = ((self.words[at + np.uint64(j)] >> bit) & np.uint64(1)).astype(bool)
            found, at, g = found[hit], at[hit], g[hit]
            if not len(found):
                break
        mask = np.zeros(len(h), bool)
        mask[found] = True
        return mask


class GrowingBloom:
    """A filter for a number of keys not known before: parts, each twice the last."""

    def __init__(self, bits_per_key: int, first_keys: int = 1 << 14):
        self.bits, self.room = bits_per_key, first_keys
        self.left = first_keys
        self.parts = [Bloom(blocks_for(first_keys, bits_per_key))]

    def contains(self, h: np.ndarray) -> np.ndarray:
        mask = self.parts[0].contains(h)
        for part in self.parts[1:]:
            mask |= part.contains(h)
        return mask

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.left:
                self.room *= 2
                self.left = self.room
                self.parts.append(Bloom(blocks_for(self.room, self.bits)))
            some, h = h[: self.left], h[self.left :]
            self.parts[-1].add(some)
            self.left -= len(some)


def build_segments(hashes: DataFrame) -> DataFrame:
    """Filters from rows ``shard int, blocks bigint, h bigint``: ``shard, segment, words``.

    A segment is ``SEGMENT_BLOCKS`` blocks of the filter of a shard; those without keys
    are left out. Every group of keys is bounded, as hashes fall evenly and the number
    of blocks follows the number of keys; keys that occur twice must be rare.
    """

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            blocks = batch.column(1).to_numpy().astype(np.uint64)
            block = ((h >> np.uint64(32)) * blocks) >> np.uint64(32)
            segment = pa.array((block // np.uint64(SEGMENT_BLOCKS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, segment], names=["shard", "blocks", "h", "segment"]
            )

    def filled(group: pa.Table) -> pa.Table:
        blocks, segment = group["blocks"][0].as_py(), group["segment"][0].as_py()
        first = segment * SEGMENT_BLOCKS
        held = min(SEGMENT_BLOCKS, blocks - first)
        part = Bloom(blocks, first, np.zeros(held * WORDS, np.uint64))
        part.add(group["h"].to_numpy().view(np.uint64))
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
            "segment": pa.array([segment], pa.int64()),
            "words": pa.array([part.words.tobytes()], pa.binary()),
        })

    rows = hashes.select("shard", "blocks", "h").mapInArrow(
        located, "shard int, blocks bigint, h bigint, segment bigint"
    )
    return rows.groupBy("shard", "segment").applyInArrow(
        filled, "shard int, segment bigint, words binary"
    )


def loaded(segments: DataFrame, shard: int, blocks: int, first: int, last: int) -> Bloom:
    """The segments ``first`` to ``last`` (exclusive) of a shard; the caller bounds them."""
    at = first * SEGMENT_BLOCKS
    held = min(last * SEGMENT_BLOCKS, blocks) - at
    words = np.zeros(held * WORDS, np.uint64)
    asked = (F.col("shard") == shard) & (F.col("segment") >= first) & (F.col("segment") < last)
    for row in segments.where(asked).toLocalIterator():
        some = np.frombuffer(row["words"], np.uint64)
        start = (row["segment"] - first) * SEGMENT_BLOCKS * WORDS
        words[start : start + len(some)] = some
    return Bloom(blocks, at, words)
