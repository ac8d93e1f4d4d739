"""Lines that many documents share, kept in one of them only.

A first pass sends hashes of lines, not lines. Where the hashes of a slice arrive, one
Bloom filter holds those seen once and another those seen twice; a hash met again that is
in both is suspected. Only lines with a suspected hash are shuffled, and grouped by their
text, which finds those that are really repeated and the document that keeps each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.bloom import BLOCK_BYTES, GrowingBloom, blocks_for, build_segments, loaded
from tickfold.llm.common import lookup_join, numbered, small_batches, stored

# Bits of a filter for each hash. A wrong suspicion costs one line in a shuffle.
BITS = 16
# Hashes a task gathers before it sends them, each once with its number of documents.
FLUSH = 1 << 18
# Broadcast sizes; more is joined by a shuffle.
MAX_FILTER_BYTES = 32 << 20
MAX_TABLE_BYTES = 48 << 20
# A repeated line in the broadcast table: 128 bits of hash and a document id.
ENTRY_BYTES = 24


def keys_of(data: bytes) -> list[bytes]:
    """Keys of the lines of a text: ASCII space off both ends, A-Z lower-cased."""
    return [line.strip() for line in data.lower().split(b"\n")]


def is_long(key: bytes, least: int) -> bool:
    """At least ``least`` code points (one to four bytes each)."""
    size = len(key)
    return size >= least and (size >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _bodies(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _long_keys(data: bytes, least: int) -> list[bytes]:
    """Distinct long keys of a text, in the order they occur."""
    return [k for k in dict.fromkeys(keys_of(data)) if is_long(k, least)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _counted(docs: DataFrame, least: int, min_docs: int) -> DataFrame:
    """Hashes of the long lines of each task with their documents, ``min_docs`` at most."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        n = np.minimum(n, min_docs).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches, 64):
            for data in _bodies(batch, "text"):
                held.append(_hashes(_long_keys(data, least)))
                size += len(held[-1])
            if size >= FLUSH:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return docs.select("text").mapInArrow(run, "h bigint, n int")


def suspected(counted: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least ``min_docs`` documents may hold, and no fewer than all of those.

    One filter for each number of documents below ``min_docs``: seen once, seen twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [GrowingBloom(BITS) for _ in range(min_docs - 1)]
        for batch in batches:
            h, at = np.unique(batch.column(0).to_numpy().view(np.uint64), return_inverse=True)
            total = np.bincount(at, batch.column(1).to_numpy(), len(h)).astype(np.int64)
            known = np.ones(len(h), bool)
            for level in filters:
                known &= level.contains(h)
                total += known
            for i, level in enumerate(filters, start=1):
                level.add(h[(total >= i) & ~level.contains(h)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[total >= min_docs].view(np.int64))], names=["h"]
            )

    return counted.repartition("h").mapInArrow(run, "h bigint").distinct()


def _suspected_lines(docs: DataFrame, suspects: DataFrame, least: int) -> DataFrame:
    """Rows ``key, doc_id``: each document's distinct long lines with a suspected hash."""
    count = suspects.count()
    blocks = blocks_for(count, BITS)
    small = blocks * BLOCK_BYTES <= MAX_FILTER_BYTES
    shared = None
    if small:
        spread = suspects.select(F.lit(0).alias("shard"), F.lit(blocks).cast("bigint").alias("blocks"), "h")
        whole = loaded(build_segments(spread), 0, blocks, 0, blocks)
        shared = docs.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            ids = batch.column(0).to_pylist()
            found = [_long_keys(data, least) for data in _bodies(batch, "text")]
            keys = [k for some in found for k in some]
            owner = [i for i, some in zip(ids, found) for _ in some]
            h = _hashes(keys)
            if shared is not None:
                pick = np.nonzero(shared.value.contains(h))[0]
                keys, owner, h = [keys[i] for i in pick], [owner[i] for i in pick], h[pick]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(keys, pa.binary()),
                 pa.array(owner, batch.schema.field(0).type)],
                names=["h", "key", "doc_id"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    lines = docs.select("doc_id", "text").mapInArrow(run, f"h bigint, key binary, doc_id {kind}")
    return lines if small else lookup_join(lines, suspects, ["h"])


def repeated_lines(docs: DataFrame, min_docs: int = 3, least: int = 20) -> DataFrame:
    """Lines that at least ``min_docs`` rows hold: ``key, n_docs, keep_id``.

    ``keep_id`` is the largest ``doc_id`` holding it; a null id is the smallest.
    """
    suspects = stored(suspected(_counted(docs, least, min_docs), min_docs), "suspected-lines")
    lines = _suspected_lines(docs, suspects, least)
    # A line in most documents is one row for each task here.
    found = lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id"))
    return found.where(F.col("n_docs") >= min_docs)


def _result(ids, kind, lines, dropped, texts, digests) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
         pa.array(texts, pa.binary()).cast(pa.string()) if texts else pa.array(texts, pa.string()),
         pa.array(digests, pa.string())],
        names=["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"],
    )


def _digested(batch, drop_in) -> pa.RecordBatch:
    """What is left of the texts of a batch; ``drop_in`` says, text by text, which lines go."""
    bodies = _bodies(batch, "text")
    counts, gone, texts = [], [], []
    for data, out in zip(bodies, drop_in(bodies)):
        lines = data.split(b"\n")
        kept = [line for i, line in enumerate(lines) if i not in out] if out else lines
        counts.append(len(lines))
        gone.append(len(lines) - len(kept))
        texts.append(b"\n".join(kept))
    digests = [hashlib.sha256(t).hexdigest() for t in texts]
    return _result(batch.column(0).to_pylist(), batch.schema.field(0).type, counts, gone, texts, digests)


class _Table:
    """Repeated lines by 128 bits of hash, sorted, with the document that keeps each."""

    def __init__(self, entries: list[tuple[bytes, int | None]]):
        entries.sort()
        self.names = np.array([e[0] for e in entries], "S16")
        self.keeps = [e[1] for e in entries]

    def dropped(self, ids: list, keys: list[list[bytes]], least: int) -> list[set[int]]:
        """Line numbers that go, for each document."""
        flat = [(d, i, k) for d, some in enumerate(keys) for i, k in enumerate(some) if is_long(k, least)]
        out: list[set[int]] = [set() for _ in keys]
        if not flat or not len(self.names):
            return out
        names = np.array([xxhash.xxh3_128_digest(k) for _, _, k in flat], "S16")
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        for j in np.nonzero(self.names[at] == names)[0]:
            d, i, _ = flat[j]
            if self.keeps[at[j]] != ids[d]:
                out[d].add(i)
        return out


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, least: int = 20) -> DataFrame:
    """Drops lines that ``min_docs`` documents hold from all but one of them.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. Returns for each
    row ``doc_id, n_lines, n_dropped, kept_text, kept_sha256``. A line's key is the line
    without ASCII space at its ends and with A-Z lower-cased; keys of fewer than ``least``
    code points never go. Only the rows with the largest ``doc_id`` that hold a repeated
    key keep their lines of it (all of them, if it is there several times).

    Null or empty text is one empty line. Every row is a document, also one with the id of
    another; among equal largest ids all keep the line. A null id is smaller than any other.
    A text without line ends is one line, however long. An empty table gives no rows.
    """
    docs = numbered(docs.select("doc_id", "text"), "_place")
    repeated = stored(repeated_lines(docs, min_docs, least), "repeated-lines")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string"
    if repeated.count() * ENTRY_BYTES <= MAX_TABLE_BYTES:
        named = repeated.select("key", "keep_id").mapInArrow(_named(kind), f"name binary, keep_id {kind}")
        entries = [(r["name"], r["keep_id"]) for r in named.toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(_Table([(bytes(n), k) for n, k in entries]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, 64):
                ids = batch.column(0).to_pylist()
                yield _digested(
                    batch,
                    lambda bodies, ids=ids: shared.value.dropped(ids, [keys_of(b) for b in bodies], least),
                )

        return docs.select("doc_id", "text").mapInArrow(run, schema)
    return _dropped_by_join(docs, repeated, least, schema)


def _named(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [xxhash.xxh3_128_digest(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), batch.column(1)], names=["name", "keep_id"]
            )

    return run


def _dropped_by_join(docs: DataFrame, repeated: DataFrame, least: int, schema: str) -> DataFrame:
    """As with the table, for more repeated lines than a task should hold."""
    kind = dict(docs.dtypes)["doc_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            ids, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [
                (p, i, k)
                for p, i, data in zip(places, ids, _bodies(batch, "text"))
                for k in _long_keys(data, least)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], batch.schema.field(0).type),
                 pa.array([r[2] for r in rows], pa.binary())],
                names=["_place", "_id", "key"],
            )

    lines = docs.select("doc_id", "text", "_place").mapInArrow(split, f"_place bigint, _id {kind}, key binary")
    gone = lookup_join(lines, repeated.select("key", "keep_id"), ["key"])
    gone = gone.where(~F.col("_id").eqNullSafe(F.col("keep_id")))
    of_row = gone.groupBy("_place").agg(F.collect_list("key").alias("gone"))
    both = docs.join(of_row, "_place", "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            lists = [set(g or ()) for g in batch.column(2).to_pylist()]
            yield _digested(
                batch,
                lambda bodies, lists=lists: [
                    {i for i, k in enumerate(keys_of(b)) if k in g} if g else set()
                    for b, g in zip(bodies, lists)
                ],
            )

    return both.mapInArrow(run, schema)
