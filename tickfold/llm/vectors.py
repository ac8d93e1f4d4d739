"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pairs of
codewords are the cells of a product grid. Every vector is kept in its own cell and, as
a query, visits the cells nearest to it in the order of the multi-sequence traversal, as
many as are needed for the wanted recall of partners at the threshold. Candidates are
verified by their cosine in double precision.

Equal vectors are one class with a weight. A cell is cut into blocks, so that no task
holds more than a block, and a block returns counts and a forest of its links, never its
pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import numbered, small_batches, stored
from tickfold.llm.components import components

# Vectors the codebooks are fitted on, and codewords of a half at most.
SAMPLE = 20_000
CODEWORDS = 1024
CELL_VECTORS = 32  # wanted vectors in a cell
BLOCK = 1024  # indexed vectors in a block
VISITORS = 16_384  # queries that one block serves
RECALL = 0.98


def _classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as bytes of doubles; null for what can't be compared."""
    for batch in small_batches(batches, 4096):
        out = []
        for vector in batch.column("vector").to_pylist():
            raw = None
            if vector and None not in vector:
                x = np.array(vector, dtype=np.float64)
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # one zero, not two
            out.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("vec_id"), pa.array(out, pa.binary())],
            names=["_row", "vec_id", "raw"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :]
    return np.maximum(d, 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means codewords; an empty one stays where it was."""
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate(
            [_distances(x[i : i + 2048], words).argmin(1) for i in range(0, len(x), 2048)]
        )
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, x)
        sizes = np.bincount(nearest, minlength=k)
        words[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return words


class MultiIndex:
    """Codebooks of both halves, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float):
        rng = np.random.default_rng(11)
        self.dims = sample.shape[1]
        self.cut = max(1, self.dims // 2)
        k = int(np.clip(np.sqrt(rows / CELL_VECTORS), 1, min(CODEWORDS, len(sample))))
        self.words = [
            _codebook(half, min(k, len(np.unique(half, axis=0))), rng) for half in self.halves(sample)
        ]
        # Partners at the threshold in random directions are the hardest to meet.
        x = sample[rng.permutation(len(sample))[:2000]]
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)
        partner = cosine * x + np.sqrt(1 - cosine**2) * away
        own, cell = self.distances(x), self.cells(partner)
        at = own[0][np.arange(len(x)), cell[:, 0]] + own[1][np.arange(len(x)), cell[:, 1]]
        ranks = [
            1 + int(sum(np.searchsorted(np.sort(b), r - a, "left").sum() for a in a_row))
            for a_row, b, r in zip(own[0], own[1], at, strict=True)
        ]
        self.visits = int(np.ceil(np.quantile(ranks, recall)))

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut], x[:, self.cut :]] if self.dims > 1 else [x, np.zeros((len(x), 1))]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(h, w) for h, w in zip(self.halves(x), self.words, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([d.argmin(1) for d in self.distances(x)], axis=1)

    def number(self, cell) -> int:
        return int(cell[0]) * len(self.words[1]) + int(cell[1])

    def traverse(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], float]:
        """Nearest cells first, from the distances to the codewords of both halves.

        Returns the cells visited and the distance of the last one.
        """
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i_order], b[j_order]
        heap, out, reach = [(a[0] + b[0], 0, 0)], [], 0.0
        while heap and len(out) < self.visits:
            reach, i, j = heapq.heappop(heap)
            out.append(self.number((i_order[i], j_order[j])))
            # Each cell is pushed once: along its row, and down from the first column.
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out, float(reach)


def _index_rows(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("raw")))
            a, b = index.distances(x)
            visits, reach = [], []
            for row in range(len(x)):
                cells, far = index.traverse(a[row], b[row])
                visits.append(cells)
                reach.append(far)
            home = [index.number(c) for c in np.stack([a.argmin(1), b.argmin(1)], axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"), batch.column("weight"), batch.column("raw"),
                    pa.array(home, pa.int64()), pa.array(reach, pa.float64()),
                    pa.array(visits, pa.list_(pa.int64())),
                ],
                names=["cls", "weight", "raw", "home", "reach", "visits"],
            )

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that hold together what ``linked`` holds together."""
    rows_left, cols_left = linked.any(1), linked.any(0)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start], queue = False, [(True, int(start))]
        while queue:
            is_row, at = queue.pop()
            met = np.flatnonzero((linked[at] & cols_left) if is_row else (linked[:, at] & rows_left))
            (cols_left if is_row else rows_left)[met] = False
            out += [(at, int(m)) if is_row else (int(m), at) for m in met]
            queue += [(not is_row, int(m)) for m in met]
    return out


def _block_links(index: MultiIndex, cosine: float):
    """Counts ``a, null, n`` and links ``a, b, null`` of the blocks of a partition.

    Rows come sorted by block, indexed vectors before visitors.
    """

    def compare(block: pa.RecordBatch, seen: pa.RecordBatch) -> pa.RecordBatch | None:
        y, x = _matrix(block.column("raw")), _matrix(seen.column("raw"))
        y_id, x_id = block.column("cls").to_numpy(), seen.column("cls").to_numpy()
        norm = lambda m: np.sqrt((m * m).sum(1))
        # Scaled by the largest component, so that squares neither vanish nor overflow.
        y, x = (m / np.abs(m).max(axis=1, keepdims=True) for m in (y, x))
        linked = (x @ y.T >= cosine * norm(x)[:, None] * norm(y)[None, :]) & (x_id[:, None] != y_id[None, :])
        if not linked.any():
            return None
        # A pair is also met the other way if y visits the cell of x; it counts once.
        n_second = len(index.words[1])
        a, b = index.distances(_unit(y))
        home = seen.column("home").to_numpy()
        back = (a[:, home // n_second] + b[:, home % n_second]).T <= block.column("reach").to_numpy()[None, :]
        counted = linked & (~back | (x_id[:, None] < y_id[None, :]))
        to_x = counted @ block.column("weight").to_numpy()
        to_y = seen.column("weight").to_numpy() @ counted
        pairs = np.array(_forest(linked), dtype=np.int64).reshape(-1, 2)
        counts = [(i, n) for i, n in zip(np.append(x_id, y_id), np.append(to_x, to_y), strict=True) if n]
        none = [None] * len(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(i) for i, _ in counts] + x_id[pairs[:, 0]].tolist(), pa.int64()),
                pa.array([None] * len(counts) + y_id[pairs[:, 1]].tolist(), pa.int64()),
                pa.array([int(n) for _, n in counts] + none, pa.int64()),
            ],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in small_batches(batches, 2048):
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "i_part", "v_part")], axis=1)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((key[1:] != key[:-1]).any(1) | (visitor[1:] != visitor[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, len(key)], strict=True):
                if lo == hi:
                    continue
                piece, at = batch.slice(lo, hi - lo), tuple(key[lo])
                if at != now:
                    now, parts = at, []
                if not visitor[lo]:
                    parts.append(piece)
                elif parts:
                    if len(parts) > 1:
                        parts = [pa.Table.from_batches(parts).combine_chunks().to_batches()[0]]
                    if (out := compare(parts[0], piece)) is not None:
                        yield out

    return run


def _parts(n: str, size: int):
    return F.ceil(F.col(n) / size).cast("int")


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors with this cosine or more are linked. ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest id reachable, ``kept`` marks it.
    Null and zero vectors and those with null or non-finite components are linked with
    nothing, others with those of their own size only. Null ids take part and stand for
    a component only if it has no other; repeated rows are vectors of their own, of which
    the first is kept. An empty table gives no rows. ``vectors`` must come from stored files.
    """
    rows = stored(
        numbered(vectors)
        .select("_row", F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
        .mapInArrow(_classes_of, "_row bigint, vec_id bigint, raw binary"),
        "vectors",
    )
    classes = stored(
        rows.where("raw is not null").groupBy("raw").agg(F.min("_row").alias("cls"), F.count("*").alias("weight")),
        "classes",
    )
    found = vectors.sparkSession.createDataFrame([], "cls bigint, n_links bigint, grp bigint")
    # An index for each size of vectors that occurs.
    for r in classes.groupBy(F.length("raw").alias("wide")).agg(F.count("*").alias("n")).orderBy("wide").collect():
        alike = classes.where(F.length("raw") == r.wide)
        # The codebooks' sample: SAMPLE rows at most, by hash.
        drawn = alike.select("cls", "raw").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).collect()
        sample = _unit(np.stack([np.frombuffer(d.raw) for d in drawn]))
        found = found.union(_class_links(alike, MultiIndex(sample, r.n, cosine, recall), cosine))
    member = stored(
        rows.join(classes.join(found, "cls", "left").select("raw", "cls", "weight", "n_links", "grp"), "raw", "left").select(
            "_row", "vec_id",
            (F.coalesce("n_links", F.lit(0)) + F.when(F.col("grp").isNotNull(), F.col("weight") - 1).otherwise(0)).alias("n_links"),
            F.coalesce("grp", F.col("_row")).alias("grp"),
        ),
        "members",
    )
    heads = stored(
        member.groupBy("grp").agg(F.min(F.struct(F.isnull("vec_id").alias("none"), "vec_id", "_row")).alias("head")),
        "heads",
    )
    return member.join(heads, "grp").select(
        "vec_id", "n_links", F.col("head.vec_id").alias("component_id"), (F.col("_row") == F.col("head._row")).alias("kept")
    )


def _class_links(classes: DataFrame, index: MultiIndex, cosine: float) -> DataFrame:
    """``cls, n_links`` (to other classes, by weight) and ``grp`` of every class."""
    placed = stored(
        classes.select("cls", "weight", "raw").mapInArrow(
            _index_rows(index),
            "cls bigint, weight bigint, raw binary, home bigint, reach double, visits array<bigint>",
        ),
        "index",
    )
    indexed = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n"))
    visited = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("v"))
    cells = stored(
        indexed.join(visited, "cell").select(
            "cell", _parts("n", BLOCK).alias("i_parts"), _parts("v", VISITORS).alias("v_parts")
        ),
        "cells",
    )
    slim = ["cls", "weight", "raw", "home", "reach"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    kept = placed.select(F.col("home").alias("cell"), *slim).join(cells, "cell").select(
        "cell", part("i_parts").alias("i_part"), every("v_parts").alias("v_part"), F.lit(False).alias("visitor"), *slim
    )
    # Cells without vectors drop out before the vectors are copied to the visited ones.
    calls = placed.select("cls", F.explode("visits").alias("cell")).join(cells, "cell").select(
        "cls", "cell", every("i_parts").alias("i_part"), part("v_parts").alias("v_part")
    )
    visitors = calls.join(placed.select(*slim), "cls").select(
        "cell", "i_part", "v_part", F.lit(True).alias("visitor"), *slim
    )
    links = stored(
        kept.union(visitors)
        .repartition("cell", "i_part", "v_part")
        .sortWithinPartitions("cell", "i_part", "v_part", "visitor")
        .mapInArrow(_block_links(index, cosine), "a bigint, b bigint, n bigint"),
        "links",
    )
    counts = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    groups = components(links.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("cls", "grp")
    return classes.select("cls").join(counts, "cls", "left").join(groups, "cls", "left").select(
        "cls", "n_links", F.coalesce("grp", "cls").alias("grp")
    )
