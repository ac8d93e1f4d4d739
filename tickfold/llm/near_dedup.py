"""Near-duplicate documents by a chosen-path similarity join.

A document is its set of distinct five-word shingles, shown by ``COORDINATES`` minimum
hash values. In every tree a node chooses, by a hash of its own, about ``1 / similarity``
of a document's minimum values and sends the document on to a child for each. Similar
documents choose the same children often, others hardly ever. A child of few documents is
compared exhaustively, a larger one branches again down to ``DEPTH``. Independent trees are
repeated until a pair at the threshold is met with the wanted probability. What is met is
estimated from the minimum values and from odd sketches (the parity of a set's hashes in
each of some bits), and what may be similar enough is confirmed on full sets.

Only links that may join two groups matter for the groups, so a node offers a forest of
the likely links first. After those are confirmed, nodes that still hold different groups
are looked at again: documents that may be linked to another group get their full sets,
are compared inside the node, and a forest of the true links leaves it. So what leaves a
node grows with its documents, also where many of them are just below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import keep_rows, numbered, result_of, small_batches, stored, texts_of
from tickfold.llm.components import components

WORDS = 5
COORDINATES = 128
NODE_DOCS = 256  # Larger nodes branch, and are compared in blocks at the last depth.
BLOCK_DOCS = 512  # Documents of a block; a task holds two blocks of sketches at a time.
LOOK_SHINGLES = 1 << 19  # Shingles of documents compared on full sets at a time, or two documents.
DEPTH = 3
ODD_BITS = 1024
RECALL = 0.99
SIGNED = np.uint64(1 << 63)

_rng = np.random.default_rng(20240501)
_FACTORS = (_rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_MASKS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_LANE = np.arange(COORDINATES, dtype=np.uint64)[None, :]


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing permutation of 64-bit numbers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWER = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTES = _mix(_LOWER + np.uint64(1000))


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd factor modulo 2**64."""
    return np.cumprod(np.full(n, _POWER, dtype=np.uint64))


_FEW_POWERS = _powers(256)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each maximal run of bytes that are not white space, A-Z lower-cased."""
    inside = ~_SPACES[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    if not len(edges):
        return np.zeros(0, dtype=np.uint64)
    raw, inside = raw[edges[0] :], inside[edges[0] :]
    starts, ends = edges[::2] - edges[0], edges[1::2] - edges[0]
    # Bytes weighted by their place in the word, so equal words have equal sums.
    runs = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, runs)
    powers = _FEW_POWERS if runs.max() <= len(_FEW_POWERS) else _powers(int(runs.max()))
    value = _BYTES[raw] * powers[place]
    value[~inside] = 0
    return _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of all words if there are fewer."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hashes = _word_hashes(raw)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    mixed = np.full(n, min(len(hashes), words), dtype=np.uint64)
    for k in range(min(words, len(hashes))):
        mixed = _mix(mixed * np.uint64(31) + hashes[k : k + n])
    return np.unique(mixed)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every coordinate's hash over a set that is not empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), 2048):
        part = (short[start : start + 2048][None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities; those of two sets differ where their symmetric difference falls."""
    bits = np.bincount(((shingles >> np.uint64(20)) % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits((bits & 1).astype(np.uint8)).tobytes()


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sizes, low, high, minima, odd = [], [], [], [], []
        for text in texts_of(batch, "text"):
            s = shingle_hashes(text)
            sizes.append(len(s))
            low.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
            high.append(int(_mix(s ^ SIGNED).sum(dtype=np.uint64)) if len(s) else 0)
            minima.append(_minima(s).tobytes() if len(s) else None)
            odd.append(_odd_sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_row"), batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                _longs(np.array(low, dtype=np.uint64)), _longs(np.array(high, dtype=np.uint64)),
                pa.array(minima, pa.binary()), pa.array(odd, pa.binary()),
            ],
            names=["_row", "doc_id", "n", "low", "high", "minima", "odd"],
        )


def trees_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Trees after which a pair at the threshold has met in one with this probability.

    A pair shares on average one chosen value per node, nearly Poisson distributed. It has
    to survive all ``depth`` branchings where nodes are large, the one of the root included.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _branch(trees: int, similarity: float, root: bool):
    """Children of documents in all roots, or in their nodes ``key``."""
    limit = np.uint64(int(2**64 / (similarity * COORDINATES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2048):
            if not batch.num_rows:
                continue
            cls = batch.column("cls").to_numpy()
            values = np.frombuffer(b"".join(batch.column("minima").to_pylist()), dtype=np.uint32)
            tokens = _mix(values.reshape(-1, COORDINATES).astype(np.uint64) + (_LANE << np.uint64(32)))
            if root:
                nodes = [_mix(np.full((1, 1), 77 + t, dtype=np.uint64)) for t in range(trees)]
            else:
                nodes = [_mix(batch.column("key").to_numpy().view(np.uint64))[:, None]]
            keys, rows = [], []
            for node in nodes:
                draw = _mix(tokens ^ node)
                r, c = np.nonzero(draw < limit)
                keys.append(_mix(draw[r, c] + np.uint64(1)))
                rows.append(cls[r])
            yield pa.RecordBatch.from_arrays(
                [_longs(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "cls"]
            )

    return run


def _nodes(reps: DataFrame, similarity: float, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """``key, cls`` of nodes with two documents or more: small ones, and large ones."""
    minima = reps.select("cls", "minima")
    # A document gets no key twice: a key is drawn from the parent, the coordinate and its value.
    level = stored(minima.mapInArrow(_branch(trees, similarity, True), "key bigint, cls bigint"), "paths")
    small = []
    for depth in range(1, DEPTH + 1):
        sizes = stored(
            level.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1"), "sizes"
        )
        joined = level.join(sizes, "key")
        small.append(joined.where(F.col("docs") <= NODE_DOCS).select("key", "cls"))
        if sizes.where(F.col("docs") > NODE_DOCS).isEmpty():
            return _union(small), None
        large = joined.where(F.col("docs") > NODE_DOCS)
        if depth < DEPTH:
            level = stored(
                large.select("key", "cls")
                .join(minima, "cls")
                .mapInArrow(_branch(1, similarity, False), "key bigint, cls bigint"),
                "paths",
            )
    return _union(small), large


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _likely(similarity: float) -> int:
    """Equal coordinates below which a pair at the threshold is very unlikely."""
    spread = math.sqrt(similarity * (1 - similarity) / COORDINATES)
    return math.floor(COORDINATES * (similarity - 3.3 * spread))


def _most_odd(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Differing parities above which two sets at the threshold are very unlikely.

    With all shingles different in ``d`` places, their mean is that of ``d`` balls in
    ODD_BITS bins; large differences fill the bins and rule out nothing.
    """
    d = sizes * ((1 - similarity) / (1 + similarity))
    gone = np.exp(-2 * d / ODD_BITS)
    spread = np.sqrt(np.maximum(ODD_BITS / 4 * (1 - gone**2) - d * gone**2, 0))
    return ODD_BITS / 2 * (1 - gone) + 3.5 * spread + 2


def _forest(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Links of each tree over ``m`` rows; ``near`` gives the rows among some that a row links to.

    Breadth first: whatever is linked to a row that was reached is reached through it or was before.
    """
    waiting = np.arange(m)
    while len(waiting):
        queue, links = [int(waiting[0])], []
        waiting = waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            found = near(i, waiting)
            if len(found):
                links += [(i, int(j)) for j in found]
                waiting = np.setdiff1d(waiting, found, assume_unique=True)
                queue += found.tolist()
        if links:
            yield links


def _comparable(i: int, where: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """Rows of other groups whose sizes allow a link.

    Rows of different ``side`` above zero are compared with each other only, as each
    side is also a node of its own.
    """
    return where[
        (np.minimum(n[where], n[i]) >= similarity * 0.999 * np.maximum(n[where], n[i]))
        & (group[where] != group[i])
        & ((side[where] != side[i]) | (side[where] == 0))
    ]


def _near_by_sketch(sketch: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray, similarity: float):
    """Likely links of a row, by what the sketches estimate."""
    least = _likely(similarity)
    values, odd = sketch[:, :COORDINATES], np.ascontiguousarray(sketch[:, COORDINATES:])

    def near(i: int, where: np.ndarray) -> np.ndarray:
        rows = _comparable(i, where, n, group, side, similarity)
        rows = rows[(values[rows] == values[i]).sum(axis=1) >= least]
        differ = np.bitwise_count(odd[rows] ^ odd[i]).sum(axis=1, dtype=np.int64)
        return rows[differ <= _most_odd(n[rows] + n[i], similarity)]

    return near


def _near_by_sets(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int):
    """True links of a row, by counting common shingles."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat.astype(np.int32), np.cumsum(n)[:-1])
    mark = np.zeros(len(words), dtype=bool)

    def near(i: int, where: np.ndarray) -> np.ndarray:
        rows = _comparable(i, where, n, group, side, percent / 100)
        if not len(rows):
            return rows
        mark[own[i]] = True
        starts = np.cumsum(n[rows]) - n[rows]
        common = np.add.reduceat(mark[np.concatenate([own[j] for j in rows])], starts, dtype=np.int64)
        mark[own[i]] = False
        return rows[100 * common >= percent * (n[rows] + n[i] - common)]

    return near


def _by_node(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], size: int):
    """``work`` on the rows of whole nodes, in a partition sorted by ``keys``; a node is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            return work(pa.Table.from_batches(rows).combine_chunks())

        for batch in small_batches(batches, size):
            if not batch.num_rows:
                continue
            # Whole nodes leave; the last one of the batch may go on in the next.
            columns = [batch.column(k).to_numpy() for k in keys]
            last = np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in columns]))[0]
            if last == 0 and held and all(held[-1].column(k)[-1].as_py() == c[-1] for k, c in zip(keys, columns, strict=True)):
                held.append(batch)
                continue
            if held or last:
                yield done([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield done(held)

    return run


def _cuts(t: pa.Table, keys: list[str]) -> Iterator[slice]:
    """The nodes of two rows or more."""
    changed = np.logical_or.reduce([np.diff(t.column(k).to_numpy()) != 0 for k in keys])
    cuts = np.flatnonzero(changed) + 1
    for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True):
        if b - a > 1:
            yield slice(a, b)


def _trees_of_nodes(t: pa.Table, similarity: float) -> Iterator[tuple[slice, list[list[tuple[int, int]]]]]:
    """Nodes with the trees of their likely links between different groups."""
    n, group, side = (t.column(c).to_numpy() for c in ("n", "grp", "side"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(
        -1, COORDINATES + ODD_BITS // 8
    )
    for at in _cuts(t, ["key", "sub"]):
        if (group[at] != group[at.start]).any():
            near = _near_by_sketch(sketch[at], n[at], group[at], side[at], similarity)
            yield at, list(_forest(at.stop - at.start, near))


def _pairs(cls: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.sort(cls[np.array(links, dtype=np.int64).reshape(-1, 2)], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _likely_forest(similarity: float):
    def work(t: pa.Table) -> pa.RecordBatch:
        links = [
            (at.start + i, at.start + j) for at, trees in _trees_of_nodes(t, similarity) for tree in trees for i, j in tree
        ]
        return _pairs(t.column("cls").to_numpy(), links)

    return _by_node(["key", "sub"], work, 4096)


def _chunks(members: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    """Members in runs of ``most`` shingles at most, or of one document."""
    chunks, room = [], 0
    for i in members:
        if not chunks or n[i] > room:
            chunks.append([])
            room = most
        chunks[-1].append(i)
        room -= n[i]
    return [np.array(c) for c in chunks]


def _looks(similarity: float):
    """``key, sub, part, cls, side, grp`` of documents that may be linked to another group.

    A part is a tree of likely links. One with more shingles than a task may hold is cut
    into chunks, and each two of them are a part of their own.
    """

    def work(t: pa.Table) -> pa.RecordBatch:
        n, part, rows, sides = t.column("n").to_numpy(), [], [], []
        side, number = t.column("side").to_numpy(), 0

        def add(where: np.ndarray, of: np.ndarray) -> None:
            rows.append(where)
            sides.append(of)
            part.append(np.full(len(where), number, dtype=np.int32))

        for at, trees in _trees_of_nodes(t, similarity):
            number = 0
            for tree in trees:
                members = at.start + np.unique(np.array(tree))
                chunks = [members]
                if n[members].sum() > LOOK_SHINGLES:
                    chunks = _chunks(members, n, LOOK_SHINGLES // 2)
                for x, chunk in enumerate(chunks):
                    if len(chunk) > 1:
                        number += 1
                        add(chunk, side[chunk])
                    for other in chunks[x + 1 :]:
                        number += 1
                        add(chunk, np.full(len(chunk), 1, dtype=side.dtype))
                        add(other, np.full(len(other), 2, dtype=side.dtype))
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(t.column("key").to_numpy()[at]), pa.array(t.column("sub").to_numpy()[at]),
                pa.array(np.concatenate(part) if part else np.zeros(0, dtype=np.int32)),
                pa.array(t.column("cls").to_numpy()[at]),
                pa.array(np.concatenate(sides) if sides else side[at]),
                pa.array(t.column("grp").to_numpy()[at]),
            ],
            names=["key", "sub", "part", "cls", "side", "grp"],
        )

    return _by_node(["key", "sub"], work, 4096)


def _true_forest(percent: int):
    """Links of each part that join its groups, confirmed on the full sets."""

    def work(t: pa.Table) -> pa.RecordBatch:
        group, side = t.column("grp").to_numpy(), t.column("side").to_numpy()
        links = []
        for at in _cuts(t, ["key", "sub", "part"]):
            # Views of the batch; the sets are not copied.
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in t.column("shingles")[at]]
            near = _near_by_sets(sets, group[at], side[at], percent)
            links += [(at.start + i, at.start + j) for tree in _forest(len(sets), near) for i, j in tree]
        return _pairs(t.column("cls").to_numpy(), links)

    return _by_node(["key", "sub", "part"], work, 128)


def _node_rows(nodes: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of nodes with what is compared, and the group each is in by now."""
    return nodes.join(
        reps.select("cls", "n", "sketch").join(groups, "cls", "left").withColumn(
            "grp", F.coalesce("grp", "cls")
        ),
        "cls",
    )


def _block_pairs(large: DataFrame, reps: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Large nodes as pairs of blocks: ``key, sub, cls, side``.

    A block holds documents of one band of sizes. Similar documents are in the same band
    or in neighbouring ones, so blocks of other bands are not paired.

    A group with many members in a node has blocks of its own, which need no comparison
    with each other; all other documents share blocks. So a node whose documents are
    one group has no pair at all.
    """
    # A band is a little wider than the threshold allows, so rounding loses no pair.
    band = F.floor(F.log("n") / -math.log(similarity * 0.999)).cast("int").alias("band")
    rows = large.select("key", "cls").join(reps.select("cls", band), "cls").join(groups, "cls", "left").withColumn(
        "grp", F.coalesce("grp", "cls")
    )
    shares = rows.groupBy("key", "band", "grp").agg(F.count("*").alias("members"))
    shares = stored(
        shares.withColumn("own", F.when(F.col("members") > NODE_DOCS // 4, F.col("grp"))).select(
            "key", "band", "grp", "own", "members"
        ),
        "shares",
    )
    mixed = shares.groupBy("key", "band", "own").agg(F.sum("members").alias("members"))
    blocks = stored(
        mixed.select(
            "key", "band", "own",
            F.ceil(F.col("members") / BLOCK_DOCS).cast("int").alias("parts"),
        ),
        "blocks",
    )
    placed = stored(
        rows.join(shares.select("key", "band", "grp", "own"), ["key", "band", "grp"])
        .join(
            blocks.select("key", "band", F.col("own").alias("o"), "parts"),
            (F.col("own").eqNullSafe(F.col("o"))) & (rows["key"] == blocks["key"]) & (rows["band"] == blocks["band"]),
        )
        .select(
            rows["key"], "cls",
            F.struct(rows["band"], "own", F.pmod(F.xxhash64("cls", rows["key"]), F.col("parts")).alias("part")).alias("block"),
        ),
        "placed",
    )
    each = stored(placed.select("key", "block").distinct(), "each")
    left, right = (each.select("key", F.col("block").alias(c)) for c in ("i", "j"))
    pairs = left.join(right, "key").where(
        "i <= j and j.band - i.band <= 1 and not (i.own is not null and j.own is not null and i.own = j.own)"
    )
    pairs = stored(pairs.withColumn("sub", F.xxhash64("i.band", "i.own", "i.part", "j.band", "j.own", "j.part")), "pairs")
    one = placed.join(pairs.select("key", F.col("i").alias("block"), "sub", (F.col("i") == F.col("j")).alias("alone")), ["key", "block"])
    two = placed.join(pairs.where("i <> j").select("key", F.col("j").alias("block"), "sub"), ["key", "block"])
    return one.select("key", "sub", "cls", F.when(F.col("alone"), 0).otherwise(1).alias("side")).union(
        two.select("key", "sub", "cls", F.lit(2).alias("side"))
    )


def _ordered(rows: DataFrame, keys: list[str], *others: str) -> DataFrame:
    """Rows with equal ``keys`` one after the other in one partition."""
    return rows.select(*keys, "cls", "side", "grp", *others).repartition(*keys).sortWithinPartitions(*keys, "cls")


def _likely_links(rows: DataFrame, similarity: float) -> DataFrame:
    ordered = _ordered(rows, ["key", "sub"], "n", "sketch")
    return ordered.mapInArrow(_likely_forest(similarity), "a bigint, b bigint").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sets = [shingle_hashes(t).tobytes() for t in texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sets, pa.binary())], names=["cls", "shingles"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                yes.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


class _Verifier:
    """Confirms links on full sets, which are made once for every document asked for."""

    def __init__(self, docs: DataFrame, percent: int):
        self.docs, self.percent = docs, percent
        self.sets: DataFrame | None = None

    def _ensure(self, asked: DataFrame) -> None:
        asked = asked.distinct()
        if self.sets is not None:
            asked = stored(asked.join(self.sets.select("cls"), "cls", "left_anti"), "asked")
            if asked.isEmpty():
                return
        texts = self.docs.join(asked.select(F.col("cls").alias("_row")), "_row", "left_semi")
        made = stored(texts.select("_row", "text").mapInArrow(_sets, "cls bigint, shingles binary"), "sets")
        self.sets = made if self.sets is None else self.sets.union(made)

    def __call__(self, links: DataFrame) -> DataFrame:
        self._ensure(links.select(F.col("a").alias("cls")).union(links.select("b")))
        pairs = links.join(self.sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(
            self.sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b"
        )
        return stored(
            pairs.select("a", "b", "x", "y").mapInArrow(_confirmed(self.percent), "a bigint, b bigint, linked boolean"),
            "confirmed",
        )

    def inside(self, rows: DataFrame, similarity: float) -> DataFrame:
        """A forest of the true links between the groups of each node."""
        ordered = _ordered(rows, ["key", "sub"], "n", "sketch")
        looks = stored(
            ordered.mapInArrow(
                _looks(similarity), "key bigint, sub bigint, part int, cls bigint, side int, grp bigint"
            ),
            "looks",
        )
        self._ensure(looks.select("cls"))
        full = _ordered(looks.join(self.sets, "cls"), ["key", "sub", "part"], "shingles")
        return stored(full.mapInArrow(_true_forest(self.percent), "a bigint, b bigint").distinct(), "true")


def near_dedup(
    docs: DataFrame, percent: int = 85, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``_row, doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets have ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable. Documents without words are linked
    with nothing. Null ids take part; they stand for a group only if it has no other id.
    Of rows with the same id in one group the first one is kept. An empty table gives no
    rows. ``docs`` must come from stored files, as its rows are numbered where it is read.
    """
    similarity = percent / 100
    texts = numbered(docs).select(
        "_row", F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    signed = stored(
        texts.mapInArrow(
            _signatures, "_row bigint, doc_id bigint, n bigint, low bigint, high bigint, minima binary, odd binary"
        ),
        "signatures",
    )
    # Documents of equal sets are one class; the join works on classes.
    classes = signed.where("n > 0").groupBy("n", "low", "high").agg(
        F.min("_row").alias("cls"), F.first("minima").alias("minima"), F.first("odd").alias("odd")
    )
    # The one table of classes: what is drawn from and compared is written once.
    reps = stored(
        classes.mapInArrow(
            _short_sketches, "n bigint, low bigint, high bigint, cls bigint, minima binary, sketch binary"
        ),
        "reps",
    )
    small, large = _nodes(reps, similarity, trees_for(recall, similarity))
    nodes = small.select("key", F.lit(0).cast("bigint").alias("sub"), "cls", F.lit(0).alias("side"))
    groups = docs.sparkSession.createDataFrame([], "cls bigint, grp bigint")
    first = nodes
    if large is not None:
        large = stored(large.select("key", "cls", "docs"), "large")
        parts = F.ceil(F.col("docs") / NODE_DOCS)
        first = nodes.union(
            large.select(
                "key", (1 + F.pmod(F.xxhash64("cls", "key"), parts)).cast("bigint"), "cls", F.lit(0)
            )
        )
    nodes, first = stored(nodes, "nodes"), stored(first, "first")
    verify = _Verifier(texts, percent)
    tried = verify(stored(_likely_links(_node_rows(first, reps, groups), similarity), "links"))
    if not tried.isEmpty() or large is not None:
        links = tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        groups = stored(components(links).toDF("cls", "grp"), "groups")
        rest = nodes if large is None else nodes.union(_block_pairs(large, reps, groups, similarity))
        rest = _node_rows(rest, reps, groups)
        # Nodes that are one group by now need no further look.
        open_nodes = stored(
            rest.groupBy("key", "sub").agg(F.min("grp").alias("low"), F.max("grp").alias("top"))
            .where("low <> top").select("key", "sub"),
            "open",
        )
        more = verify.inside(rest.join(open_nodes, ["key", "sub"], "left_semi"), similarity)
        if not more.isEmpty():
            groups = stored(components(links.union(more)).toDF("cls", "grp"), "groups")
    # Back to rows: class, group, and the smallest id of the group.
    rows = signed.select("_row", "doc_id", "n", "low", "high")
    of_class = stored(
        reps.select("n", "low", "high", "cls").join(groups, "cls", "left")
        .select("n", "low", "high", F.coalesce("grp", "cls").alias("grp")),
        "of_class",
    )
    member = stored(
        rows.join(of_class, ["n", "low", "high"], "left").select(
            "_row", "doc_id", "n", F.coalesce("grp", F.col("_row")).alias("grp")
        ),
        "members",
    )
    heads = stored(
        member.groupBy("grp").agg(
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("head")
        ),
        "heads",
    )
    return member.join(heads, "grp").select(
        "_row", "doc_id", F.col("n").alias("n_shingles"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("_row") == F.col("head._row")).alias("kept"),
    )


def _short_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what pairs are estimated from: low bytes of the coordinates, and the odd sketch."""
    for batch in batches:
        minima, odd = batch.column("minima").to_pylist(), batch.column("odd").to_pylist()
        sketch = [
            np.frombuffer(m, dtype=np.uint32).astype(np.uint8).tobytes() + o
            for m, o in zip(minima, odd, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("n", "low", "high", "cls", "minima")), pa.array(sketch, pa.binary())],
            names=["n", "low", "high", "cls", "minima", "sketch"],
        )


def drop_near_copies(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, in its own columns."""
    kept = result_of(
        lambda: near_dedup(docs, percent, id_col=id_col, text_col=text_col).where("kept").select("_row"),
        docs.sparkSession, "kept",
    )
    return keep_rows(docs, kept)
