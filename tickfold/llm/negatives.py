"""Hard negatives by inner product, searched in cover trees.

An extra component gives all candidates the same norm, so that the angle to an anchor
orders them as the inner product does. Each tree covers at most ``TREE_ROWS`` candidates
that lie together; a node knows the largest angle from its center to what it covers,
which bounds every inner product below it from both sides. The roots' bounds choose the
trees that an anchor visits, those of the nodes below the pieces that are verified.

Anchors are compared in blocks, as products of matrices that stay exact. A task takes a
block past one tree after the other, and what it has found raises what it still looks for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickfold.llm.common import stored

TREE_ROWS = 8192
# Rows a length of vectors gives as places to deal its candidates to.
PIVOTS = 64
LEAF = 64
FAN = 32
# Anchors and candidates of one product.
BLOCK = 256
PIECE = 1024
# Anchors that a task takes past the trees together, about; twice as many at most.
GROUP_ANCHORS = 4096
# Anchors that show whether the bounds below a root rule out much.
PROBE = 64
# Rows of a tree are compared label by label where the labels have as many on average.
LABEL_ROWS = 64
# Angles are worked out to about 1e-8.
SLACK = 1e-6
EXACT = 2.0**53
EXACT_SINGLE = 2.0**24
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

FOUND = "rid bigint, at int, score bigint, id bigint"


# -- one tree -----------------------------------------------------------------------


def _unit(v: np.ndarray, norm: float | None = None) -> tuple[np.ndarray, float]:
    """Rows with the extra component, scaled to length one, and their common norm.

    Without ``norm`` that is the largest of the rows.
    """
    square = np.einsum("ij,ij->i", v, v)
    top = float(square.max(initial=0.0)) if norm is None else norm**2
    if top == 0.0:
        unit = np.zeros((len(v), v.shape[1] + 1))
        unit[:, -1] = 1.0
        return unit, 0.0
    full = np.concatenate([v, np.sqrt(np.maximum(top - square, 0.0))[:, None]], axis=1)
    return full / np.linalg.norm(full, axis=1, keepdims=True), float(np.sqrt(top))


def _angles(unit: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ center, -1.0, 1.0))


def _cover(unit: np.ndarray, rows: np.ndarray, radius: float, first: int):
    """Rows dealt to centers that lie more than half of ``radius`` apart, the first given.

    Each row goes to its nearest center; with ``FAN`` centers the rest is taken too.
    """
    points = unit[rows]
    centers, best = [first], _angles(points, unit[first])
    owner = np.zeros(len(rows), np.int64)
    while len(centers) < FAN:
        far = int(best.argmax())
        if best[far] <= radius / 2:
            break
        gap = _angles(points, unit[rows[far]])
        closer = gap < best
        # Rounding must not leave a center to another one.
        closer[far] = True
        owner[closer], best[closer] = len(centers), gap[closer]
        centers.append(int(rows[far]))
    for i, center in enumerate(centers):
        yield center, rows[owner == i]


def build_tree(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    """A tree over the rows: nodes with parents before children, leaves as row ranges."""
    unit, norm = _unit(v)
    parent, center, radius, start, stop, order = [], [], [], [], [], []
    todo = [(-1, 0, np.arange(len(v)))]
    while todo:
        up, middle, rows = todo.pop()
        reach = float(_angles(unit[rows], unit[middle]).max()) if len(rows) else 0.0
        here = len(parent)
        parent.append(up)
        center.append(middle)
        radius.append(reach)
        start.append(len(order))
        if len(rows) <= LEAF or reach <= SLACK:
            order.extend(rows.tolist())
            stop.append(len(order))
        else:
            stop.append(-1)
            todo.extend((here, c, part) for c, part in _cover(unit, rows, reach, middle) if len(part))
    leaf = np.nonzero(np.array(stop) >= 0)[0]
    order = np.array(order, np.int64)
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    labels = labels[order]
    # Children come after their parents, the last rows of a node with its first child.
    begin, end = np.array(start), np.array(stop)
    for node in range(len(parent) - 1, 0, -1):
        end[parent[node]] = max(end[parent[node]], end[node])
    start, stop = begin[leaf], end[leaf]
    pure = np.array([np.all(labels[a:b] == labels[a]) for a, b in zip(start, stop)], bool)
    return {
        "ids": ids[order], "labels": labels, "v": v[order], "norm": norm,
        "parent": np.array(parent), "center": unit[center], "radius": np.array(radius),
        "middle": place[center], "begin": begin, "end": end, "leaf": leaf, "start": start, "stop": stop, "pure": pure,
    }


def _whole(v: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type of whole ones that holds them, if one does."""
    for kind in (np.int8, np.int16, np.int32):
        if v.min(initial=0) >= np.iinfo(kind).min and v.max(initial=0) <= np.iinfo(kind).max:
            small = v.astype(kind)
            return small if (small == v).all() else v
    return v


def pack_tree(tree: dict) -> bytes:
    """A tree without its centers, which are rows of it."""
    return pickle.dumps({n: x for n, x in tree.items() if n != "center"} | {"v": _whole(tree["v"])}, protocol=5)


def unpack_tree(blob) -> dict:
    tree = pickle.loads(blob)
    tree["small"], tree["v"] = tree["v"], tree["v"].astype(float)
    tree["center"] = _unit(tree["v"])[0][tree["middle"]]
    return tree


def node_bounds(tree: dict, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with what each node covers."""
    size = np.linalg.norm(q, axis=1)
    unit = np.zeros((len(q), q.shape[1] + 1))
    unit[:, :-1] = q / np.where(size > 0, size, 1.0)[:, None]
    # Cosines and sines of the angles to the centers and of the nodes' reach.
    cos = np.clip(unit @ tree["center"].T, -1.0, 1.0)
    sin = np.sqrt(1.0 - cos * cos)
    reach = np.minimum(tree["radius"] + SLACK, np.pi)
    whole = (size * tree["norm"])[:, None]
    slack = whole * 1e-12
    along, across = cos * np.cos(reach), sin * np.sin(reach)
    high = whole * np.where(cos >= np.cos(reach), 1.0, along + across) + slack
    low = whole * np.where(cos <= -np.cos(reach), -1.0, along - across) - slack
    # What a node covers its parent covers too.
    for node in range(1, len(tree["parent"])):
        up = tree["parent"][node]
        np.minimum(high[:, node], high[:, up], out=high[:, node])
        np.maximum(low[:, node], low[:, up], out=low[:, node])
    return low, high


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if v.size == 0 or np.abs(v).max() * np.abs(q).max() * v.shape[1] < EXACT:
        return (v @ q).astype(np.int64)
    wide = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row, wide)) for row in v], np.int64)


class _Query:
    """The scores of one anchor in one tree, worked out leaf by leaf as they are needed."""

    def __init__(self, tree: dict, anchor: dict, low: np.ndarray, high: np.ndarray, same: bool):
        self.tree, self.q, self.known = tree, anchor["v"], {}
        mine = tree["labels"] == anchor["label"]
        first = tree["labels"][tree["start"]] == anchor["label"]
        self.open = ~tree["pure"] | (first if same else ~first)
        self.fits = (mine if same else ~mine) & (tree["ids"] != anchor["id"])
        self.low, self.high = low[tree["leaf"]], high[tree["leaf"]]

    def of_leaf(self, i: int):
        if i not in self.known:
            part = slice(self.tree["start"][i], self.tree["stop"][i])
            fits = self.fits[part]
            self.known[i] = _scores(self.tree["v"][part][fits], self.q), self.tree["ids"][part][fits]
        return self.known[i]

    def best(self, k: int, floor: int | None, ceiling: int | None, least: int | None):
        """The first ``k`` scores from ``floor`` to ``ceiling``; those below ``least`` don't count."""
        top = self.high if ceiling is None else np.minimum(self.high, ceiling)
        under = [x for x in (floor, least) if x is not None]
        may = self.open.copy()
        if ceiling is not None:
            may &= self.low <= ceiling
        if under:
            may &= self.high >= max(under)
        leaves = np.nonzero(may)[0]
        leaves = leaves[np.argsort(-top[leaves], kind="stable")]
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(leaves), 8):
            # Ties go to the smaller id, so equal bounds are still looked into.
            if len(scores) == k and top[leaves[at]] < scores[-1]:
                break
            found = [self.of_leaf(i) for i in leaves[at : at + 8]]
            s = np.concatenate([scores, *(f[0] for f in found)])
            i = np.concatenate([ids, *(f[1] for f in found)])
            keep = np.ones(len(s), bool)
            if ceiling is not None:
                keep &= s <= ceiling
            if under:
                keep &= s >= max(under)
            s, i = s[keep], i[keep]
            first = np.lexsort((i, -s))[:k]
            scores, ids = s[first], i[first]
        return scores, ids


# -- candidates dealt to trees --------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0))


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds ``tree``: rows of one length near the same pivot, cut by hash where they are many."""
    spark = rows.sparkSession
    first = Window.partitionBy("dims").orderBy(F.xxhash64("rid"), "rid")
    chosen = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= PIVOTS)
    pivots: dict[int, list] = {}
    for r in chosen.select("dims", "v").toLocalIterator():
        pivots.setdefault(r["dims"], []).append(r["v"])
    units = {}
    for dims, some in pivots.items():
        p = np.array(some, float).reshape(len(some), dims)
        units[dims] = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
    names = {dims: i for i, dims in enumerate(sorted(units))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            cell = np.zeros(len(sizes), np.int32)
            for dims in np.unique(sizes):
                at = np.nonzero(sizes == dims)[0]
                v = _matrix(batch.column("v").take(pa.array(at)))
                cell[at] = names[int(dims)] * PIVOTS + (v @ units[int(dims)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    columns = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    dealt = stored(rows.mapInArrow(run, f"{columns}, cell int"), "candidates")
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().toLocalIterator()}
    table, trees = [], 0
    for cell, n in sorted(counts.items()):
        table.append((cell, trees, -(-n // TREE_ROWS)))
        trees += table[-1][2]
    places = spark.createDataFrame(table, "cell int, _first int, _parts int")
    dealt = dealt.join(F.broadcast(places), "cell")
    tree = F.col("_first") + F.pmod(F.xxhash64("rid", F.lit(1)), F.col("_parts")).cast("int")
    return dealt.withColumn("tree", tree).drop("cell", "_first", "_parts")


def _trees(dealt: DataFrame) -> DataFrame:
    """``tree, packed``: a tree for each group of rows."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("rid", "ascending")]).combine_chunks()
        tree = build_tree(
            group["id"].to_numpy(), group["label"].to_numpy(), _matrix(group["v"].combine_chunks())
        )
        return pa.table({
            "tree": pa.array([group["tree"][0].as_py()], pa.int32()),
            "packed": pa.array([pack_tree(tree)], pa.binary()),
        })

    columns = dealt.select("rid", "id", "label", "v", "tree")
    return columns.groupBy("tree").applyInArrow(build, "tree int, packed binary")


# -- blocks of anchors taken past trees -----------------------------------------------


class _Tree:
    """A packed tree with its rows in the order they are compared in, cut into pieces."""

    def __init__(self, number: int, blob):
        self.number, self.blob, self.known = number, blob, {}
        packed = pickle.loads(blob)
        labels = packed["labels"]
        # With few labels a piece has one label, and only the anchors that ask for it see it.
        self.by_label = len(labels) >= LABEL_ROWS * len(np.unique(labels))
        rows = np.argsort(labels, kind="stable") if self.by_label else np.arange(len(labels))
        self.ids, self.labels, self.v = packed["ids"][rows], labels[rows], packed["v"][rows]
        self.dims, self.norm = self.v.shape[1], packed["norm"]
        # The root and the largest nodes of PIECE rows at most, which have all rows.
        begin, end = packed["begin"], packed["end"]
        cut = (end - begin <= PIECE) | np.isin(np.arange(len(begin)), packed["leaf"])
        units = np.nonzero(cut & ~(cut[packed["parent"]] & (packed["parent"] >= 0)))[0]
        units = units[np.argsort(begin[units], kind="stable")]
        nodes = np.concatenate([[0], units])
        self.nodes = {
            "center": _unit(packed["v"][packed["middle"][nodes]].astype(float), self.norm)[0],
            "radius": packed["radius"][nodes], "norm": self.norm, "parent": np.zeros(len(nodes), np.int64),
        }
        self.root = {n: x if n == "norm" else x[:1] for n, x in self.nodes.items()}
        node = np.searchsorted(begin[units], rows, "right")
        turns = np.nonzero(self.labels[1:] != self.labels[:-1])[0] + 1 if self.by_label else []
        self.pieces = []
        for lo, hi in zip([0, *turns], [*turns, len(rows)]):
            ends = np.linspace(lo, hi, -(-(hi - lo) // PIECE) + 1).astype(int)
            self.pieces += [(a, b, node[a], node[b - 1] + 1) for a, b in zip(ends[:-1], ends[1:])]

    def rows(self, kind) -> np.ndarray:
        if kind not in self.known:
            self.known[kind] = self.v.astype(kind)
        return self.known[kind]


def _block(anchors: pa.Table) -> dict:
    """Anchors of one length; windows side by side, filled up with some that nothing fits."""
    anchors = anchors.combine_chunks()
    windows = anchors["windows"].combine_chunks()
    counts = pc.list_value_length(windows).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = windows.flatten()
    field = lambda n, none: pc.fill_null(pc.struct_field(flat, n), none).to_numpy(zero_copy_only=False)
    shape = (len(counts), int(counts.max(initial=1)))
    at, least, most = np.zeros(shape, np.int32), np.full(shape, MOST), np.full(shape, LEAST)
    at[row, place] = field("at", -1)
    least[row, place] = np.maximum(field("floor", LEAST), field("least", LEAST))
    most[row, place] = field("ceiling", MOST)
    return {n: anchors[n].to_numpy() for n in ("rid", "id", "label", "tree")} | {
        "v": _whole(_matrix(anchors["v"].combine_chunks())), "at": at, "least": least, "most": most,
    }


class _Search:
    """A block of anchors and the first ``k`` of each window in the trees seen so far."""

    def __init__(self, block: dict, k: int, same: bool):
        self.k, self.same = k, same
        self.rid, self.id, self.label, self.tree = (block[n] for n in ("rid", "id", "label", "tree"))
        self.at, self.least, self.most = block["at"], block["least"].copy(), block["most"]
        self.whole, self.v = block["v"].dtype.kind == "i", block["v"].astype(float)
        self.dims, self.size = self.v.shape[1], np.linalg.norm(self.v, axis=1)
        self.single = self.v.astype(np.float32) if self.whole else None
        # Places, scores and ids; a place is a window of an anchor.
        self.held = (np.empty(0, np.int64),) * 3
        # Of full places, the id that a tie has to undercut.
        self.last = np.full(self.least.shape, MOST)
        self.fresh, self.waiting = [], 0

    def visit(self, tree: _Tree, own: bool) -> None:
        """The anchors that lie in the tree, or those that don't, look into it."""
        asked = np.nonzero((self.tree == tree.number) == own)[0]
        if not len(asked):
            return
        low, high = node_bounds(tree.root, self.v[asked])
        asked = asked[self._may(asked, low[:, 0], high[:, 0])]
        narrow = self.size[asked] * tree.norm * (1 + 1e-9) < EXACT
        if not narrow.all():
            self._visit_wide(tree, asked[~narrow])
        asked = asked[narrow]
        if not len(asked):
            return
        size = self.size[asked].max()
        whole = self.whole and tree.v.dtype.kind == "i"
        single = whole and max(size * tree.norm * (1 + 1e-9), size, tree.norm) < EXACT_SINGLE
        kind = np.float32 if single else np.float64
        # Bounds are worked out for all if some anchors show that they rule out enough.
        may = self._open(tree, asked[:: -(-len(asked) // PROBE)])
        may = self._open(tree, asked) if may.mean() < 0.8 else None
        for i, (a, b, _, _) in enumerate(tree.pieces):
            some = asked if may is None else asked[may[i]]
            if tree.by_label:
                some = some[(self.label[some] == tree.labels[a]) == self.same]
            for start in range(0, len(some), BLOCK):
                self._compare(tree, some[start : start + BLOCK], a, b, kind, whole)

    def _open(self, tree: _Tree, asked: np.ndarray) -> np.ndarray:
        """For each piece, whether its bounds leave room for what each anchor asks for."""
        low, high = node_bounds(tree.nodes, self.v[asked])
        return np.array([
            self._may(asked, low[:, first:last].min(axis=1), high[:, first:last].max(axis=1))
            for _, _, first, last in tree.pieces
        ])

    def _may(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= self.least[asked]) & (low[:, None] <= self.most[asked])).any(axis=1)

    def _compare(self, tree: _Tree, some: np.ndarray, a: int, b: int, kind, whole: bool) -> None:
        q = self.single if kind is np.float32 else self.v
        scores = q[some] @ tree.rows(kind)[a:b].T
        if not whole:
            np.trunc(scores, out=scores)
        # Bounds beyond what is exact round to numbers that are beyond it, too.
        least = self.least[some].astype(kind)
        hit = scores >= least.min(axis=1)[:, None]
        if not tree.by_label:
            hit &= (self.label[some][:, None] == tree.labels[a:b][None, :]) == self.same
        rows = np.nonzero(hit.any(axis=1))[0]
        if not len(rows):
            return
        if np.count_nonzero(hit) * 16 > hit.size:
            # Much lies above or between the windows.
            most, inside = self.most[some].astype(kind), np.zeros_like(hit)
            for w in range(least.shape[1]):
                inside |= (scores >= least[:, w : w + 1]) & (scores <= most[:, w : w + 1])
            hit &= inside
        i, j = np.nonzero(hit[rows])
        i = rows[i]
        self._take(some[i], scores[i, j].astype(np.int64), tree.ids[a:b][j])

    def _take(self, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        other = ident != self.id[anchor]
        anchor, score, ident = anchor[other], score[other], ident[other]
        least = self.least[anchor]
        fits = (score[:, None] >= least) & (score[:, None] <= self.most[anchor])
        fits &= (score[:, None] > least) | (ident[:, None] < self.last[anchor])
        i, w = np.nonzero(fits)
        self._add(anchor[i] * self.least.shape[1] + w, score[i], ident[i])

    def _add(self, place: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.fresh.append((place, score, ident))
        self.waiting += len(place)
        if self.waiting > max(1000, self.least.size * self.k // 2):
            self._merge()

    def _merge(self) -> None:
        place, score, ident = (np.concatenate(x) for x in zip(self.held, *self.fresh))
        self.fresh, self.waiting = [], 0
        order = np.lexsort((ident, -score, place))
        place = place[order]
        start = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.empty(0, bool)
        rank = np.arange(len(place)) - np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        first = rank < self.k
        self.held = place[first], score[order[first]], ident[order[first]]
        # Ties go to the smaller id, so equal scores are still looked at.
        full = rank == self.k - 1
        self.least.reshape(-1)[place[full]] = score[order[full]]
        self.last.reshape(-1)[place[full]] = ident[order[full]]

    def _visit_wide(self, tree: _Tree, asked: np.ndarray) -> None:
        """Scores that a double may not hold, leaf by leaf."""
        whole = unpack_tree(tree.blob)
        low, high = node_bounds(whole, self.v[asked])
        none = lambda x, limit: None if x == limit else int(x)
        for i, a in enumerate(asked):
            anchor = {"v": self.v[a], "label": self.label[a], "id": self.id[a]}
            query = _Query(whole, anchor, low[i], high[i], self.same)
            for w, (least, most) in enumerate(zip(self.least[a].copy(), self.most[a])):
                if least <= most:
                    found = query.best(self.k, none(least, LEAST), none(most, MOST), None)
                    self._add(np.full(len(found[0]), a * self.least.shape[1] + w), *found)

    def found(self) -> pa.RecordBatch:
        self._merge()
        place, score, ident = self.held
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.rid[place // self.least.shape[1]], pa.int64()),
                pa.array(self.at.reshape(-1)[place], pa.int32()),
                pa.array(score, pa.int64()), pa.array(ident, pa.int64()),
            ],
            names=["rid", "at", "score", "id"],
        )


# -- rounds of search -----------------------------------------------------------------


def _at_home(anchors: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """``rid, at, score, id``: the first ``k`` of each window in the anchor's own tree."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(
                ("rid", "at", "score", "id"), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})
        search = _Search(_block(asked), k, same)
        search.visit(_Tree(held["tree"][0].as_py(), held["packed"][0].as_buffer()), own=True)
        return pa.Table.from_batches([search.found()])

    asked = anchors.select("rid", "id", "label", "v", "windows", "tree")
    return asked.groupBy("tree").cogroup(trees.groupBy("tree")).applyInArrow(run, FOUND)


def _blocks(anchors: DataFrame, count: int) -> DataFrame:
    """``block, asked``: anchors of the same and of neighboring trees, packed together."""

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([table["rid"][0].as_py()], pa.int64()),
                pa.array([pickle.dumps(_block(table), protocol=5)], pa.binary()),
            ],
            names=["block", "asked"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, dims = [], 0, None
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            turns = np.nonzero(sizes[1:] != sizes[:-1])[0] + 1
            for lo, hi in zip([0, *turns], [*turns, len(sizes)]):
                while lo < hi:
                    if rows and (n == 2 * GROUP_ANCHORS or sizes[lo] != dims):
                        yield packed(rows)
                        rows, n = [], 0
                    some = batch.slice(lo, min(hi - lo, 2 * GROUP_ANCHORS - n))
                    rows.append(some)
                    lo, n, dims = lo + some.num_rows, n + some.num_rows, sizes[lo]
        if rows:
            yield packed(rows)

    asked = anchors.select("rid", "id", "label", "v", "windows", "tree", "dims")
    near = asked.repartition(count, "tree").sortWithinPartitions("dims", "tree", "rid")
    blocks = stored(near.mapInArrow(run, "block bigint, asked binary"), "blocks")
    # Dealt in turn from one partition, so that each task gets as many; Spark would skip
    # a mere coalesce in front.
    return blocks.coalesce(1).mapInArrow(lambda batches: batches, blocks.schema).repartition(count)


def _elsewhere(anchors: DataFrame, trees: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """``rid, at, score, id``: the first ``k`` of each window in a share of the other trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, tree = {}, None
        for batch in batches:
            number, packed, block, asked = (batch.column(n) for n in ("tree", "packed", "block", "asked"))
            for i in range(batch.num_rows):
                if tree is None or tree.number != number[i].as_py():
                    tree = _Tree(number[i].as_py(), packed[i].as_buffer())
                if (b := block[i].as_py()) not in searches:
                    searches[b] = _Search(pickle.loads(asked[i].as_buffer()), k, same)
                if searches[b].dims == tree.dims:
                    searches[b].visit(tree, own=False)
        for search in searches.values():
            yield search.found()

    blocks = -(-count // GROUP_ANCHORS)
    # Trees in few shares: the longer a block's way past them, the fewer finds are left behind.
    shares = -(-2 * trees.sparkSession.sparkContext.defaultParallelism // blocks)
    pairs = trees.coalesce(shares).hint("shuffle_replicate_nl").crossJoin(_blocks(anchors, blocks))
    return pairs.select("tree", "packed", "block", "asked").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ask(anchors: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` of every window of the anchors: ``rid, at, rank, score, id``.

    An anchor first asks its own tree; what it finds there rules out most others.
    """
    anchors = stored(anchors, "asking")
    home = stored(_at_home(anchors, trees, k, same), "negatives-home")
    known = _first(home, k).where(F.col("rank") == k).select("rid", "at", F.col("score").alias("least"))
    known = known.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("_least"))
    told = F.transform(
        "windows",
        lambda w: w.withField(
            "least", F.when(F.col("_least").isNotNull(), F.try_element_at("_least", w["at"]))
        ),
    )
    again = anchors.join(known, "rid", "left").withColumn("windows", told).drop("_least")
    others = _elsewhere(again, trees, max(anchors.count(), 1), k, same)
    return stored(_first(home.unionByName(others), k), "negatives-found")


NO_BOUND = "cast(null as bigint)"


def _hundredth(x: str) -> Column:
    """A whole number, possibly wider than a long, over 100 and rounded down."""
    return F.expr(f"cast((({x}) - pmod({x}, 100)) div 100 as bigint)")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """For each anchor and positive, the best-scoring rows of other labels inside a window.

    ``rows`` has ``id bigint, label, v array<double>`` of whole numbers; ``is_anchor`` is a
    condition on ``id``. The score of two rows is their inner product, exact; a higher one
    comes first, then the smaller id. An anchor's positives are its first ``positives``
    others of its label. Negatives score from ``low`` to ``high`` percent of the positive.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null id, label, vector or component take no part, nor do components that
    are not finite. Equal rows count once; rows that share only an id are each an anchor and
    a candidate, but never for their own id. Vectors meet those of their own length only.
    Other columns are not looked at. An empty table gives no rows.
    """
    spark = rows.sparkSession
    clean = rows.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("v").cast("array<double>").alias("v"),
    ).where("id is not null and label is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )
    clean = clean.distinct().withColumn("dims", F.size("v"))
    numbered = stored(clean.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    dealt = _dealt(numbered)
    trees = stored(_trees(dealt), "cover-trees")
    asking = stored(dealt.where(is_anchor), "anchors")
    everything = F.expr(
        f"array(named_struct('at', 0, 'floor', {NO_BOUND}, 'ceiling', {NO_BOUND}, 'least', {NO_BOUND}))"
    )
    first = _ask(asking.withColumn("windows", everything), trees, positives, True)
    # Positives of the same score share a window.
    band = F.min("rank").over(Window.partitionBy("rid", "score")).cast("int")
    first = first.withColumn("band", band)
    # Whole numbers: low * p <= 100 * s <= high * p.
    window = F.struct(
        F.col("rank").cast("int").alias("at"),
        (-_hundredth(f"-{low} * cast(score as decimal(20, 0))")).alias("floor"),
        _hundredth(f"{high} * cast(score as decimal(20, 0))").alias("ceiling"),
        F.expr(NO_BOUND).alias("least"),
    )
    told = first.where(F.col("rank") == F.col("band")).select("rid", window.alias("w"))
    told = told.where("w.floor <= w.ceiling").groupBy("rid")
    told = told.agg(F.sort_array(F.collect_list("w")).alias("windows"))
    second = _ask(asking.join(told, "rid"), trees, negatives, False)
    pairs = first.select(
        "rid", F.col("band").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = asking.select("rid", F.col("id").alias("anchor_id"))
    return (
        second.select(
            "rid", "at", F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
        )
        .join(pairs, ["rid", "at"])
        .join(named, "rid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
