"""Placing outliers one after the other into a fixed number of slots."""

from __future__ import annotations

import math

import numpy as np

# Up to so many slots all their distances are kept; a look over them costs less than bookkeeping.
FEW_SLOTS = 128


def rmsd(n: float, cf1x: np.ndarray, cf2x: np.ndarray) -> float:
    n = float(n)
    return math.sqrt(max(cf2x.sum() / n - (cf1x @ cf1x) / (n * n), 0.0))


class Slots:
    """The ``q`` slots of a model while the outliers of one tick are placed.

    Each outlier joins the nearest micro-cluster founded in this tick if it lies
    within its boundary. Otherwise it founds one: in the slot of the next stale
    micro-cluster, or, when none is left, in a slot freed by merging the two
    closest of the others.

    ``centroid`` and ``rmsd`` are those the tick began with, except for slots
    touched since; ``n``, ``cf1x`` and ``cf2x`` are current. Placing is sequential, so what
    an outlier costs bounds a tick: deviations are worked out when they are asked for, and
    few slots keep a matrix of their distances, in which a moved one is a row and a column.
    """

    def __init__(self, n, cf1x, cf2x, centroid, rmsd, stale, t_factor, recursive=True):
        self.n, self.cf1x, self.cf2x = n, cf1x, cf2x
        self.centroid, self._rmsd = centroid, rmsd
        # Slots whose deviation is that of their features, not yet worked out.
        self._unsure: set[int] = set()
        self.q = len(n)
        self.t_factor = t_factor
        self.recursive = recursive
        self.free = [s for s in range(self.q) if stale[s]]
        self.pool = [s for s in range(self.q) if not stale[s]]
        # With fewer than two others to merge, founded ones are merged as well.
        if len(self.pool) < 2:
            self.pool = list(range(self.q))
        self.founded: list[int] = []
        self.rank: dict[int, int] = {}
        # Current means of the founded micro-clusters, in the order of founding.
        self._means = np.empty_like(centroid)
        self._gap = None
        self._place_in_pool = {s: i for i, s in enumerate(self.pool)}
        self._moved: set[int] = set()
        self.few = self.q <= FEW_SLOTS
        self._order = np.array(self.founded, dtype=np.int64)
        self._pairs: np.ndarray | None = None
        self._others = np.array(sorted(set(range(self.q)) - set(self.pool)), dtype=np.int64)
        # The centroids once more, by dimension: a few long rows.
        self._columns = centroid.T.copy() if self.few else None

    @property
    def rmsd(self) -> np.ndarray:
        for slot in list(self._unsure):
            self._rmsd_of(slot)
        return self._rmsd

    def _rmsd_of(self, slot: int) -> float:
        if slot in self._unsure:
            self._rmsd[slot] = rmsd(self.n[slot], self.cf1x[slot], self.cf2x[slot])
            self._unsure.discard(slot)
        return self._rmsd[slot]

    def mark_founded(self, slot: int) -> None:
        if slot not in self.rank:
            self.rank[slot] = len(self.founded)
            self.founded.append(slot)
            self._order = np.array(self.founded, dtype=np.int64)
        if not self.few:
            self._means[self.rank[slot]] = self.cf1x[slot] / self.n[slot]

    def _nearest_founded(self, mean) -> tuple[int, float]:
        """The nearest founded slot, the first of equally near ones, and the squared distance."""
        if self.few:
            d2 = self._distances_to(mean).take(self._order)
        else:
            gaps = self._means[: len(self.founded)] - mean
            d2 = np.einsum("ij,ij->i", gaps, gaps)
        at = int(d2.argmin())
        return self.founded[at], d2[at]

    def _distances_to(self, mean) -> np.ndarray:
        """Squared distances of all slots."""
        if self.few:
            gaps = self._columns - mean[:, None]
            gaps *= gaps
            return np.add.reduce(gaps, axis=0)
        gaps = self.centroid - mean
        return np.einsum("ij,ij->i", gaps, gaps)

    def _move(self, slot: int, mean) -> None:
        self.centroid[slot] = mean
        if self.few:
            self._columns[:, slot] = mean

    def place(self, n, cf1x, cf2x):
        """Place one outlier (or a group of them) and say what was done.

        Returns ``(slot, merged_into)``: ``slot`` received it; it was founded
        anew unless ``merged_into`` is -1, and ``merged_into`` is the slot that
        took over the former content, or None if that was given up.
        """
        mean = cf1x / n
        if self.founded and self.recursive:
            slot, d2 = self._nearest_founded(mean)
            if math.sqrt(d2) <= self.t_factor * self._rmsd_of(slot):
                self._add(slot, n, cf1x, cf2x)
                return slot, -1
        if self.free:
            slot, into = self.free.pop(0), None
        elif self.q == 1:
            self._add(0, n, cf1x, cf2x)
            return 0, -1
        else:
            into, slot = self._closest()
            self._add(into, self.n[slot], self.cf1x[slot], self.cf2x[slot])
        self._found(slot, n, cf1x, cf2x, mean)
        return slot, into

    def _add(self, slot, n, cf1x, cf2x):
        self.n[slot] += n
        self.cf1x[slot] += cf1x
        self.cf2x[slot] += cf2x
        self._move(slot, self.cf1x[slot] / self.n[slot])
        self._unsure.add(slot)
        self._moved.add(slot)
        if not self.few and slot in self.rank:
            self._means[self.rank[slot]] = self.centroid[slot]

    def _found(self, slot, n, cf1x, cf2x, mean):
        self.n[slot], self.cf1x[slot], self.cf2x[slot] = n, cf1x, cf2x
        self._move(slot, mean)
        self._unsure.discard(slot)
        if self.few and (n == 1 or self._pairs is not None):
            d2 = self._distances_to(mean)
            self._rmsd[slot] = self._least_of_others(d2, slot) if n == 1 else rmsd(n, cf1x, cf2x)
            if self._pairs is not None:
                self._note_distances(slot, d2)
                self._moved.discard(slot)
        else:
            self._moved.add(slot)
            self._rmsd[slot] = self.nearest_distance(slot) if n == 1 else rmsd(n, cf1x, cf2x)
        self.mark_founded(slot)

    def nearest_distance(self, slot) -> float:
        """Distance to the nearest other centroid, those at distance zero left out."""
        return self._least_of_others(self._distances_to(self.centroid[slot]), slot)

    @staticmethod
    def _least_of_others(d2, slot) -> float:
        d2[slot] = np.inf
        least = d2.min()
        if not least > 0.0:
            # Empty slots have no centroid: their NaN is not above zero.
            least = d2.min(where=d2 > 0.0, initial=np.inf)
        return math.sqrt(least)

    def _note_distances(self, slot: int, d2: np.ndarray) -> None:
        """Row and column of a slot among the pairs; those outside of the pool are no pairs."""
        if len(self._others):
            if slot not in self._place_in_pool:
                return
            d2[self._others] = np.inf
        d2[slot] = np.inf
        self._pairs[slot] = d2
        self._pairs[:, slot] = d2

    def _closest_of_few(self) -> tuple[int, int]:
        if self._pairs is None:
            self._pairs = np.full((self.q, self.q), np.inf)
            self._moved = set(self.pool)
        for slot in self._moved:
            self._move(slot, self.centroid[slot])
        for slot in self._moved:
            self._note_distances(slot, self._distances_to(self.centroid[slot]))
        self._moved.clear()
        # The matrix is symmetric, so the first least value is that of the first pair.
        into, slot = divmod(int(self._pairs.argmin()), self.q)
        if math.isnan(self._pairs[into, slot]):
            # Slots without a centroid are infinitely far.
            self._pairs[np.isnan(self._pairs)] = np.inf
            into, slot = divmod(int(self._pairs.argmin()), self.q)
        return (into, slot) if into != slot else (self.pool[0], self.pool[1])

    def _closest(self) -> tuple[int, int]:
        """The closest two of the pool; the first pair in slot order wins ties.

        Kept for each slot of the pool: the nearest of those after it. When a slot has
        moved, its own is looked for again, and that of the slots it was nearest to;
        for the others before it one distance decides.
        """
        if self.few:
            return self._closest_of_few()
        if self._gap is None:
            size = len(self.pool)
            self._slots = np.array(self.pool)
            self._gap, self._next = np.full(size, np.inf), np.zeros(size, np.int64)
            for i in range(size):
                self._look_after(i, self._distances(i))
            self._moved.clear()
        places = sorted(self._place_in_pool[s] for s in self._moved if s in self._place_in_pool)
        self._moved.clear()
        for i in places:
            d2 = self._distances(i)
            self._look_after(i, d2)
            before = d2[:i]
            closer = (before < self._gap[:i]) | ((before == self._gap[:i]) & (i < self._next[:i]))
            lost = np.nonzero((self._next[:i] == i) & (before > self._gap[:i]))[0]
            self._gap[:i][closer], self._next[:i][closer] = before[closer], i
            for k in lost:
                self._look_after(k, self._distances(k))
        i = int(self._gap.argmin())
        return self.pool[i], self.pool[self._next[i]]

    def _distances(self, i: int) -> np.ndarray:
        """Squared distances from place ``i`` of the pool; empty slots are infinitely far."""
        gaps = self.centroid[self._slots] - self.centroid[self._slots[i]]
        d2 = np.einsum("ij,ij->i", gaps, gaps)
        d2[np.isnan(d2)] = np.inf
        return d2

    def _look_after(self, i: int, d2: np.ndarray) -> None:
        after = d2[i + 1 :]
        if len(after):
            at = int(after.argmin())
            self._gap[i], self._next[i] = after[at], i + 1 + at

    def refresh(self):
        """End of the tick: centroids and deviations from the current features."""
        deviation = self.rmsd
        for s in range(self.q):
            if self.n[s] > 0:
                self._move(s, self.cf1x[s] / self.n[s])
            if self.n[s] > 1:
                deviation[s] = rmsd(self.n[s], self.cf1x[s], self.cf2x[s])
        for s in range(self.q):
            if self.n[s] == 1:
                deviation[s] = self.nearest_distance(s)
