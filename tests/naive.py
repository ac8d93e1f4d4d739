"""The online algorithm once more, point by point in plain Python, as a test oracle."""

import math
from statistics import NormalDist, mean, stdev


def dist2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def standardized(points):
    out = []
    columns = list(zip(*points))
    for p in points:
        z = []
        for v, column in zip(p, columns):
            sd = stdev(column) if len(column) > 1 else 0.0
            z.append((v - mean(column)) / sd if sd > 0 else 0.0)
        out.append(z)
    return out


class Cluster:
    def __init__(self, ident, dims, centroid):
        self.ids = [ident]
        self.n = self.t1 = self.t2 = 0
        self.s1, self.s2 = [0.0] * dims, [0.0] * dims
        self.centroid, self.rmsd = list(centroid), 0.0

    def add(self, p, t):
        self.n += 1
        self.t1 += t
        self.t2 += t * t
        self.s1 = [a + v for a, v in zip(self.s1, p)]
        self.s2 = [a + v * v for a, v in zip(self.s2, p)]

    def mean(self):
        return [v / self.n for v in self.s1]

    def deviation(self):
        v = sum(self.s2) / self.n - sum(a * a for a in self.s1) / self.n**2
        return math.sqrt(max(v, 0.0))


class Naive:
    def __init__(self, centers, t_factor=2.0, m=500, delta=20, recursive=True, scale=True,
                 window=None):
        self.mcs = [Cluster(i, len(c), c) for i, c in enumerate(centers)]
        self.next_id = len(centers)
        self.t_factor, self.m, self.delta = t_factor, m, delta
        self.recursive, self.scale, self.window = recursive, scale, window
        self.t = 0
        self.started = False
        self.deltas = {}

    def other_distance(self, centroid):
        found = [dist2(centroid, mc.centroid) for mc in self.mcs]
        return math.sqrt(min((v for v in found if v != 0.0), default=math.inf))

    def refresh(self):
        for mc in self.mcs:
            if mc.n > 0:
                mc.centroid = mc.mean()
            if mc.n > 1:
                mc.rmsd = mc.deviation()
        for mc in self.mcs:
            if mc.n == 1:
                mc.rmsd = self.other_distance(mc.centroid)

    def stamp(self, mc):
        if mc.n == 0:
            return 0.0
        mu = mc.t1 / mc.n
        if mc.n < 2 * self.m:
            return mu
        sd = math.sqrt(max(mc.t2 / mc.n - mu * mu, 0.0))
        return mu if sd == 0 else NormalDist(mu, sd).inv_cdf(1 - self.m / (2 * mc.n))

    def note(self, mc, p):
        self.delta_now.setdefault(mc.ids[0], Cluster(mc.ids[0], len(p), p)).add(p, self.t)

    def forget(self, gone):
        for mc in self.mcs:
            for ident, old in gone.items():
                if ident in mc.ids:
                    mc.n -= old.n
                    mc.t1 -= old.t1
                    mc.t2 -= old.t2
                    mc.s1 = [a - b for a, b in zip(mc.s1, old.s1)]
                    mc.s2 = [a - b for a, b in zip(mc.s2, old.s2)]
        self.refresh()

    def step(self, points):
        self.t += 1
        self.delta_now = {}
        if self.scale:
            points = standardized(points)
        if self.started and self.window and self.t + 1 - self.window in self.deltas:
            self.forget(self.deltas[self.t + 1 - self.window])
        placed = []
        for p in points:
            found = [dist2(p, mc.centroid) for mc in self.mcs]
            at = found.index(min(found))
            inside = math.sqrt(found[at]) <= self.t_factor * self.mcs[at].rmsd
            placed.append((at, inside or not self.started))
        for p, (at, inside) in zip(points, placed):
            if inside:
                self.mcs[at].add(p, self.t)
                self.note(self.mcs[at], p)
        outside = [p for p, (_, inside) in zip(points, placed) if not inside]
        stale = [mc.n == 0 or self.stamp(mc) < self.t - self.delta for mc in self.mcs]
        free = [i for i, s in enumerate(stale) if s]
        keep = [i for i, s in enumerate(stale) if not s]
        if len(keep) < 2:
            keep = list(range(len(self.mcs)))
        founded = []
        for p in outside:
            self.place(p, free, keep, founded)
        self.refresh()
        self.started = True
        self.deltas[self.t] = self.delta_now
        return len(outside)

    def place(self, p, free, keep, founded):
        if founded and self.recursive:
            d2, at = min((dist2(p, self.mcs[i].mean()), i) for i in founded)
            if math.sqrt(d2) <= self.t_factor * self.mcs[at].rmsd:
                return self.join(at, p)
        if free:
            slot = free.pop(0)
        elif len(self.mcs) == 1:
            return self.join(0, p)
        else:
            pairs = [
                (dist2(self.mcs[a].centroid, self.mcs[b].centroid), a, b)
                for a in keep for b in keep if a < b
            ]
            _, into, slot = min(pairs)
            a, b = self.mcs[into], self.mcs[slot]
            a.n, a.t1, a.t2 = a.n + b.n, a.t1 + b.t1, a.t2 + b.t2
            a.s1 = [x + y for x, y in zip(a.s1, b.s1)]
            a.s2 = [x + y for x, y in zip(a.s2, b.s2)]
            a.ids = a.ids + b.ids
            a.centroid, a.rmsd = a.mean(), a.deviation()
        new = Cluster(self.next_id, len(p), p)
        self.next_id += 1
        new.add(p, self.t)
        self.mcs[slot] = new
        new.rmsd = self.other_distance(new.centroid)
        self.note(new, p)
        if slot not in founded:
            founded.append(slot)

    def join(self, at, p):
        mc = self.mcs[at]
        mc.add(p, self.t)
        mc.centroid, mc.rmsd = mc.mean(), mc.deviation()
        self.note(mc, p)
