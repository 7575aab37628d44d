"""Graph searches over compressed rows; no Spark. Python and numpy; many trips go to the same searches in Java (``native``)."""

from __future__ import annotations

from array import array
from functools import cached_property
from heapq import heappop, heappush

import numpy as np

from streetflow.functions import geo
from streetflow.operators import native

DISCOUNT = 0.75
INF = float("inf")
#: Trips that are searched in Python rather than by a helper that would have to start.
FEW = 200
#: Dead nodes around an end of a trip that are told apart; if there are more, its search goes by all dead nodes.
NEAR = 256


class Graph:
    """Links in compressed rows by their begin and by their end. Ties between parallel links go to the smaller link number.

    The rows are made when a search first needs them and are flat arrays, so a graph costs a worker 16 bytes a link and
    side; the driver, which searches nothing, never makes them. placed: u and v are node numbers already. code: the
    compiled searches, empty if there are none.
    """

    def __init__(
        self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, time: np.ndarray, length: np.ndarray, lat=None, lon=None,
        placed: bool = False, code: bytes | None = None,
    ):
        self.ids = np.asarray(ids, np.int64)
        self.u, self.v = (np.ascontiguousarray(x if placed else np.searchsorted(self.ids, x), np.int32) for x in (u, v))
        self.time, self.length = np.asarray(time, float), np.asarray(length, float)
        self.lat, self.lon, self.code, self.towards = lat, lon, code, (None, None, None)

    @cached_property
    def router(self) -> native.Router | None:
        return native.start(self, native.code() if self.code is None else self.code)

    @cached_property
    def y(self) -> array | None:
        return None if self.lat is None else array("d", (np.asarray(self.lat, float) * geo.LAT_METRES).tobytes())

    @cached_property
    def x(self) -> array | None:
        return None if self.lon is None else array("d", (np.asarray(self.lon, float) * geo.LON_METRES).tobytes())

    @cached_property
    def out(self) -> tuple[array, array, array]:
        """(first place of each node, link numbers by begin, end of each link)."""
        return self._rows(self.u, self.v)

    @cached_property
    def into(self) -> tuple[array, array, array]:
        return self._rows(self.v, self.u)

    def _rows(self, a: np.ndarray, b: np.ndarray) -> tuple[array, array, array]:
        order = np.argsort(a, kind="stable")
        first = np.searchsorted(a[order], np.arange(len(self.ids) + 1))
        return tuple(array("q", x.astype(np.int64).tobytes()) for x in (first, order, b))

    @cached_property
    def piece(self) -> np.ndarray:
        """The smallest node that hangs together with each node, whatever the links' directions: between pieces there is no path."""
        low = np.arange(len(self.ids))
        while True:
            near = np.minimum(low[self.u], low[self.v])
            new = low.copy()
            np.minimum.at(new, self.u, near)
            np.minimum.at(new, self.v, near)
            np.minimum.at(new, low[self.u], near)
            np.minimum.at(new, low[self.v], near)
            new = new[new]
            if (new == low).all():
                return low
            low = new

    @cached_property
    def dead(self) -> tuple[bytearray, bytearray]:
        """1 for nodes from which no round trip can be reached, and for those that none reaches.

        All that follows a dead node (leads to it) is dead, so a path holds such nodes at its end (its begin) only.
        """
        found = []
        for (first, _, _), (back, links, to) in ((self.out, self.into), (self.into, self.out)):
            left = [b - a for a, b in zip(first, first[1:])]
            todo = [i for i, k in enumerate(left) if not k]
            for i in todo:
                for k in links[back[i] : back[i + 1]]:
                    left[to[k]] -= 1
                    if not left[to[k]]:
                        todo.append(to[k])
            none = bytearray(len(left))
            for i in todo:
                none[i] = 1
            found.append(none)
        return tuple(found)

    def nearby(self, side: int, node: int) -> set[int] | None:
        """The dead nodes by which a search from the other end (forward on side 0) may reach a node; None for any."""
        dead, (first, links, to) = self.dead[side], self.out if side else self.into
        found = [node] if dead[node] else []
        known = set(found)
        for i in found:
            for k in links[first[i] : first[i + 1]]:
                j = to[k]
                if dead[j] and j not in known:
                    if len(found) == NEAR:
                        return None
                    known.add(j)
                    found.append(j)
        return known

    def raw(self) -> tuple:
        """The arguments that build this graph again: what a broadcast carries, as it pickles classes by name."""
        return self.ids, self.u, self.v, self.time, self.length, self.lat, self.lon, True, native.code()

    def at(self, node: int) -> int | None:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.ids[k] == node else None

    def max_speed(self, time: np.ndarray) -> float:
        """The largest straight-line speed of a link: with it the goal direction never overshoots."""
        return max(float(np.max(self.length / np.maximum(time, 1e-12), initial=0)), 1e-12)


def tree(g: Graph, source: int, time: list[float], reverse: bool = False, stop: set[int] | None = None, most: int | None = None):
    """{node: cost} from source (to it, if reverse). Ends early once all of stop, or ``most`` nodes, are settled."""
    first, links, to = g.into if reverse else g.out
    cost, settled, heap = {source: 0.0}, {}, [(0.0, source)]
    waiting = set(stop) if stop is not None else None
    while heap:
        c, i = heappop(heap)
        if i in settled:
            continue
        settled[i] = c
        if waiting is not None:
            waiting.discard(i)
            if not waiting:
                break
        if most is not None and len(settled) >= most:
            break
        for k in links[first[i] : first[i + 1]]:
            w, j = time[k], to[k]
            if w > 0 and c + w < cost.get(j, INF):
                cost[j] = c + w
                heappush(heap, (c + w, j))
    return settled


def ways(g: Graph, target: int, time) -> tuple[array, array]:
    """(cost, link) of every node's least-cost way to a target; infinity and -1 where there is none."""
    first, links, to = g.into
    n = len(g.ids)
    cost, via = array("d", [INF]) * n, array("q", [-1]) * n
    cost[target], heap = 0.0, [(0.0, target)]
    while heap:
        c, i = heappop(heap)
        if c > cost[i]:
            continue
        for k in links[first[i] : first[i + 1]]:
            new, j = c + time[k], to[k]
            if new < cost[j]:
                cost[j], via[j] = new, k
                heappush(heap, (new, j))
    return cost, via


def way(g: Graph, s: int, t: int, found: tuple[array, array], time) -> tuple[float, list[int]] | None:
    """What route returns, read from the ways to t."""
    cost, via = found
    if cost[s] == INF:
        return None
    path, to = [], g.out[2]
    while s != t:
        path.append(via[s])
        s = to[via[s]]
    return sum(time[k] for k in path) if path else 0.0, path


def route(g: Graph, s: int, t: int, time: list[float], speed: float | None = None, flags=None) -> tuple[float, list[int]] | None:
    """(cost, link numbers) of a least-cost path, or None.

    Both ends search in turn, the side with the lower key first. With speed, keys are shifted by half the difference of
    the straight-line times to both ends (times ``DISCOUNT``); as the two shifts cancel, the search ends when the two
    lowest keys add up to the best meeting. Dead nodes that cannot lie on a path, nodes that both sides have settled, and those
    too far from both ends are not followed. flags = (forward, backward, region): only links whose forward flag for the
    target's region (backward flag for the source's region) is set are followed.
    """
    if s == t:
        return 0.0, []
    if g.piece[s] != g.piece[t]:
        return None
    cost, via, done = ({s: 0.0}, {t: 0.0}), ({}, {}), (set(), set())
    rows = (g.out, g.into)
    allowed = None if flags is None else (flags[0][:, flags[2][t]], flags[1][:, flags[2][s]])
    dead, near = g.dead, (g.nearby(0, t), g.nearby(1, s))
    y, x, shift = g.y, g.x, {}

    def lean(i: int) -> float:
        if speed is None:
            return 0.0
        v = shift.get(i)
        if v is None:
            end = ((y[i] - y[t]) ** 2 + (x[i] - x[t]) ** 2) ** 0.5
            begin = ((y[i] - y[s]) ** 2 + (x[i] - x[s]) ** 2) ** 0.5
            v = shift[i] = (end - begin) / speed * DISCOUNT / 2
        return v

    heaps = ([(lean(s), s)], [(-lean(t), t)])
    best, meet = INF, None
    while heaps[0] and heaps[1]:
        if heaps[0][0][0] + heaps[1][0][0] >= best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, i = heappop(heaps[side])
        if i in done[side]:
            continue
        done[side].add(i)
        if i in done[1 - side]:
            continue
        mine, other, sign, c = cost[side], cost[1 - side], 1 - 2 * side, cost[side][i]
        first, links, to = rows[side]
        for k in links[first[i] : first[i + 1]]:
            new, j = c + time[k], to[k]
            if dead[side][j] and near[side] is not None and j not in near[side]:
                continue
            if allowed is not None and not allowed[side][k]:
                continue
            if new < mine.get(j, INF):
                mine[j] = new
                via[side][j] = (i, k)
                if new + other.get(j, INF) < best:
                    best, meet = new + other[j], j
                key = new if speed is None else new + sign * lean(j)
                if not heaps[1 - side] or key + heaps[1 - side][0][0] < best:
                    heappush(heaps[side], (key, j))
    if meet is None:
        return None
    path, i = [], meet
    while i != s:
        i, k = via[0][i]
        path.append(k)
    path.reverse()
    i = meet
    while i != t:
        i, k = via[1][i]
        path.append(k)
    return sum(time[k] for k in path), path


def search(g: Graph, origin, dest, time: np.ndarray, speed: float | None = None, flags=None, alike=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, number of links, links of all paths) of trips between node numbers; -1 is no node, -1 links no path.

    alike: true for trips that share a tree to their destination, as others to it do. Else as in route. flags may be packed, eight regions a byte.
    """
    # The helper takes longer to start than Python for a few trips.
    if (len(origin) >= FEW or "router" in g.__dict__) and g.router is not None:
        return g.router.routes(origin, dest, time, speed, flags, alike)
    if flags is not None and flags[0].dtype == np.uint8:
        flags = (*(np.unpackbits(x, 1) for x in flags[:2]), flags[2])
    listed = array("d", np.asarray(time, float).tobytes())
    cost, size, flat = np.full(len(origin), np.nan), np.full(len(origin), -1, np.int32), []
    for i, (s, t) in enumerate(zip(np.asarray(origin).tolist(), np.asarray(dest).tolist())):
        if s < 0 or t < 0:
            continue
        same = g.towards[0] is time and g.towards[1] == t
        if alike is not None and alike[i] and not same:
            g.towards, same = (time, t, ways(g, t, listed)), True
        found = way(g, s, t, g.towards[2], listed) if alike is not None and same else route(g, s, t, listed, speed, flags)
        if found is not None:
            cost[i], size[i] = found[0], len(found[1])
            flat += found[1]
    return cost, size, np.array(flat, np.int32)


def boundary_region(g: Graph, region: np.ndarray) -> np.ndarray:
    """The region of each boundary node, -1 of the others."""
    crossing = region[g.u] != region[g.v]
    at = np.full(len(g.ids), -1, np.int64)
    for x in (g.u[crossing], g.v[crossing]):
        at[x] = region[x]
    return at


def first_link_flags(g: Graph, node: int, time, target: list[int], wanted: set[int], reverse: bool) -> set[tuple[int, int]]:
    """(link, region): the links out of node (into it, if reverse) on a least-cost path to (from) a boundary node of a wanted region.

    One search from the node carries, for each node it meets, which first links lie on a least-cost path there (a bit
    each). It ends once every pair is found, or no open node can show one that is missing.
    """
    first, links, to = g.into if reverse else g.out
    own = [k for k in links[first[node] : first[node + 1]] if time[k] > 0]
    need = {r: (1 << len(own)) - 1 for r in wanted}
    missing = (1 << len(own)) - 1 if wanted else 0
    cost, bits, done, heap, found = {node: 0.0}, {node: 0}, {node}, [], set()
    alive = 0

    def reach(j, new, b):
        nonlocal alive
        old = cost.get(j, INF)
        if new <= old + 1e-9 * max(1.0, new):
            if j in done:
                return
            was = bits.get(j, 0)
            now = b if new < old - 1e-9 * max(1.0, new) else was | b
            alive += bool(now & missing) - bool(was & missing)
            bits[j] = now
            if new < old:
                cost[j] = new
                heappush(heap, (new, j))

    for n, k in enumerate(own):
        reach(to[k], time[k], 1 << n)
    while heap and alive:
        c, i = heappop(heap)
        if i in done:
            continue
        done.add(i)
        b, r = bits[i], target[i]
        alive -= bool(b & missing)
        if r in need and need[r] & b:
            found.update((k, r) for n, k in enumerate(own) if need[r] & b & (1 << n))
            need[r] &= ~b
            missing = 0
            for x in need.values():
                missing |= x
            alive = sum(1 for j, x in bits.items() if x & missing and j not in done)
        for k in links[first[i] : first[i + 1]]:
            w = time[k]
            if w > 0:
                reach(to[k], c + w, b)
    return found


def flags_of(g: Graph, time: np.ndarray, region: np.ndarray, regions: list[int], nodes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(links out of the nodes, their forward flags), (links into them, their backward flags); a row a link, eight regions a byte.

    A link is flagged for a region if it lies on a least-cost path to (from) one of the region's boundary nodes, or
    touches the region.
    """
    names = np.asarray(sorted(regions), np.int64)

    def column(of):
        at = np.minimum(np.searchsorted(names, of), max(len(names) - 1, 0))
        return np.where(names[at] == of, at, -1) if len(names) else np.full(len(of), -1)

    target, nodes = column(boundary_region(g, region)), np.asarray(nodes, np.int64)
    if (len(nodes) >= FEW // 10 or "router" in g.__dict__) and g.router is not None:
        found = g.router.flags_of(nodes, time, target, len(names))
    else:
        found, listed, aim, wanted = [], array("d", np.asarray(time, float).tobytes()), target.tolist(), set(target.tolist()) - {-1}
        for side in (0, 1):
            first, links, _ = g.into if side else g.out
            own = np.array([k for i in nodes.tolist() for k in links[first[i] : first[i + 1]]], np.int64)
            place, bits = {k: p for p, k in enumerate(own.tolist())}, np.zeros((len(own), len(names)), bool)
            for i in nodes.tolist():
                for k, c in first_link_flags(g, i, listed, aim, wanted, side == 1):
                    bits[place[k], c] = True
            found.append((own, np.packbits(bits, 1)))
    for links, bits in found:
        for ends in (g.u, g.v):
            c = column(region[ends[links]])
            at = np.flatnonzero(c >= 0)
            bits[at, c[at] >> 3] |= (128 >> (c[at] & 7)).astype(np.uint8)
    return found


def arc_flags(g: Graph, time: list[float], region: np.ndarray, regions: list[int], nodes=None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward flags (links x regions, true or false) as flags_of finds them. nodes: all unless given."""
    flags = np.zeros((2, len(g.u), len(regions)), bool)
    order = np.argsort(np.argsort(regions, kind="stable"), kind="stable")
    for side, (links, bits) in enumerate(flags_of(g, np.asarray(time, float), region, regions, range(len(g.ids)) if nodes is None else nodes)):
        flags[side, links] = np.unpackbits(bits, 1, count=len(regions)).astype(bool)[:, order]
    return flags[0], flags[1]


# ---------------------------------------------------------------- estimation

STEP, SHRINK, LEAST, TOP_SPEED = 0.2, 0.75, 0.0001, 30.0


def weight_of(scheme, true, estimate):
    """Weights of trips by their distances; scheme: None or (abs | rel, gauss | lasso | threshold, bandwidth)."""
    if scheme is None:
        return np.ones(len(true))
    kind, kernel, band = scheme
    error = estimate - true
    if kind == "rel":
        error = error / np.where(true == 0, np.nan, true)
    if kernel == "gauss":
        return np.nan_to_num(np.exp(-((error / band) ** 2)))
    if kernel == "lasso":
        return np.nan_to_num(1 - np.minimum(1, np.abs(error / band)))
    return (error < band).astype(float)


class Observed:
    """Collapsed trips: origin, dest (node numbers), dist, and all their times in one ragged array."""

    def __init__(self, origin, dest, dist, times):
        self.origin, self.dest, self.dist = list(origin), list(dest), np.asarray(dist, float)
        self.n = np.array([len(x) for x in times], np.int64)
        self.trip = np.repeat(np.arange(len(self.n)), self.n)
        self.time = np.array([t for x in times for t in x], float)

    def errors(self, estimate):
        """(mean absolute, mean relative) over all observations of routed trips."""
        e = estimate[self.trip]
        ok = np.isfinite(e)
        if not ok.any():
            return 0.0, 0.0
        off = np.abs(e[ok] - self.time[ok])
        return float(off.mean()), float((off / np.where(self.time[ok] == 0, np.nan, self.time[ok])).mean())


def routes(g: Graph, origin: list[int], dest: list[int], time: np.ndarray, goal: bool = False):
    """(link numbers of all paths, the trip of each, trips without a path) of trips between node numbers."""
    _, size, flat = search(g, origin, dest, time, g.max_speed(time) if goal and g.y is not None else None)
    return flat.astype(np.int64), np.repeat(np.arange(len(size)), np.maximum(size, 0)), np.flatnonzero(size < 0)


_GRAPHS: dict = {}


def cached_graph(number, raw) -> Graph:
    """The graph of a broadcast's arrays, built once per worker."""
    if number not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[number] = Graph(*raw)
    return _GRAPHS[number]


def estimate(
    g: Graph, trips: Observed, max_iter: int = 20, scheme=None, goal: bool = False, test: Observed | None = None, relative=False,
    speed: float | None = None, router=None, last_only: bool = False,
):
    """(link times, weighted trips per link, train errors, test errors) by routing and stepwise correction.

    speed: where all links start (metres a second), the mean over the trips with their times unless given.

    Every iteration routes all trips, finds for each link whether the trips over it are estimated too long or too short,
    and takes the largest step against that which lowers the total error with the paths held fixed. Trips without a path
    are left out. relative: errors and signs are relative, as an older variant has it. router(trips, time): routes all trips,
    in place of doing it here. last_only: the test trips are routed once, at the end.
    """
    router = router or (lambda some, t: routes(g, some.origin, some.dest, t, goal))
    total = trips.time.sum()
    if speed is None or not speed > 0:
        speed = (trips.dist * trips.n).sum() / total if total > 0 else 10.0
    time, n_links, m = g.length / max(speed, 1e-9), len(g.length), len(trips.n)
    train, held, counts = [], [], np.zeros(n_links)
    floor = g.length / TOP_SPEED

    def price(t, flat, of, failed):
        out = np.bincount(of, weights=t[flat], minlength=m).astype(float)
        out[failed] = np.nan
        return out

    def test_errors(t):
        f, o, x = router(test, t)
        out = np.bincount(o, weights=t[f], minlength=len(test.n)).astype(float)
        out[x] = np.nan
        return test.errors(out)

    paths = None
    for _ in range(max_iter):
        paths = router(trips, time)
        flat, of, failed = paths
        guess = price(time, *paths)
        w = weight_of(scheme, trips.dist, price(g.length, *paths))
        train.append(trips.errors(guess))
        if test is not None:
            held.append((np.nan, np.nan) if last_only else test_errors(time))
        routed = np.isfinite(guess)[trips.trip]
        scale = 1 / np.maximum(trips.time, 1e-9) if relative else np.ones(len(trips.time))

        def objective(est):
            off = np.abs(est[trips.trip] - trips.time) * w[trips.trip] * scale
            return off[routed].sum()

        gap = guess[trips.trip] - trips.time
        sign = (gap if relative else np.sign(gap)) * w[trips.trip]
        per_trip = np.bincount(trips.trip[routed], weights=sign[routed], minlength=m)
        offset = np.bincount(flat, weights=per_trip[of], minlength=n_links)
        counts = np.bincount(flat, weights=(w * trips.n)[of], minlength=n_links)
        now, step, better = objective(guess), STEP, False
        while step > LEAST and not better:
            trial = np.maximum(np.where(offset > 0, time / (1 + step), np.where(offset < 0, time * (1 + step), time)), floor)
            better = objective(price(trial, *paths)) < now
            step *= SHRINK
        if not better:
            break
        time = trial
    if paths is not None:
        train.append(trips.errors(price(time, *paths)))
        if test is not None:
            held.append(test_errors(time))
    return time, counts, train, held
