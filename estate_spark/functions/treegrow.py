"""Growing boosted regression trees over rows whose features are bin numbers.

A feature's bins are cut once, before the first round. Features with few bins share a column: the
code in it is their numbers in a mixed base of at most 256, so one count over a column's codes gives
the counts of all its features by sums over the others' digits. A task counts, per node and code, rows
and gradients; the driver adds the tasks' counts and picks each node's split. Of two siblings only the
smaller one is counted, the other is what the parent has left.

Rows lie in chunks with the number of their part: ``codes`` (column x row), the rows that are fitted first, ``fit`` of them, then the
held ones, and ``miss`` (model x row), what the label is above the score. Plain NumPy, so that the tasks
need no copy of the package."""

from __future__ import annotations

import math

import numpy as np

SHARED = 256                     # codes of a column that several features share
CHUNK = 1 << 16                  # rows that are worked on at once, about
FEW_BINS = 64                    # features of at most so many bins are split together
MOST_VALUES, POINTS = 1 << 16, 8192     # values of a feature counted one by one; weighted points beyond


# ---------------------------------------------------------------- bins
def weighted(values: np.ndarray, weights: np.ndarray, most: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights; beyond ``most`` of them ``points`` of about equal weight."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where.ravel(), weights=weights, minlength=len(values))
    if len(values) > most:
        run = np.cumsum(weights)
        group = np.minimum((run * (points / run[-1])).astype(np.int64), points - 1)
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        values, weights = values[last], np.diff(run[last], prepend=0.0)
    return values, weights


def merged(parts: list, most: int = MOST_VALUES, points: int = POINTS) -> list:
    """Summaries of the same features, one after the other, as one."""
    return [weighted(np.concatenate([p[f][0] for p in parts]), np.concatenate([p[f][1] for p in parts]), most, points)
            for f in range(len(parts[0]))] if parts else []


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds: between all values where they are few, else equi-depth."""
    at = np.arange(len(values) - 1)
    if len(at) > bins - 1:
        run = np.cumsum(weights)
        want = run[-1] / bins * np.arange(1, bins)
        hi = np.clip(np.searchsorted(run, want), 1, len(run) - 1)
        near = np.where(want - run[hi - 1] < run[hi] - want, hi - 1, hi)
        at = np.unique(near[near < len(values) - 1])
    middle = values[at] + (values[at + 1] - values[at]) / 2
    return np.where(middle < values[at + 1], middle, values[at])


class Layout:
    """Where features lie: ``cuts`` (None for a category), ``sizes`` in bins, their column and the
    stride of their digit in its codes. A feature of one bin is never split and lies nowhere."""

    def __init__(self, cuts: list, sizes: list[int]):
        self.cuts, self.sizes = cuts, sizes
        self.column, self.stride, self.widths = [-1] * len(sizes), [1] * len(sizes), []
        for f in sorted((f for f in range(len(sizes)) if sizes[f] > 1), key=lambda f: -sizes[f]):
            room = [c for c, w in enumerate(self.widths) if w * sizes[f] <= SHARED]
            if not room:
                room = [len(self.widths)]
                self.widths.append(1)
            c = room[0]
            self.column[f], self.stride[f] = c, self.widths[c]
            self.widths[c] *= sizes[f]
        self.widths = self.widths or [1]
        self.dtype = np.uint8 if max(self.widths) <= 256 else np.uint16 if max(self.widths) <= 65536 else np.uint32
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes, column x row, of rows x features."""
        out = np.zeros((len(self.widths), len(x)), dtype=np.int64)
        for f, (cuts, size) in enumerate(zip(self.cuts, self.sizes)):
            if self.column[f] >= 0:
                bins = x[:, f].astype(np.int64) if cuts is None else np.searchsorted(cuts, x[:, f], side="left")
                if cuts is None and len(bins) and not (0 <= bins.min() and bins.max() < size):
                    raise ValueError(f"feature {f}: a category number beyond its {size} levels")
                out[self.column[f]] += bins * self.stride[f]
        return out.astype(self.dtype)

    def groups(self):
        """Features looked at together: their numbers, their bins' cells (one beyond all bins where a
        feature has fewer), and whether their bins are in order."""
        some = [f for f in range(len(self.sizes)) if self.column[f] >= 0]
        few = [f for f in some if self.sizes[f] <= FEW_BINS]
        for features in [few, *[[f] for f in some if self.sizes[f] > FEW_BINS]]:
            if features:
                at = np.arange(max(self.sizes[f] for f in features))
                cells = np.array([np.where(at < self.sizes[f], self.starts[f] + at, self.starts[-1]) for f in features])
                yield features, cells, np.array([self.cuts[f] is not None for f in features])

    def digits(self, f: int) -> np.ndarray:
        """The feature's bin of each code of its column."""
        return np.arange(self.widths[self.column[f]]) // self.stride[f] % self.sizes[f]


# ---------------------------------------------------------------- what tasks do
def loss(miss: np.ndarray, alpha: float | None) -> float:
    """Sum of the squared error, or of the pinball loss of the quantile ``alpha``."""
    return float((miss * miss if alpha is None else np.maximum(alpha * miss, (alpha - 1.0) * miss)).sum())


def route(codes: np.ndarray, walk: tuple, rows: int | None = None) -> np.ndarray:
    """Number of the node that each of the first ``rows`` rows reaches. ``walk``: levels, a node's column,
    and the next node by node and code; a leaf leads to itself."""
    levels, column, following = walk
    rows = codes.shape[1] if rows is None else rows
    if not levels or not rows:
        return np.zeros(rows, dtype=np.intp)
    node = following[0].take(codes[column[0], :rows], mode="clip").astype(np.intp)
    flat, table = np.ascontiguousarray(codes).reshape(-1), following.reshape(-1)
    at, own, line = np.arange(rows), column * codes.shape[1], np.arange(len(column)) * following.shape[1]
    for _ in range(levels - 1):
        cell = own.take(node, mode="clip")
        cell += at
        code = flat.take(cell, mode="clip")
        line.take(node, out=cell, mode="clip")
        cell += code
        node = table.take(cell, mode="clip").astype(np.intp)
    return node


BOTH = 2.0 ** 26                 # a part has fewer rows, so a count of rows and one of marked rows fit one double


def count_codes(chunks, layout: Layout, asked: list) -> list:
    """Per asked (model, alpha, walk, slot of each node or -1, slots, known): rows and gradients by slot and bin,
    the last column without regard to bins, and squared gradients by slot. Rows that are known aren't
    counted. A quantile's gradients take two values, so one sum counts rows and those above."""
    wide = [max(w, min(SHARED, max(layout.widths))) for w in layout.widths]
    found = [([np.zeros(s * w) for w in wide], [np.zeros(s * w) for w in wide], np.zeros(s)) for *_, s, _ in asked]
    for _, (codes, fit, miss) in chunks:
        for (m, alpha, walk, slot, slots, known), (rows, sums, squares) in zip(asked, found):
            g, here, some = miss[m, :fit], None, None
            if walk[0]:
                here = slot.take(route(codes, walk, fit))
                some = np.flatnonzero(here >= 0)
                here, g = here[some], g[some]
            if alpha is None:
                squares += np.bincount(here, weights=g * g, minlength=slots) if here is not None else g @ g
            else:
                g = BOTH + (g > 0)
            bases = {} if here is None else {w: here * w for w in set(wide)}
            place = np.empty(len(g), dtype=np.intp)
            for c, w in enumerate(wide):
                at = codes[c, :fit]
                if here is not None:
                    place[:] = at.take(some, mode="clip")
                    at = np.add(place, bases[w], out=place)
                if alpha is None and not known:
                    rows[c] += np.bincount(at, minlength=slots * w)
                sums[c] += np.bincount(at, weights=g, minlength=slots * w)
    out = []
    for (rows, sums, squares), (_, alpha, _, _, s, known) in zip(found, asked):
        if alpha is not None:
            rows = [np.floor(t / BOTH) for t in sums]
            above = [t - r * BOTH for t, r in zip(sums, rows)]
            sums = [a - (1.0 - alpha) * r for a, r in zip(above, rows)]
            n, a = rows[0].reshape(s, -1).sum(1), above[0].reshape(s, -1).sum(1)
            squares = alpha ** 2 * a + (1.0 - alpha) ** 2 * (n - a)
        out.append((np.zeros(0) if known else by_feature(layout, wide, rows, s), by_feature(layout, wide, sums, s), squares))
    return out


def by_feature(layout: Layout, wide: list[int], columns: list[np.ndarray], slots: int) -> np.ndarray:
    """Counts by code of each column as counts by bin of each feature, and all together: slot x bin."""
    out = np.zeros((slots, layout.starts[-1] + 1))
    out[:, -1] = columns[0].reshape(slots, -1).sum(1)
    for f, size in enumerate(layout.sizes):
        c, a = layout.column[f], layout.starts[f]
        if c < 0:
            continue
        whole = columns[c].reshape(slots, wide[c])[:, :layout.widths[c]]
        out[:, a:a + size] = whole.reshape(slots, -1, size, layout.stride[f]).sum(axis=(1, 3))
    return out


def held_losses(chunks, asked: list) -> list[float]:
    """Per asked (model, alpha), the held rows' losses together."""
    totals = [0.0] * len(asked)
    for _, (_, fit, miss) in chunks:
        for i, (m, alpha) in enumerate(asked):
            totals[i] += loss(miss[m, fit:], alpha)
    return totals


def first_counts(chunks, layout: Layout, asked: list, held: list):
    """One task's answer at the start of a round: held losses, and the counts of the root."""
    chunks = list(chunks)
    return held_losses(chunks, held), count_codes(chunks, layout, asked)


def windows(chunks, asked: list) -> list:
    """Per asked (model, alpha, walk, leaf of each node, leaves, wanted leaves, width): for each wanted leaf its
    rows here, and the values around the quantile's place among them: (leaf, rows, place of the first, values)."""
    chunks, out = list(chunks), []
    for m, alpha, walk, leaf, leaves, wanted, width in asked:
        parts = [(leaf.take(route(codes, walk, fit)).astype(np.uint16), miss[m, :fit]) for _, (codes, fit, miss) in chunks]
        found = []
        if parts:
            own, value = (np.concatenate(p) for p in zip(*parts))
            value = value[np.argsort(own, kind="stable")]
            ends = np.cumsum(np.bincount(own, minlength=leaves))
            for k in wanted:
                v = value[ends[k - 1] if k else 0:ends[k]]
                if len(v):
                    place, spare = (len(v) - 1) * alpha, math.ceil(width * math.sqrt(len(v) * alpha * (1.0 - alpha))) + 2
                    lo, hi = max(0, math.floor(place) - spare), min(len(v) - 1, math.ceil(place) + spare)
                    v = np.partition(v, sorted({lo, hi}))
                    found.append((k, len(v), lo, np.sort(v[lo:hi + 1])))
        out.append(found)
    return out


def moved(chunk: tuple, moves: list, keep: list[int]) -> tuple:
    """The chunk after a round: per (model, walk, step of each node) what the tree adds to the score;
    only the models ``keep`` go on."""
    part, (codes, fit, miss) = chunk
    miss = miss[keep]
    for m, walk, step in moves:
        miss[m] -= step.take(route(codes, walk))
    return part, (codes, fit, miss)


def answer(chunks, run, **asked):
    """One answer a task."""
    yield run(chunks, **asked)


def summed(a, b):
    """Answers of two tasks together."""
    return a + b if isinstance(a, (float, np.ndarray)) else type(a)(summed(x, y) for x, y in zip(a, b))


def joined(a: list, b: list) -> list:
    """Windows of two tasks together."""
    return [x + y for x, y in zip(a, b)]


def summaries(batches, features: int, numeric: list[int], points: int):
    """From Arrow batches of x: one row with the values and weights of the numeric features."""
    import pickle
    import pyarrow as pa
    held, found = [], None

    def taken():
        x = np.concatenate(held)
        own = [weighted(x[:, f], np.ones(len(x)), MOST_VALUES, points) for f in numeric]
        return merged([found, own], points=points) if found else own

    for b in batches:
        if b.num_rows:
            held.append(flat(b.column(0), features))
        if sum(map(len, held)) >= CHUNK:
            found, held = taken(), []
    if held:
        found = taken()
    if found:
        yield pa.RecordBatch.from_pydict({"found": [pickle.dumps([weighted(v, w, points, points) for v, w in found])]})


def flat(column, features: int) -> np.ndarray:
    """Rows x features of an Arrow column of arrays."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def encoded(batches, features: int, layout: Layout):
    """From Arrow batches of x, label and held: rows of part, rows, fitted rows, codes and labels, a chunk each."""
    import pyarrow as pa
    from pyspark import TaskContext
    part, held = TaskContext.get().partitionId(), []

    def chunk():
        x, y, aside = (np.concatenate(p) for p in zip(*held))
        order = np.argsort(aside, kind="stable")
        codes = layout.encode(x[order])
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(y)]), pa.array([int((~aside).sum())]), pa.array([codes.tobytes()], pa.binary()),
                                           pa.array([y[order].tobytes()], pa.binary())], ["part", "rows", "fit", "codes", "miss"])

    for b in batches:
        if b.num_rows:
            held.append((flat(b.column(0), features), b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False).astype(bool)))
        if sum(len(h[1]) for h in held) >= CHUNK:
            yield chunk()
            held = []
    if held:
        yield chunk()


def keyed(row) -> tuple:
    return row[0], tuple(row)


def unpacked(row: tuple, kind, bases: list[float] | None = None) -> tuple:
    """The chunk of a stored row; of labels, what they are above each base."""
    part, rows, fit, codes, miss = row
    miss = np.frombuffer(miss, dtype=float).reshape(-1, rows)
    if bases is not None:
        miss = miss - np.array(bases)[:, None]
    return part, (np.frombuffer(codes, dtype=kind).reshape(-1, rows), fit, miss)


def packed(chunk: tuple) -> tuple:
    part, (codes, fit, miss) = chunk
    return part, codes.shape[1], fit, codes.tobytes(), miss.tobytes()


# ---------------------------------------------------------------- what the driver does
def quantile_of(parts: list, alpha: float) -> float | None:
    """The quantile (rank (n-1) alpha, interpolated) of the tasks' values, from the windows they sent;
    None where a window doesn't reach far enough for it to be exact."""
    n, below = sum(p[1] for p in parts), sum(p[2] for p in parts)
    values = np.sort(np.concatenate([p[3] for p in parts]))
    least = max((p[3][0] for p in parts if p[2]), default=-math.inf)
    most = min((p[3][-1] for p in parts if p[2] + len(p[3]) < p[1]), default=math.inf)
    place = (n - 1) * alpha
    got = []
    for rank in (math.floor(place), math.ceil(place)):
        i = rank - below
        if not (0 <= i < len(values) and least <= values[i] <= most):
            return None
        got.append(float(values[i]))
    part = place - math.floor(place)
    return got[0] if part == 0 or got[0] == got[1] else got[0] * (1 - part) + got[1] * part


def best_splits(rows: np.ndarray, sums: np.ndarray, layout: Layout, least_rows: int, least_gain: float) -> list:
    """Per node the split that lowers the squared error most, as (gain, feature, bins on the left, rows and sum there);
    None without one. Categories are cut in the order of their means."""
    n, s = rows[:, -1], sums[:, -1]
    before = (s * s / np.maximum(n, 1))[:, None, None]
    best, found = np.full(len(rows), least_gain), [None] * len(rows)
    rows, sums = (np.concatenate([x[:, :-1], np.zeros((len(x), 1))], axis=1) for x in (rows, sums))
    nodes = np.arange(len(rows))
    for features, cells, ordered in layout.groups():
        c, g = rows[:, cells], sums[:, cells]                   # node x feature x bin, empty bins behind
        key = np.where(c > 0, g / np.maximum(c, 1), np.inf)
        key[:, ordered] = np.arange(cells.shape[1])
        order = np.argsort(key, axis=2, kind="stable")
        nl, sl = (np.cumsum(np.take_along_axis(x, order, 2), 2) for x in (c, g))
        nr, sr = n[:, None, None] - nl, s[:, None, None] - sl
        gain = np.where((nl >= least_rows) & (nr >= least_rows), sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1) - before, -np.inf)
        at = gain.reshape(len(rows), -1).argmax(1)
        which, place = np.divmod(at, cells.shape[1])
        top = gain[nodes, which, place]
        for i in np.flatnonzero(top > best):
            f, p = features[which[i]], place[i]
            left = np.zeros(layout.sizes[f], dtype=bool)
            left[order[i, which[i], :p + 1]] = True
            best[i], found[i] = top[i], (float(top[i]), f, left, float(nl[i, which[i], p]), float(sl[i, which[i], p]))
    return found


class Grown:
    """A tree while it grows: its nodes, and the counts of those at its edge."""

    def __init__(self, layout: Layout):
        self.layout, self.depth = layout, 0
        self.nodes = [{"kids": None}]
        self.edge, self.counts, self.asked, self.parent = [0], {}, [0], {}

    def walk(self) -> tuple:
        kind = np.uint8 if len(self.nodes) <= 256 else np.int32
        column = np.zeros(len(self.nodes), dtype=np.intp)
        following = np.repeat(np.arange(len(self.nodes)).astype(kind)[:, None], max(self.layout.widths), axis=1)
        for i, node in enumerate(self.nodes):
            if node["kids"]:
                f = node["feature"]
                digits = self.layout.digits(f)
                column[i] = self.layout.column[f]
                following[i, :len(digits)] = np.where(node["left"][digits], *node["kids"])
        return self.depth, column, following

    def slots(self) -> tuple[np.ndarray, int, bool]:
        """Which of the counts that are asked for each node has, -1 without, how many there are, and that
        none is known."""
        slot = np.full(len(self.nodes), -1, dtype=np.intp)
        slot[self.asked] = np.arange(len(self.asked))
        return slot, len(self.asked), False

    def grow(self, rows: np.ndarray, sums: np.ndarray, squares: np.ndarray, least_rows: int) -> None:
        """Take the counts of the asked nodes, complete those of their siblings, and split the edge."""
        counts = dict(zip(self.asked, zip(rows, sums, squares)))
        for other, (sibling, parent) in self.parent.items():
            counts[other] = tuple(p - c for p, c in zip(self.counts[parent], counts[sibling]))
        self.counts = counts
        for i in self.edge:
            self.nodes[i] |= {"n": float(counts[i][0][-1]), "s": float(counts[i][1][-1]), "q": max(0.0, float(counts[i][2]))}
        # less than rounding errors is no gain
        splits = best_splits(*(np.array([counts[i][k] for i in self.edge]) for k in (0, 1)), self.layout, least_rows, 1e-12 * self.nodes[0]["q"])
        edge, self.asked, self.parent = [], [], {}
        for i, split in zip(self.edge, splits):
            if split is None:
                continue
            node, (gain, f, left, nl, sl) = self.nodes[i], split
            kids = len(self.nodes), len(self.nodes) + 1
            node |= {"gain": gain / node["n"], "feature": f, "left": left, "kids": kids}
            self.nodes += [{"n": nl, "s": sl, "kids": None}, {"n": node["n"] - nl, "s": node["s"] - sl, "kids": None}]
            small, large = kids if nl <= node["n"] - nl else kids[::-1]
            edge += kids
            self.asked.append(small)
            self.parent[large] = small, i
        self.edge, self.depth = edge, self.depth + bool(edge)

    def in_order(self) -> list[int]:
        """The nodes from the root, a left branch before the right one, as Spark ML numbers them."""
        out, todo = [], [0]
        while todo:
            out.append(todo.pop())
            todo += (self.nodes[out[-1]]["kids"] or ())[::-1]
        return out

    def leaves(self) -> list[int]:
        """The nodes without children, from left to right."""
        return [i for i in self.in_order() if not self.nodes[i]["kids"]]

    def rows(self, steps: dict[int, float]) -> list[tuple]:
        """The nodes as Spark ML saves them, a leaf's step as its prediction. Leaves of the lowest
        level have no count of squared gradients and so an impurity of -1, as Spark's own may."""
        number = {i: k for k, i in enumerate(self.in_order())}
        out = []
        for i, k in number.items():
            node = self.nodes[i]
            n, s, q = node["n"], node["s"], node.get("q")
            own = (-1.0 if q is None else max(0.0, q / n - (s / n) ** 2), [n, s, 0.0 if q is None else q], int(n))
            if node["kids"]:
                f = node["feature"]
                cuts = self.layout.cuts[f]
                split = ((f, [float(c) for c in np.flatnonzero(node["left"])], self.layout.sizes[f]) if cuts is None
                         else (f, [float(cuts[int(node["left"].sum()) - 1])], -1))
                out.append((k, s / n, *own, node["gain"], *(number[c] for c in node["kids"]), split))
            else:
                out.append((k, steps[i], *own, -1.0, -1, -1, (-1, [], -1)))
        return out


class Forest:
    """The trees of stored ensembles, for many rows at once: a row is encoded once by the thresholds
    that the trees have, and walks through tables of codes."""

    def __init__(self, features: int, nodes: list[dict], weights: list[list[float]]):
        """Per ensemble its nodes' columns, ordered by tree and number, and its trees' weights."""
        cuts: list[list] = [[] for _ in range(features)]
        levels = [0] * features
        for own in nodes:
            for f, values, kinds in zip(own["feature"], own["values"], own["kinds"]):
                if f >= 0 and kinds >= 0:
                    levels[f] = kinds
                elif f >= 0:
                    cuts[f].append(values[0])
        self.layout = Layout([None if levels[f] else np.unique(cuts[f]) for f in range(features)],
                             [levels[f] or len(np.unique(cuts[f])) + 1 for f in range(features)])
        self.ensembles = [self._trees(own, w) for own, w in zip(nodes, weights)]

    def _trees(self, own: dict, weights: list[float]) -> list[tuple]:
        out, starts = [], np.flatnonzero(np.asarray(own["id"]) == 0).tolist()
        for a, b, weight in zip(starts, [*starts[1:], len(own["id"])], weights):
            left, right, feature = (np.array(own[k][a:b], dtype=np.intp) for k in ("left", "right", "feature"))
            leaf, rank, masks, depth = left < 0, np.zeros(b - a), [], np.zeros(b - a, dtype=int)
            for i in np.flatnonzero(~leaf):
                depth[left[i]] = depth[right[i]] = depth[i] + 1
                cuts, values = self.layout.cuts[feature[i]], own["values"][a + i]
                if cuts is None:
                    mask = np.zeros(self.layout.sizes[feature[i]], dtype=bool)
                    mask[np.array(values, dtype=int)] = True
                    masks.append((int(i), mask))
                else:
                    rank[i] = np.searchsorted(cuts, values[0])
            itself = np.arange(b - a)
            out.append((int(depth.max()), np.where(leaf, 0, feature).astype(np.int32), rank.astype(np.int32), masks, np.where(leaf, itself, left).astype(np.int32),
                        np.where(leaf, itself, right).astype(np.int32), weight * np.array(own["prediction"][a:b])))
        return out

    def predictions(self, x: np.ndarray) -> list[np.ndarray]:
        """Per ensemble the sum of its weighted trees, of rows x features."""
        layout = self.layout
        codes, width = layout.encode(x), max(layout.widths)
        digits = np.zeros((len(layout.sizes), width), dtype=np.int32)
        for f, c in enumerate(layout.column):
            if c >= 0:
                digits[f, :layout.widths[c]] = layout.digits(f)
        column, out = np.maximum(layout.column, 0), []
        for trees in self.ensembles:
            total = np.zeros(len(x))
            for levels, feature, rank, masks, left, right, value in trees:
                goes = digits[feature] <= rank[:, None]
                for i, mask in masks:
                    goes[i] = mask[digits[feature[i]]]
                following = np.where(goes, left[:, None], right[:, None])
                total += value.take(route(codes, (levels, column[feature], following)))
            out.append(total)
        return out
