"""Path-dependent Shapley values of a tree ensemble for a matrix of rows.

After Lundberg et al. (2018): with coalition S the expected leaf weight is the product
over the path's features of o_j (row satisfies every split on j, 0 or 1) for j in S and
z_j (share of training rows that do) otherwise. A leaf's Shapley value for feature i is
then value * (o_i - z_i) * sum_s w(s) e_s, where e_s are the coefficients of
prod_{j != i} (z_j + o_j t) and w(s) = s! (d-1-s)! / d!.

``tree_of`` and ``ensemble_contributions`` are the form for large ensembles. A row meets a leaf with
one bit per path feature, so a leaf has at most 2^d different answers: they are tabulated once
a batch for all leaves of a tree together, a walk over the nodes gives every row its bits (a child takes
its parent's and changes one), and rows of the same bits read the same entry. The leaves of a
small branch are added up in one table, whose entries have a bit more for each of its splits. The weighted
sum over coalitions is the integral over t in [0, 1] of prod_{j != i} (z_j (1-t) + o_j t), a
polynomial of degree d - 1, which Gauss-Legendre points give exactly. Memory: the rows, their
contributions and one tree's tables. ``leaves_of`` and ``contributions`` state the same plainly, one
polynomial a leaf and feature; the tests hold one against the other.
"""

from __future__ import annotations

from math import factorial

import numpy as np

# a leaf: its value and feature -> (low, high, allowed categories or None, share z);
# plain tuples and dicts, so that executors need nothing but numpy to read them
Leaf = tuple[float, dict]


def leaves_of(nodes: list[dict], weight: float) -> list[Leaf]:
    """Leaves of one tree; ``nodes`` as Spark ML stores them, by id."""
    by_id = {n["id"]: n for n in nodes}
    out: list[Leaf] = []
    stack = [(by_id[0], {})]
    while stack:
        node, path = stack.pop()
        if node["leftChild"] < 0:
            out.append((weight * node["prediction"], path))
            continue
        split = node["split"]
        f, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
        for child_id, is_left in ((node["leftChild"], True), (node["rightChild"], False)):
            child = by_id[child_id]
            lo, hi, cats, z = path.get(f, (-np.inf, np.inf, None, 1.0))
            z = z * child["rawCount"] / node["rawCount"]
            if split["numCategories"] == -1:
                lo, hi = (lo, min(hi, values[0])) if is_left else (max(lo, values[0]), hi)
            else:
                every = set(range(split["numCategories"])) if cats is None else cats
                side = set(int(v) for v in values)
                cats = every & side if is_left else every - side
            stack.append((child, {**path, f: (lo, hi, cats, z)}))
    return out


def expected_value(leaves: list[Leaf]) -> float:
    return float(sum(value * np.prod([p[3] for p in path.values()]) for value, path in leaves))


def contributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    phi = np.zeros(x.shape)
    for value, path in leaves:
        feats = list(path)
        d = len(feats)
        if d == 0:
            continue
        hit, share = [], []
        for f in feats:
            lo, hi, cats, z = path[f]
            col = x[:, f]
            ok = (col > lo) & (col <= hi)
            if cats is not None:
                ok &= np.isin(col, list(cats))
            hit.append(ok.astype(float))
            share.append(z)
        for i in range(d):
            coef = np.zeros((x.shape[0], d))
            coef[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    coef[:, 1:] = coef[:, 1:] * share[j] + coef[:, :-1] * hit[j][:, None]
                    coef[:, 0] *= share[j]
            w = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            phi[:, feats[i]] += value * (hit[i] - share[i]) * (coef @ w)
    return phi


TABLE_BITS = 8                   # path features up to which all bit patterns are tabulated
BRANCH_SPLITS = 7                # splits up to which the leaves of a branch are read as one table
# a node: (feature, threshold or None, categories to the left or None, bit, whether the path
# meets the feature for the first time, left, right), or a leaf's (number of features, position)
# a tree: the root and per number of features (values, shares, features) of its leaves
Tree = tuple[tuple, dict]


def tree_of(nodes: list[dict], weight: float) -> Tree:
    by_id = {n["id"]: n for n in nodes}
    groups: dict[int, list] = {}

    def build(i: int, path: dict[int, float]):
        node = by_id[i]
        if node["leftChild"] < 0:
            mine = groups.setdefault(len(path), [])
            mine.append((weight * node["prediction"], list(path.values()), list(path)))
            return len(path), len(mine) - 1
        split = node["split"]
        f, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
        numeric = split["numCategories"] == -1
        fresh = f not in path
        bit = len(path) if fresh else list(path).index(f)
        sides = [build(node[side], {**path, f: path.get(f, 1.0) * by_id[node[side]]["rawCount"] / node["rawCount"]})
                 for side in ("leftChild", "rightChild")]
        return f, values[0] if numeric else None, None if numeric else list(values), bit, fresh, *sides

    root = build(0, {})
    return root, {d: (np.array([g[0] for g in group], float), np.array([g[1] for g in group], float).reshape(len(group), d),
                      np.array([g[2] for g in group], int).reshape(len(group), d)) for d, group in groups.items()}


def ensemble_expected(trees: list[Tree]) -> float:
    return float(sum((values * shares.prod(axis=1)).sum() for _, groups in trees for values, shares, _ in groups.values()))


def pattern_values(values: np.ndarray, shares: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """(leaf, pattern, feature): contributions of leaves with d path features for bit patterns."""
    d = shares.shape[1]
    at, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    factor = shares[:, None, None, :] * (1 - at)[:, None] + hit[None, :, None, :] * at[:, None]
    others = np.ones_like(factor)
    others[..., 1:] = np.cumprod(factor[..., :-1], axis=-1)
    others[..., :-1] *= np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
    return values[:, None, None] * (hit[None] - shares[:, None, :]) * np.einsum("lpqd,q->lpd", others, weight)


def bits_of(patterns: np.ndarray, d: int) -> np.ndarray:
    return ((patterns[:, None].astype(np.int64) >> np.arange(d)) & 1).astype(float)


def splits_below(node: tuple) -> int:
    return 0 if len(node) == 2 else 1 + splits_below(node[5]) + splits_below(node[6])


def goes_left(columns: np.ndarray, node: tuple) -> np.ndarray:
    f, threshold, categories = node[:3]
    return columns[f] <= threshold if categories is None else np.isin(columns[f], categories)


def child_bits(bits: np.ndarray, ok: np.ndarray, bit: int, fresh: bool) -> np.ndarray:
    kind = bits.dtype.type
    moved = ok.astype(kind) << kind(bit)
    return bits | moved if fresh else bits & (moved | ~(kind(1) << kind(bit)))


def branch_table(branch: tuple, d: int, tables: dict, groups: dict) -> tuple[list[tuple], list[int], np.ndarray]:
    """Splits of a branch, features, and (feature, code): the contributions of all its leaves
    together. A code is the d bits of the way to the branch and one bit a split inside it."""
    splits: list[tuple] = []
    codes = np.arange(1 << (d + splits_below(branch)))
    found: dict[int, np.ndarray] = {}

    def walk(node: tuple, bits: np.ndarray) -> None:
        if len(node) == 2:
            n, i = node
            for k in range(n):
                f = int(groups[n][2][i, k])
                part = tables[n][i, k][bits]
                found[f] = found[f] + part if f in found else part
            return
        ok = (codes >> (d + len(splits))) & 1 == 1
        splits.append(node)
        walk(node[5], child_bits(bits, ok, node[3], node[4]))
        walk(node[6], child_bits(bits, ~ok, node[3], node[4]))

    walk(branch, codes & ((1 << d) - 1))
    return splits, list(found), np.array(list(found.values()))


def ensemble_contributions(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    part = np.empty(len(x))
    for root, groups in trees:
        tabulated = max(groups) <= TABLE_BITS
        kind = np.uint8 if max(groups) <= 8 else np.int64
        tables = {d: np.ascontiguousarray(pattern_values(v, z, bits_of(np.arange(1 << d), d)).transpose(0, 2, 1))
                  for d, (v, z, _) in groups.items() if 0 < d <= TABLE_BITS}
        stack = [(root, np.zeros(len(x), kind), 0)]
        while stack:
            node, bits, way = stack.pop()
            if tabulated and len(node) > 2 and splits_below(node) <= BRANCH_SPLITS:
                splits, features, table = branch_table(node, way, tables, groups)
                code = bits.astype(np.intp)
                for s, split in enumerate(splits):
                    code |= goes_left(columns, split).astype(np.intp) << (way + s)
                for f, row in zip(features, table):
                    phi[f] += row.take(code, out=part, mode="clip")
                continue
            if len(node) == 2:
                d, i = node
                values, shares, features = groups[d]
                if d > TABLE_BITS:
                    seen, bits = np.unique(bits, return_inverse=True)
                    table = pattern_values(values[i:i + 1], shares[i:i + 1], bits_of(seen, d))[0].T
                elif d:
                    table = tables[d][i]
                at = bits.astype(np.intp)
                for k in range(d):
                    phi[features[i, k]] += table[k].take(at, out=part, mode="clip")
                continue
            goes = goes_left(columns, node)
            for child, ok in ((node[5], goes), (node[6], ~goes)):
                stack.append((child, child_bits(bits, ok, node[3], node[4]), way + node[4]))
    return phi.T
