"""Trees grown on histograms of binned features, for boosting and for forests.

Features are cut once into at most 256 bins. Rows then travel as blocks of bytes,
kept in memory or on local disk between the many short jobs of a fit. A node with
many rows is split by a histogram of its rows' statistics by feature and bin,
summed over all tasks; of two siblings only the smaller is counted, the other is
the rest of their parent. A node whose rows fit in a task is dealt there and
grown to its end, with the same statistics and the same choice of splits. All
trees of a boosting round, or of a forest, grow in the same jobs. A forest's dealt
nodes are stored by the tasks that grow them; only a small forest is told whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numeric import col
from tabscope.session import shared_root, stage_table

BINS = 256
#: A node with at most so many rows is finished in one task.
LOCAL_ROWS = 20_000
#: So many times that where boosting or a forest grows it, but at most so many cells of bins.
BOOSTED, FOREST, LOCAL_CELLS = 25, 25, 1 << 25
#: A node with at most so many rows, 256 at most, sorts them; their histogram would be mostly empty.
FEW_ROWS = 256
#: From so many rows on features are counted one by one, as all cells of all rows together leave the processor's caches.
MANY_ROWS = 2_000
#: Rows of dealt nodes that a task grows side by side, and numbers that their small nodes' sums take at once.
SIDE_ROWS, SIDE_CELLS = 100_000, 1 << 16
#: Numbers in the histograms of one job; a larger frontier takes several.
JOB_CELLS = 1 << 24
#: Aggregates over more columns become methods that the JVM doesn't compile.
CUT_COLUMNS = 8
#: Rounds after which the rows' scores are stored.
STORED_ROUNDS = 20
BATCH_ROWS = 20_000
#: A forest of more nodes stays in storage, and rows are dealt to its parts.
TOLD_NODES = 500_000
#: Rows of a block that a stored forest scores, and about as many as meet a part of it in one task.
SCORED_ROWS, SHARED_ROWS = 2_000, 200_000


@dataclass(frozen=True)
class Rule:
    """How nodes are split. Without ``classes`` statistics are gradient and hessian, with them weights by class (Gini)."""

    classes: int = 0
    max_depth: int | None = None
    max_leaves: int | None = None
    #: Features that a node looks at; all if None. More are drawn where none of them splits it.
    tried: int | None = None
    l2: float = 0.0
    least_rows: int = 1
    least_hessian: float = 0.0
    seed: int = 0

    @property
    def width(self) -> int:
        return self.classes or 2

    def local_rows(self, n_features: int) -> int:
        times = FOREST if self.classes else BOOSTED
        return min(times * LOCAL_ROWS, max(LOCAL_ROWS, LOCAL_CELLS // max(1, n_features)))

    def strength(self, stats: np.ndarray, axis: int = -1) -> np.ndarray:
        """What a node contributes; a split gains its children's less the node's own. ``axis``: of the classes."""
        if self.classes:
            total = stats.sum(axis=axis)
            return (stats**2).sum(axis=axis) / np.where(total > 0, total, 1.0)
        low = stats[..., 1] + self.l2
        return stats[..., 0] ** 2 / np.where(low > 0, low, 1.0)

    def features(self, tree: int, path: int, n: int) -> np.ndarray:
        """All features in the order in which this node tries them."""
        if self.tried is None:
            return np.arange(n)
        words = [(path >> k) & 0xFFFFFFFF for k in range(0, path.bit_length(), 32)]
        return np.random.default_rng([self.seed, tree, *words]).permutation(n)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    left: np.ndarray
    left_rows: int


@dataclass
class Tree:
    """A tree in the making. A node is ``known`` once its best split, or that it has none, has been found."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    stats: list[np.ndarray | None] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    #: 1 for the root, then one binary digit for each step.
    path: list[int] = field(default_factory=list)
    known: list[bool] = field(default_factory=list)
    best: list[Split | None] = field(default_factory=list)

    def add(self, stats: np.ndarray | None, rows: int, depth: int, path: int) -> int:
        for values, value in (
            (self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.stats, stats), (self.rows, rows),
            (self.depth, depth), (self.path, path), (self.known, False), (self.best, None),
        ):
            values.append(value)
        return len(self.rows) - 1

    def split(self, node: int) -> tuple[int, int]:
        s = self.best[node]
        self.feature[node], self.cut[node] = s.feature, s.cut
        deeper, path = self.depth[node] + 1, 2 * self.path[node]
        self.left[node] = self.add(s.left, s.left_rows, deeper, path)
        self.right[node] = self.add(self.stats[node] - s.left, self.rows[node] - s.left_rows, deeper, path + 1)
        return self.left[node], self.right[node]

    def unknown(self, rule: Rule) -> list[int]:
        """Leaves that still have to be looked at."""
        return [k for k, seen in enumerate(self.known) if not seen and not self.ended(k, rule)]

    def ended(self, node: int, rule: Rule) -> bool:
        if self.stats[node] is None:
            return False
        if rule.max_depth is not None and self.depth[node] >= rule.max_depth:
            return True
        return self.rows[node] < 2 * rule.least_rows or (rule.classes > 0 and np.count_nonzero(self.stats[node]) < 2)

    def by_gain(self, rule: Rule, few: int) -> tuple[list[int], list[int]]:
        """Nodes that growth by largest gain splits, and up to ``few`` of them whose children don't exist yet."""
        chosen, lacking = [], []
        queue = [(-self.best[0].gain, 0)] if self.best[0] else []
        while queue and (rule.max_leaves is None or len(chosen) < rule.max_leaves - 1):
            _, node = heapq.heappop(queue)
            chosen.append(node)
            if self.feature[node] < 0:
                lacking.append(node)
                if len(lacking) >= few:
                    break
                continue
            for child in (self.left[node], self.right[node]):
                if self.best[child]:
                    heapq.heappush(queue, (-self.best[child].gain, child))
        return chosen, lacking

    def graft(self, node: int, other: Tree) -> None:
        """Puts a tree grown elsewhere in the place of a leaf."""
        shift = len(self.rows) - 1
        place = lambda k: node if k == 0 else k + shift
        for k in range(1, len(other.rows)):
            self.add(None, 0, 0, 0)
        for k in range(len(other.rows)):
            at = place(k)
            for name in ("feature", "cut", "stats", "rows", "depth", "path", "known", "best"):
                getattr(self, name)[at] = getattr(other, name)[k]
            for name in ("left", "right"):
                child = getattr(other, name)[k]
                getattr(self, name)[at] = place(child) if child >= 0 else -1

    def shape(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, dtype=np.int32) for x in (self.feature, self.cut, self.left, self.right))


def route(shape: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left, right = shape
    at, live = np.zeros(len(bins), dtype=np.int32), np.arange(len(bins))
    while len(live):
        live = live[feature[at[live]] >= 0]
        node = at[live]
        at[live] = np.where(bins[live, feature[node]] <= cut[node], left[node], right[node])
    return at


def histogram(bins: np.ndarray, stats: np.ndarray, rule: Rule) -> np.ndarray:
    """Sums of the statistics and the number of rows by feature and bin: ``[features, BINS, width + 1]``.

    ``stats`` has a row per statistic: gradient and hessian, or class and weight.
    """
    n, m = bins.shape
    if not rule.classes and n >= MANY_ROWS:
        by_feature = np.empty((m, BINS, 3))
        for own, column in zip(by_feature, np.ascontiguousarray(bins.T), strict=True):
            cell = column.astype(np.intp)
            for k in range(2):
                own[:, k] = np.bincount(cell, stats[k], minlength=BINS)
            own[:, 2] = np.bincount(cell, minlength=BINS)
        return by_feature
    cell = (bins + np.arange(m) * BINS).ravel()
    out = np.empty((m * BINS, rule.width + 1))
    if rule.classes:
        at = cell * rule.classes + np.repeat(stats[0].astype(np.int64), m)
        sums = np.bincount(at, np.repeat(stats[1], m), minlength=m * BINS * rule.classes)
        out[:, :-1] = sums.reshape(-1, rule.classes)
    else:
        for k in range(2):
            out[:, k] = np.bincount(cell, np.repeat(stats[k], m), minlength=m * BINS)
    out[:, -1] = np.bincount(cell, minlength=m * BINS)
    return out.reshape(m, BINS, rule.width + 1)


def best_split(hist: np.ndarray, features: np.ndarray, rule: Rule) -> Split | None:
    """The split of the largest gain; of equal ones that of the lowest feature, then bin. None if nothing is gained."""
    low = np.cumsum(hist, axis=1)
    whole, low = low[:, -1:], low[:, :-1]
    gain = gains(low[..., :-1], low[..., -1], whole[..., :-1], whole[..., -1], rule)
    at = first_of_most(gain, features)
    if at is None:
        return None
    f, b = at
    return Split(float(gain[f, b]), int(features[f]), b, low[f, b, :-1].copy(), int(round(low[f, b, -1])))


def gains(low: np.ndarray, n_low: np.ndarray, whole: np.ndarray, n: np.ndarray, rule: Rule) -> np.ndarray:
    """Gain of each split by what lies on its low side; minus infinity where a side is too small."""
    high = whole - low
    fine = (n_low >= rule.least_rows) & (n - n_low >= rule.least_rows)
    if not rule.classes:
        fine = fine & (low[..., 1] >= rule.least_hessian) & (high[..., 1] >= rule.least_hessian)
    return np.where(fine, rule.strength(low) + rule.strength(high) - rule.strength(whole), -np.inf)


def first_of_most(gain: np.ndarray, features: np.ndarray) -> tuple[int, int] | None:
    """Place of the largest gain in ``[feature, cut]``. Sums of equal rows differ in their last digits by the order of summing."""
    most = gain.max(initial=-np.inf)
    if not most > 1e-9:
        return None
    near = np.argwhere(gain >= most - 1e-9 * max(1.0, most)).tolist()
    return tuple(near[0] if len(near) == 1 else min(near, key=lambda x: (features[x[0]], x[1])))


def best_split_of_few(bins: np.ndarray, stats: np.ndarray, features: np.ndarray, rule: Rule) -> Split | None:
    """The same split for a node of few rows, from its rows in the order of each feature."""
    n, m = bins.shape
    order = np.argsort(bins, axis=0, kind="stable").T
    values = np.take_along_axis(bins.T, order, axis=1)
    if rule.classes:
        own = np.zeros((n, rule.classes))
        own[np.arange(n), stats[0].astype(np.int64)] = stats[1]
    else:
        own = stats.T
    low = np.cumsum(own[order], axis=1)
    whole, low = low[:, -1:], low[:, :-1]
    gain = gains(low, np.arange(1, n), whole, n, rule)
    gain[values[:, :-1] == values[:, 1:]] = -np.inf
    at = first_of_most(gain, features)
    if at is None:
        return None
    f, k = at
    return Split(float(gain[f, k]), int(features[f]), int(values[f, k]), low[f, k].copy(), k + 1)


def sums(stats: np.ndarray, rule: Rule) -> np.ndarray:
    if rule.classes:
        return np.bincount(stats[0].astype(np.int64), stats[1], minlength=rule.classes)
    return stats.sum(axis=1)


def taken(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows of ``bins``; where each feature lies together, also in the result, as histograms read feature by feature."""
    if len(rows) == len(bins):
        return bins
    return np.take(bins.T, rows, axis=1).T if bins.flags.f_contiguous else bins[rows]


def grow_here(bins: np.ndarray, stats: np.ndarray, rule: Rule, tree: int, path: int, depth: int) -> Tree:
    """The whole subtree of some rows; with a bound of leaves, as much of it as growth by largest gain could take."""
    n_features = bins.shape[1]
    out = Tree()
    out.add(sums(stats, rule), bins.shape[0], depth, path)
    queue: list[tuple[float, int, np.ndarray, np.ndarray | None]] = []

    def look(node: int, rows: np.ndarray, hist: np.ndarray | None) -> None:
        out.known[node] = True
        if out.ended(node, rule):
            return
        order = rule.features(tree, out.path[node], n_features)
        step = rule.tried or n_features
        for at in range(0, n_features, step):
            some = np.sort(order[at : at + step])
            if len(rows) <= FEW_ROWS:
                split = best_split_of_few(bins[np.ix_(rows, some)], stats[:, rows], some, rule)
            else:
                if hist is None or step < n_features:
                    own = taken(bins, rows) if step == n_features else bins[np.ix_(rows, some)]
                    hist = histogram(own, stats[:, rows], rule)
                split = best_split(hist, some, rule)
            if split:
                out.best[node] = split
                heapq.heappush(queue, (-split.gain, node, rows, hist if step == n_features else None))
                return

    look(0, np.arange(len(bins)), None)
    made = 0
    while queue and (rule.max_leaves is None or made < rule.max_leaves - 1):
        _, node, rows, hist = heapq.heappop(queue)
        children, made = out.split(node), made + 1
        goes = bins[rows, out.feature[node]] <= out.cut[node]
        parts = (rows[goes], rows[~goes])
        small = int(len(parts[1]) < len(parts[0]))
        own: list[np.ndarray | None] = [None, None]
        if hist is not None and len(parts[1 - small]) > FEW_ROWS and not out.ended(children[1 - small], rule):
            own[small] = histogram(taken(bins, parts[small]), stats[:, parts[small]], rule)
            own[1 - small] = hist - own[small]
        for child, part, h in zip(children, parts, own, strict=True):
            look(child, part, h)
    return out


@dataclass
class Level:
    """Nodes of one depth of several subtrees: their subtree, place in it, path, rows and statistics, and how they were split."""

    item: np.ndarray
    place: np.ndarray
    path: list[int]
    count: np.ndarray
    stats: np.ndarray
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.item)
        self.feature, self.left = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        self.cut, self.gain, self.low = np.zeros(n), np.zeros(n), np.zeros_like(self.stats)


def splits_of_few(bins: np.ndarray, stats: np.ndarray, rows: list[np.ndarray], some: np.ndarray, rule: Rule) -> list[Split | None]:
    """:func:`best_split_of_few` of several nodes at once, each with its own rows and features; sums of a node are added in the same order."""
    count = np.array([len(r) for r in rows])
    most, m = int(count.max()), some.shape[1]
    inside = np.arange(most) < count[:, None]
    at = np.zeros(inside.shape, dtype=np.int64)
    at[inside] = np.concatenate(rows)
    # A lane for each node and feature, sorted by bin and place; places beyond a node's rows come last, with a weight of nothing.
    bin_ = np.where(inside[:, None, :], bins[at[:, None, :], some[:, :, None]].astype(np.int32), np.int32(BINS))
    lanes = np.sort(((bin_ << 8) + np.arange(most, dtype=np.int32)).reshape(-1, most), axis=1).T
    place = np.repeat(np.arange(len(rows)) * most, m) + (lanes & 255)
    values = np.ascontiguousarray(lanes >> 8)
    label, weight = stats[0][at].ravel()[place], np.where(inside, stats[1][at], 0.0).ravel()[place]
    # Lanes last, as steps over short axes take many times as long.
    low = np.where(label[:, None, :] == np.arange(rule.classes)[:, None], weight[:, None, :], 0.0)
    for k in range(1, most):
        low[k] += low[k - 1]
    whole, low = low[-1:], low[:-1]
    n_low, n = np.arange(1, most)[:, None], np.repeat(count, m)
    fine = (values[:-1] != values[1:]) & (values[1:] != BINS) & (n_low >= rule.least_rows) & (n - n_low >= rule.least_rows)
    gain = np.where(fine, rule.strength(low, 1) + rule.strength(whole - low, 1) - rule.strength(whole, 1), -np.inf)
    gain = gain.reshape(most - 1, len(rows), m).transpose(1, 2, 0).reshape(len(rows), -1)
    peak = gain.max(axis=1, initial=-np.inf)
    # Features ascend, so the first of those near is the one of the lowest feature, then cut.
    first = (gain >= (peak - 1e-9 * np.maximum(1.0, peak))[:, None]).argmax(axis=1)
    out: list[Split | None] = [None] * len(rows)
    for i in np.flatnonzero(peak > 1e-9).tolist():
        f, k = divmod(int(first[i]), most - 1)
        lane = i * m + f
        out[i] = Split(float(gain[i, first[i]]), int(some[i, f]), int(values[k, lane]), low[k, :, lane].copy(), k + 1)
    return out


def split_level(level: Level, live: list[int], rows: list[np.ndarray], bins: np.ndarray, stats: np.ndarray, trees: list[int], rule: Rule) -> None:
    """The best splits of the nodes ``live``, small nodes of about as many rows together."""
    n_features, step = bins.shape[1], rule.tried
    order = {k: rule.features(trees[level.item[k]], level.path[k], n_features) for k in live}

    def keep(k: int, split: Split | None) -> None:
        if split:
            level.feature[k], level.cut[k], level.gain[k], level.low[k] = split.feature, split.cut, split.gain, split.left
            del order[k]

    for first in range(0, n_features, step):
        groups: dict[int, list[int]] = {}
        for k in list(order):
            if len(rows[k]) <= FEW_ROWS:
                groups.setdefault((len(rows[k]) - 1).bit_length(), []).append(k)
            else:
                some = np.sort(order[k][first : first + step])
                keep(k, best_split(histogram(bins[np.ix_(rows[k], some)], stats[:, rows[k]], rule), some, rule))
        for bits, nodes in groups.items():
            few = max(1, SIDE_CELLS // (step * rule.classes << bits))
            for at in range(0, len(nodes), few):
                now = nodes[at : at + few]
                some = np.sort(np.stack([order[k][first : first + step] for k in now]), axis=1)
                for k, split in zip(now, splits_of_few(bins, stats, [rows[k] for k in now], some, rule), strict=True):
                    keep(k, split)


def grow_side_by_side(items: list[tuple], rule: Rule) -> list[dict[str, np.ndarray]]:
    """The subtrees of several dealt nodes of a forest as node arrays, level by level; an item is (bins, stats, tree, path, depth).

    They are those of :func:`grow_here`, one at a time; nodes of few rows, which are
    almost all, share their steps.
    """
    if rule.tried is None or rule.tried >= items[0][0].shape[1]:
        # Siblings' histograms add up to their parent's, which one subtree at a time makes use of.
        return [node_arrays(grow_here(bins, stats, rule, *place), rule) for bins, stats, *place in items]
    ends = np.cumsum([len(i[0]) for i in items])
    bins, stats = np.concatenate([i[0] for i in items]), np.concatenate([i[1] for i in items], axis=1)
    trees, depth = [i[2] for i in items], np.array([i[4] for i in items])
    level = Level(
        np.arange(len(items)), np.zeros(len(items), dtype=np.int32), [i[3] for i in items],
        np.array([len(i[0]) for i in items]), np.stack([sums(i[1], rule) for i in items]),
    )
    rows = [np.arange(e - len(i[0]), e) for e, i in zip(ends.tolist(), items, strict=True)]
    sizes, levels = np.ones(len(items), dtype=np.int64), []
    while len(level.item):
        levels.append(level)
        open_ = (level.count >= 2 * rule.least_rows) & (np.count_nonzero(level.stats, axis=1) >= 2)
        if rule.max_depth is not None:
            open_ &= depth[level.item] < rule.max_depth
        split_level(level, np.flatnonzero(open_).tolist(), rows, bins, stats, trees, rule)
        split = np.flatnonzero(level.feature >= 0)
        item = np.repeat(level.item[split], 2)
        # Children stand in the order of their parents, so a subtree's places go on from level to level.
        begins = np.searchsorted(item, item, side="left")
        place = (sizes[item] + np.arange(len(item)) - begins).astype(np.int32)
        level.left[split] = place[::2]
        sizes += np.bincount(item, minlength=len(items))
        parts, path = [], []
        for k in split.tolist():
            goes = bins[rows[k], level.feature[k]] <= level.cut[k]
            parts += [rows[k][goes], rows[k][~goes]]
            path += [2 * level.path[k], 2 * level.path[k] + 1]
        low = level.low[split]
        both = np.stack([low, level.stats[split] - low], axis=1).reshape(-1, rule.classes)
        rows, depth = parts, depth + 1
        level = Level(item, place, path, np.array([len(p) for p in parts], dtype=np.int64), both)
    item = np.concatenate([x.item for x in levels])
    by_item = np.argsort(item, kind="stable")
    left = np.concatenate([x.left for x in levels])
    total = np.concatenate([x.stats for x in levels])
    all_ = {
        "feature": np.concatenate([x.feature for x in levels]),
        "threshold": np.concatenate([x.cut for x in levels]),
        "left": left,
        "right": np.where(left >= 0, left + 1, -1),
        "values": total,
        "gains": np.concatenate([x.gain for x in levels]),
    }
    cuts = np.cumsum(sizes)[:-1]
    each = {name: np.split(v[by_item], cuts) for name, v in all_.items()}
    return [{name: v[k] for name, v in each.items()} for k in range(len(items))]


def node_arrays(tree: Tree, rule: Rule) -> dict[str, np.ndarray]:
    """A grown subtree as node arrays, with places among a feature's cuts for thresholds and statistics for values."""
    n_features = max(tree.feature) + 1
    flat = flattened([tree], rule, [np.arange(BINS, dtype=np.float64)] * n_features, lambda s: s, rule.classes)
    return {name: getattr(flat, name) for name in PART}


@dataclass(frozen=True)
class Block:
    """Some rows: bins, class codes, weights and, for boosting, a score per class."""

    name: int
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    scores: np.ndarray | None = None


@dataclass(frozen=True)
class Held:
    """Histograms of the nodes that were counted last."""

    sums: RDD | None = None
    keys: frozenset = frozenset()

    def drop(self) -> None:
        if self.sums is not None:
            self.sums.unpersist()


#: Statistics of a block's rows for one tree, and the rows that take part (None: all).
Sample = Callable[[Block, int], tuple[np.ndarray, np.ndarray | None]]
#: Keeps what grows from dealt nodes, which comes as ((tree, node), node arrays).
Store = Callable[[RDD], None]


def grow(blocks: RDD, keys: list[int], rule: Rule, n_rows: int, n_features: int, sample: Sample, store: Store | None = None) -> list[Tree]:
    """One tree per key, all of them in the same jobs; ``n_rows`` are those that a tree may see.

    With ``store`` dealt nodes remain leaves here, and what grows from them goes there.
    """
    trees = {k: Tree() for k in keys}
    for t in trees.values():
        t.add(None, n_rows, 0, 1)
    held = Held()
    attempts: dict[tuple[int, int], int] = {}
    few = 4 if rule.max_leaves else 1 << 30
    most = rule.local_rows(n_features)
    while True:
        asked = [(k, node) for k, t in trees.items() for node in t.unknown(rule)]
        large = [a for a in asked if trees[a[0]].rows[a[1]] > most]
        small = [a for a in asked if trees[a[0]].rows[a[1]] <= most]
        if large:
            held = count_large(blocks, trees, large, rule, n_features, sample, held, attempts)
        if small and (rule.max_leaves or not large):
            deal_small(blocks, trees, small, rule, sample, store)
        if asked:
            # Nodes to be looked at once more, with other features, come round again.
            if any(not trees[k].known[node] for k, node in large):
                continue
        made = 0
        for t in trees.values():
            for node in t.by_gain(rule, few)[1]:
                t.split(node)
                made += 1
        left = any(t.unknown(rule) for t in trees.values())
        if not made and not left:
            break
    held.drop()
    return [trees[k] for k in keys]


def rows_by_node(shape: tuple[np.ndarray, ...], nodes: list[int], bins: np.ndarray, part: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    at = route(shape, bins if part is None else bins[part])
    for node in nodes:
        rows = np.flatnonzero(at == node)
        if len(rows):
            yield node, rows if part is None else part[rows]


def by_tree(nodes: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for tree, node in nodes:
        out.setdefault(tree, []).append(node)
    return out


def even_tasks(rows: dict[tuple[int, int], int], tasks: int) -> dict[tuple[int, int], int]:
    """A task for each node, so that tasks get about as many rows: the largest nodes first, each to the task with the fewest."""
    loads = [(0, t) for t in range(tasks)]
    out = {}
    for key in sorted(rows, key=lambda a: (-rows[a], a)):
        load, out[key] = loads[0]
        # Nodes without a known row cost a task something too.
        heapq.heapreplace(loads, (load + max(1, rows[key]), out[key]))
    return out


def deal_small(blocks: RDD, trees: dict[int, Tree], asked: list[tuple[int, int]], rule: Rule, sample: Sample, store: Store | None) -> None:
    """Rows of each node to one task, which grows the node to its end."""
    wanted = by_tree(asked)
    shapes = {k: trees[k].shape() for k in wanted}
    places = {(k, node): (trees[k].path[node], trees[k].depth[node]) for k, node in asked}

    def deal(block: Block) -> Iterator[tuple[tuple[int, int], tuple]]:
        for k, nodes in wanted.items():
            stats, part = sample(block, k)
            for node, rows in rows_by_node(shapes[k], nodes, block.bins, part):
                yield (k, node), (block.name, block.bins[rows], stats[:, rows])

    def whole(item: tuple) -> tuple[tuple[int, int], tuple]:
        key, parts = item
        parts = sorted(parts, key=lambda p: p[0])
        bins, stats = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts], axis=1)
        return key, (bins, stats, key[0], *places[key])

    def finish(item: tuple) -> tuple[tuple[int, int], Tree]:
        key, (bins, stats, *place) = whole(item)
        return key, grow_here(bins, stats, rule, *place)

    def finish_several(items: Iterable[tuple]) -> Iterator[tuple[tuple[int, int], dict[str, np.ndarray]]]:
        now, n_rows = [], 0
        for item in map(whole, items):
            now.append(item)
            n_rows += len(item[1][0])
            if n_rows >= SIDE_ROWS:
                yield from zip([k for k, _ in now], grow_side_by_side([i for _, i in now], rule), strict=True)
                now, n_rows = [], 0
        if now:
            yield from zip([k for k, _ in now], grow_side_by_side([i for _, i in now], rule), strict=True)

    tasks = min(len(asked), 4 * blocks.context.defaultParallelism)
    dealt = even_tasks({(k, node): trees[k].rows[node] for k, node in asked}, tasks)
    grouped = blocks.flatMap(deal).groupByKey(tasks, dealt.__getitem__)
    if store is not None:
        store(grouped.mapPartitions(finish_several))
    else:
        for (k, node), grown in grouped.map(finish).collect():
            trees[k].graft(node, grown)
    for k, node in asked:
        if trees[k].stats[node] is None:  # a sample without rows
            trees[k].stats[node], trees[k].rows[node] = np.zeros(rule.width), 0
        trees[k].known[node] = True


def count_large(
    blocks: RDD, trees: dict[int, Tree], asked: list[tuple[int, int]], rule: Rule, n_features: int, sample: Sample,
    held: Held, attempts: dict[tuple[int, int], int],
) -> Held:
    """The best splits of nodes by histograms over all tasks; returns those histograms that serve the next level."""
    step = rule.tried or n_features
    whole = step == n_features
    some = {}
    for k, node in asked:
        at = attempts.get((k, node), 0) * step
        some[k, node] = np.sort(rule.features(k, trees[k].path[node], n_features)[at : at + step])
    # A node is counted itself, or its smaller sibling is and it gets the rest of their parent.
    parent = {
        (k, c): node for k, t in trees.items() for node, f in enumerate(t.feature) if f >= 0 for c in (t.left[node], t.right[node])
    }
    inside, counted, rest = set(asked), [], {}
    for k, node in asked:
        up = parent.get((k, node))
        if (k, up) not in held.keys:
            counted.append((k, node))
        else:
            other = trees[k].left[up] + trees[k].right[up] - node
            larger = (trees[k].rows[node], node) > (trees[k].rows[other], other)
            if larger and (k, other) in inside:
                rest[k, up] = (other, node)
            else:
                counted.append((k, node))
    cells = step * BINS * (rule.width + 1)
    per_job = max(1, JOB_CELLS // cells)
    kept = []
    for first in range(0, len(counted), per_job):
        now = counted[first : first + per_job]
        wanted = by_tree(now)
        shapes = {k: trees[k].shape() for k in wanted}
        chosen = {a: some[a] for a in now}

        def count(part: Iterable[Block], wanted=wanted, shapes=shapes, chosen=chosen) -> Iterator[tuple]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for block in part:
                for k, nodes in wanted.items():
                    stats, own = sample(block, k)
                    for node, rows in rows_by_node(shapes[k], nodes, block.bins, own):
                        hist = histogram(block.bins[rows][:, chosen[k, node]], stats[:, rows], rule)
                        if (k, node) in total:
                            total[k, node] += hist
                        else:
                            total[k, node] = hist
            yield from total.items()

        tasks = min(len(now), 4 * blocks.context.defaultParallelism)
        kept.append(blocks.mapPartitions(count).reduceByKey(np.add, tasks))
    hists = kept[0] if len(kept) == 1 else blocks.context.union(kept)
    if rest:
        up = held.sums.flatMap(lambda x: [((x[0][0], rest[x[0]][0]), (rest[x[0]][1], x[1]))] if x[0] in rest else [])
        both = hists.leftOuterJoin(up, hists.getNumPartitions())

        def siblings(item: tuple) -> Iterator[tuple]:
            key, (own, above) = item
            yield key, own
            if above:
                yield (key[0], above[0]), above[1] - own

        hists = both.flatMap(siblings)
    hists = hists.persist(StorageLevel.MEMORY_AND_DISK)
    last = {a: attempts.get(a, 0) + 1 >= math.ceil(n_features / step) for a in asked}

    def judge(item: tuple) -> tuple:
        key, hist = item
        flat = hist[0].sum(axis=0)
        return key, flat[:-1], int(round(flat[-1])), best_split(hist, some[key], rule)

    found = {key: rest for key, *rest in hists.map(judge).collect()}
    for k, node in asked:
        stats, rows, split = found.get((k, node), (np.zeros(rule.width), 0, None))
        t = trees[k]
        t.stats[node], t.rows[node], t.best[node] = stats, rows, split
        t.known[node] = split is not None or last[k, node] or t.ended(node, rule)
        attempts[k, node] = attempts.get((k, node), 0) + 1
    held.drop()
    # Histograms of some features only don't add up to their parent's.
    out = Held(hists, frozenset(asked) if whole else frozenset())
    if not whole:
        out.drop()
    return out


@dataclass(frozen=True)
class FlatTrees:
    """Fitted trees as arrays of nodes; ``values`` has a column, or one per class for a forest.

    Boosted trees stand by round, then class.
    """

    n_classes: int
    boosted: bool
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    gains: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.roots, self.feature, self.threshold, self.left, self.right, self.values))

    def depth(self) -> int:
        level, n = self.roots, 0
        while len(level := level[self.feature[level] >= 0]):
            level, n = np.concatenate([self.left[level], self.right[level]]), n + 1
        return n

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, all trees advancing together."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            value = np.take_along_axis(x, np.maximum(f, 0), axis=1)
            at = np.where(inner, np.where(value <= self.threshold[at], self.left[at], self.right[at]), at)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.n_classes))
        # A step holds a node per row and tree.
        step = max(1, (1 << 22) // max(1, len(self.roots)))
        for first in range(0, len(x), step):
            part = slice(first, first + step)
            at = self.leaves(x[part])
            if self.boosted:
                margins = self.values[at, 0].reshape(len(at), -1, self.n_classes).sum(axis=1)
                out[part] = softmax(margins)
            else:
                total = np.zeros((len(at), self.n_classes))
                for tree in range(at.shape[1]):
                    total += self.values[at[:, tree]]
                out[part] = total / at.shape[1]
        return out

    def importances(self, n_features: int) -> np.ndarray:
        """Gains by feature: of all trees together if boosted, else the mean of the trees' shares. Zeros without a split."""
        each = self.gains_by_tree(n_features)
        return mean_shares(each.sum(axis=0, keepdims=True) if self.boosted else each)

    def gains_by_tree(self, n_features: int) -> np.ndarray:
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        inner = self.feature >= 0
        cell = tree[inner] * n_features + self.feature[inner]
        return np.bincount(cell, self.gains[inner], minlength=len(self.roots) * n_features).reshape(-1, n_features).astype(np.float64)


def mean_shares(gains: np.ndarray) -> np.ndarray:
    """The mean of the rows' shares by feature; zeros where nothing was gained."""
    sums = gains.sum(axis=1, keepdims=True)
    shares = gains / np.where(sums > 0, sums, 1.0)
    total = shares.sum()
    return shares.sum(axis=0) / (total if total > 0 else 1.0)


#: Node arrays of a stored part, with their types.
PART = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "values": np.float64, "gains": np.float64}
PART_SCHEMA = "tree int, node int, n long, " + ", ".join(f"`{name}` binary" for name in PART)


def unpacked(part: dict, n_classes: int) -> dict[str, np.ndarray]:
    own = {name: np.frombuffer(part[name], dtype=kind) for name, kind in PART.items()}
    return own | {"values": own["values"].reshape(-1, n_classes)}


@dataclass(frozen=True)
class StoredForest:
    """A forest too large to tell: the tops of its trees, and a table of what was grown from dealt nodes.

    Thresholds are places among a feature's cuts. ``stub`` has, for each node of
    the tops, the number under which ``parts`` continues it, or -1.
    """

    tops: FlatTrees
    stub: np.ndarray
    cuts: list[np.ndarray]
    parts: DataFrame
    #: Gains by tree and feature, of tops and parts.
    gains: np.ndarray

    def importances(self, n_features: int) -> np.ndarray:
        return mean_shares(self.gains)

    def scored(self, df: DataFrame, features: Column, name: str) -> DataFrame:
        """``df`` with the probabilities as ``name``: each row goes to the one part per tree that it falls into."""
        if df.isStreaming:
            raise ValueError("a stored forest scores tables; score a stream by its micro-batches")
        rows = stage_table(df.withColumn("#row", F.monotonically_increasing_id()), "forest-rows")
        told = df.sparkSession.sparkContext.broadcast((self.tops, self.stub, self.cuts))
        n_classes, n_trees, step = self.tops.n_classes, len(self.tops.roots), SCORED_ROWS
        names = ["tree", "node", "name", "rows", "cells"]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, stub, cuts = told.value
            for batch in batches:
                ids = np.asarray(batch.column(0), dtype=np.int64)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for first in range(0, len(ids), step):
                    own = ids[first : first + step]
                    bins = bins_of(x[first : first + step], cuts)
                    at = tops.leaves(bins)
                    # What the tops decide, under tree -1 with the rows' ids.
                    out = [(-1, -1, int(own[0]), own.tobytes(), sum(tops.values[leaf] for leaf in at.T).tobytes())]
                    for tree in range(n_trees):
                        nodes = stub[at[:, tree]]
                        for node in np.unique(nodes[nodes >= 0]).tolist():
                            some = np.flatnonzero(nodes == node)
                            out.append((tree, node, int(own[0]), some.astype(np.int32).tobytes(), bins[some].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        schema = "tree int, node int, name long, rows binary, cells binary"
        dealt = stage_table(rows.select("#row", features.alias("x")).mapInArrow(deal, schema), "forest-dealt")
        shared = max(1, math.ceil(rows.count() / SHARED_ROWS))
        own = dealt.filter("tree >= 0").withColumn("shared", F.pmod(F.xxhash64("name"), F.lit(shared)).cast("long"))
        parts = self.parts.withColumn("shared", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shared - 1).cast("long"))))

        def follow(pieces: pa.Table, part: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if pieces.num_rows:
                p = unpacked(part.slice(0, 1).to_pylist()[0], n_classes)
                tree = FlatTrees(n_classes, False, np.zeros(1, dtype=np.int32), **p)
                for piece in pieces.select(names).to_pylist():
                    some = np.frombuffer(piece["rows"], dtype=np.int32)
                    bins = np.frombuffer(piece["cells"], dtype=np.uint8).reshape(len(some), -1)
                    out.append((piece["tree"], piece["node"], piece["name"], piece["rows"], tree.values[tree.leaves(bins)[:, 0]].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def add(pieces: pa.Table) -> pa.Table:
            ids, total = None, None
            # Tree by tree, so that sums have the same last digits however rows were dealt.
            for piece in sorted(pieces.select(names).to_pylist(), key=lambda r: (r["tree"], r["node"])):
                values = np.frombuffer(piece["cells"]).reshape(-1, n_classes)
                if piece["tree"] < 0:
                    ids, total = np.frombuffer(piece["rows"], dtype=np.int64), values.copy()
                else:
                    total[np.frombuffer(piece["rows"], dtype=np.int32)] += values
            ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n_classes)
            return pa.table([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array((total / n_trees).ravel()))], ["row", "p"])

        key = ("tree", "node", "shared")
        followed = own.groupBy(*key).cogroup(parts.groupBy(*key)).applyInArrow(follow, schema)
        found = dealt.filter("tree < 0").unionByName(followed).groupBy("name").applyInArrow(add, "row long, p array<double>")
        both = rows.join(found, F.col("#row") == F.col("row"))
        return both.select(*[col(c) for c in df.columns], F.col("p").alias(name))


def whole_forest(tops: FlatTrees, stub: np.ndarray, parts: list[dict], cuts: list[np.ndarray]) -> FlatTrees:
    """Tops and the parts of a small forest as one set of node arrays."""
    by_place = {(p["tree"], p["node"]): unpacked(p, tops.n_classes) for p in parts}
    names, out, roots, size = tuple(PART), {k: [] for k in PART}, [], 0
    ends = [*tops.roots[1:].tolist(), len(tops.feature)]
    for tree, (first, end) in enumerate(zip(tops.roots.tolist(), ends, strict=True)):
        roots.append(size)
        own = {k: getattr(tops, k)[first:end].copy() for k in names}
        for k in ("left", "right"):
            own[k] = np.where(own[k] >= 0, own[k] - first, -1)
        joined, n = {k: [own[k]] for k in names}, end - first
        for at in np.flatnonzero(stub[first:end] >= 0).tolist():
            part = by_place[tree, int(stub[first + at])]
            m = len(part["feature"])
            place = np.concatenate([[at], n + np.arange(m - 1)])
            for k in names:
                v = part[k] if k not in ("left", "right") else np.where(part[k] >= 0, place[part[k]], -1)
                own[k][at] = v[0]
                joined[k].append(v[1:])
            n += m - 1
        for k in names:
            v = np.concatenate(joined[k])
            out[k].append(np.where(v >= 0, v + size, -1) if k in ("left", "right") else v)
        size += n
    all_ = {k: np.concatenate(out[k]).astype(PART[k]) for k in names}
    inner = np.flatnonzero(all_["feature"] >= 0)
    all_["threshold"][inner] = [cuts[f][int(c)] for f, c in zip(all_["feature"][inner], all_["threshold"][inner])]
    return FlatTrees(tops.n_classes, False, np.array(roots, dtype=np.int32), **all_)


def softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def flattened(trees: list[Tree], rule: Rule, cuts: list[np.ndarray], value: Callable[[np.ndarray], np.ndarray], n_classes: int, places: list | None = None) -> FlatTrees:
    """Node arrays of what growth chose; a node that wasn't chosen is a leaf. ``places`` gets each tree's places by node."""
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "values", "gains")}
    roots, size = [], 0
    for t in trees:
        chosen = set(t.by_gain(rule, 1 << 30)[0])
        order, place = [0], {0: size}
        for node in order:
            if node in chosen:
                for child in (t.left[node], t.right[node]):
                    place[child] = size + len(order)
                    order.append(child)
        roots.append(size)
        size += len(order)
        if places is not None:
            places.append(place)
        for node in order:
            inner = node in chosen
            f = t.feature[node] if inner else -1
            parts["feature"].append(f)
            parts["threshold"].append(float(cuts[f][t.cut[node]]) if inner else 0.0)
            parts["left"].append(place[t.left[node]] if inner else -1)
            parts["right"].append(place[t.right[node]] if inner else -1)
            parts["values"].append(value(t.stats[node]))
            parts["gains"].append(t.best[node].gain if inner else 0.0)
    ints = {k: np.array(parts[k], dtype=np.int32) for k in ("feature", "left", "right")}
    return FlatTrees(
        n_classes, not rule.classes, np.array(roots, dtype=np.int32), ints["feature"], np.array(parts["threshold"]),
        ints["left"], ints["right"], np.array(parts["values"]).reshape(size, -1), np.array(parts["gains"]),
    )


def together(parts: list[FlatTrees]) -> FlatTrees:
    """The trees of all parts, one after the other."""
    starts = np.cumsum([0, *(len(p.feature) for p in parts[:-1])]).tolist()
    own = {name: np.concatenate([getattr(p, name) for p in parts]) for name in ("feature", "threshold", "values", "gains")}
    places = {
        name: np.concatenate([np.where(at >= 0, at + start, -1) for p, start in zip(parts, starts, strict=True) for at in [getattr(p, name)]])
        for name in ("roots", "left", "right")
    }
    return replace(parts[0], **own, **{name: at.astype(np.int32) for name, at in places.items()})


def feature_cuts(rows: DataFrame, features: Column, n_features: int) -> list[np.ndarray]:
    """At most ``BINS - 1`` cuts per feature, midway between neighbouring quantiles, in one scan per chunk of columns."""
    shares = F.array(*[F.lit((k + 0.5) / BINS) for k in range(BINS)])
    narrow = rows.select(features.alias("x"))
    out = []
    for first in range(0, n_features, CUT_COLUMNS):
        columns = range(first, min(n_features, first + CUT_COLUMNS))
        found = narrow.agg(*[F.percentile_approx(F.col("x")[k], shares, 10_000).alias(f"q{k}") for k in columns]).first()
        for values in found:
            points = np.unique(np.array(values if values is not None else [], dtype=np.float64))
            out.append((points[:-1] + points[1:]) / 2)
    return out


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    bins = np.empty(x.shape, dtype=np.uint8)
    for j, own in enumerate(cuts):
        bins[:, j] = np.searchsorted(own, x[:, j], side="left")
    return bins


def binned(rows: DataFrame, features: Column, label: Column, weight: Column, cuts: list[np.ndarray]) -> RDD:
    """Blocks of binned rows, kept for the jobs of a fit. Pass a staged table: blocks are named by their places in it."""
    told = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = bins_of(x, told.value)
            values = (bins, np.asarray(batch.column(1), dtype=np.int32), np.asarray(batch.column(2), dtype=np.float64))
            columns = [pa.array([(part << 32) + k], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "bins", "label", "weight"])

    narrow = rows.select(features.alias("x"), label.cast("int").alias("label"), weight.cast("double").alias("weight"))
    width = len(cuts)

    def block(r) -> Block:
        label = np.frombuffer(r.label, dtype=np.int32)
        bins = np.frombuffer(r.bins, dtype=np.uint8).reshape(len(label), width)
        return Block(r.name, bins, label, np.frombuffer(r.weight))

    out = narrow.mapInArrow(run, "name long, bins binary, label binary, weight binary").rdd.map(block)
    return out.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Gradients:
    """First and second derivatives of the weighted log loss by the score of one class."""

    n_classes: int
    #: The last block and its probabilities, as the trees of all classes ask for them in turn.
    seen: tuple[Block, np.ndarray] | None = None

    def __call__(self, block: Block, tree: int) -> tuple[np.ndarray, None]:
        if self.seen is None or self.seen[0] is not block:
            self.seen = block, softmax(block.scores)
        k = tree % self.n_classes
        p = self.seen[1][:, k]
        return np.stack([block.weight * (p - (block.label == k)), np.maximum(2 * block.weight * p * (1 - p), 1e-16)]), None


def same(task: int) -> int:
    return task


def copied_bins(blocks: RDD, n_classes: int) -> RDD:
    """All rows' bins by feature for each task that grows trees of some classes, kept for all rounds, so that a round deals statistics only."""
    waves = math.ceil(n_classes / blocks.context.defaultParallelism)
    tasks = math.ceil(n_classes / waves)
    dealt = blocks.flatMap(lambda b: [(t, (b.name, np.ascontiguousarray(b.bins.T))) for t in range(tasks)]).partitionBy(tasks, same)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def grow_whole(blocks: RDD, copies: RDD, keys: list[int], rule: Rule, sample: Sample) -> list[Tree]:
    """One tree per key, each grown in one task; ``copies`` has the bins of the same blocks."""
    tasks = copies.getNumPartitions()

    def deal(block: Block) -> Iterator[tuple[int, tuple]]:
        for t in range(tasks):
            yield t, (block.name, np.stack([sample(block, k)[0] for k in keys if k % tasks == t]))

    def finish(task: int, pieces: Iterable[tuple]) -> Iterator[tuple[int, Tree]]:
        bins, stats = {}, {}
        for _, (name, values) in pieces:
            (bins if values.dtype == np.uint8 else stats)[name] = values
        if not bins:
            return
        names = sorted(bins)
        # Features lie together, as a histogram goes through them one by one.
        rows, own = np.concatenate([bins[n] for n in names], axis=1).T, np.concatenate([stats[n] for n in names], axis=2)
        for k, some in zip([k for k in keys if k % tasks == task], own, strict=True):
            yield k, grow_here(rows, some, rule, k, 1, 0)

    # Both are dealt alike, so that the copies stay where they are.
    both = copies.union(blocks.flatMap(deal).partitionBy(tasks, same)).partitionBy(tasks, same)
    found = dict(both.mapPartitionsWithIndex(finish).collect())
    return [found[k] for k in keys]


def boost(blocks: RDD, n_rows: int, cuts: list[np.ndarray], n_classes: int, rounds: int, rate: float, rule: Rule) -> FlatTrees:
    """Gradient boosting of all classes at once: each round grows one tree per class on the softmax's gradients.

    Of a round's trees only the nodes that growth chose are kept, as arrays.
    """
    told = n_classes
    state = blocks.map(lambda b: replace(b, scores=np.zeros((len(b.label), told)))).persist(StorageLevel.MEMORY_AND_DISK)
    copies = copied_bins(blocks, n_classes) if n_rows <= rule.local_rows(len(cuts)) else None
    before: RDD | None = None
    kept: list[FlatTrees] = []
    # Steps are told and taken back: in the rounds' functions, which the driver keeps to the end, each job would carry those of up to 20 rounds.
    told_steps: list[Broadcast] = []
    stored: list[Broadcast] = []
    for r in range(rounds):
        keys = list(range(r * n_classes, (r + 1) * n_classes))
        if copies is None:
            grown = grow(state, keys, rule, n_rows, len(cuts), Gradients(told))
        else:
            grown = grow_whole(state, copies, keys, rule, Gradients(told))
        kept.append(flattened(grown, rule, cuts, lambda s: np.array([step_of(s, rule, rate)]), n_classes))
        if before is not None:
            before.unpersist()
        for past in stored:  # scores of these rounds were stored by the jobs above
            past.destroy()
        stored = []
        steps = blocks.context.broadcast([pruned(t, rule, rate) for t in grown])
        told_steps.append(steps)

        def scored(block: Block, steps=steps) -> Block:
            gained = np.stack([values[route(shape, block.bins)] for shape, values in steps.value], axis=1)
            return replace(block, scores=block.scores + gained)

        before, state = state, state.map(scored).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % STORED_ROUNDS == 0:
            # From here a lost executor's rows are scored again.
            state.checkpoint()
            # The stored rows' own function still goes along with what is made of them.
            stored, told_steps = told_steps[:-1], told_steps[-1:]
    before.unpersist()
    state.unpersist()
    for past in stored + told_steps:
        past.destroy()
    if copies is not None:
        copies.unpersist()
    return together(kept)


def step_of(stats: np.ndarray, rule: Rule, rate: float) -> float:
    low = stats[1] + rule.l2
    return -rate * float(stats[0]) / low if low > 0 else 0.0


def pruned(tree: Tree, rule: Rule, rate: float) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The chosen part of a tree for routing, and its nodes' steps."""
    chosen = set(tree.by_gain(rule, 1 << 30)[0])
    feature, cut, left, right = tree.shape()
    feature = np.where([k in chosen for k in range(len(feature))], feature, -1)
    steps = np.array([step_of(s, rule, rate) for s in tree.stats])
    return (feature, cut, left, right), steps


def drawn(block: Block, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A bootstrap sample of a block: each row as often as chance has it, on average once."""
    times = np.random.default_rng([seed, tree, block.name & 0xFFFFFFFF, block.name >> 32]).poisson(1.0, len(block.label))
    return np.stack([block.label.astype(np.float64), block.weight * times]), np.flatnonzero(times)


def forest(
    blocks: RDD, n_rows: int, cuts: list[np.ndarray], n_classes: int, n_trees: int, seed: int, max_depth: int | None = None
) -> FlatTrees | StoredForest:
    """Trees of unbounded depth on bootstrap samples; a node tries the root of the number of features.

    Dealt nodes are stored where they are grown, so the driver holds the tops of
    the trees only; a forest of up to ``TOLD_NODES`` nodes is then put together.
    """
    spark = SparkSession.builder.getOrCreate()
    n_features = len(cuts)
    tried = max(1, int(math.sqrt(n_features)))
    rule = Rule(classes=n_classes, max_depth=max_depth, tried=tried, seed=seed)
    sample = lambda block, tree: drawn(block, tree, seed)
    share = lambda s: s / s.sum() if s.sum() > 0 else np.full(n_classes, 1.0 / n_classes)
    bins = [np.arange(len(c), dtype=np.float64) for c in cuts]
    stored: list[DataFrame] = []

    def packed(item: tuple) -> tuple:
        (tree, node), own = item
        total = own["values"].sum(axis=1, keepdims=True)
        own = own | {"values": np.where(total > 0, own["values"] / np.where(total > 0, total, 1.0), 1.0 / n_classes)}
        return (tree, node, len(own["feature"]), *(np.ascontiguousarray(own[k], dtype=t).tobytes() for k, t in PART.items()))

    def store(finished: RDD) -> None:
        stored.append(stage_table(spark.createDataFrame(finished.map(packed), PART_SCHEMA, verifySchema=False), "forest-parts"))

    trees = grow(blocks, list(range(n_trees)), rule, n_rows, n_features, sample, store)
    places: list[dict[int, int]] = []
    tops = flattened(trees, rule, bins, share, n_classes, places)
    stub = np.full(len(tops.feature), -1, dtype=np.int32)
    if not stored:
        return whole_forest(tops, stub, [], cuts)
    parts = stored[0]
    for more in stored[1:]:
        parts = parts.unionByName(more)
    # A row for each dealt node: some thousands of rows of the table have one.
    sizes = parts.select("tree", "node", "n").collect()
    for r in sizes:
        stub[places[r.tree][r.node]] = r.node
    tops.values[stub >= 0] = 0.0
    if sum(r.n for r in sizes) <= TOLD_NODES:
        return whole_forest(tops, stub, [r.asDict() for r in parts.collect()], cuts)

    def gained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f, g = np.frombuffer(r["feature"], dtype=np.int32), np.frombuffer(r["gains"])
                sums = np.bincount(f[f >= 0], g[f >= 0], minlength=n_features)
                columns = [np.full(n_features, r["tree"], dtype=np.int32), np.arange(n_features, dtype=np.int32), sums.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "f", "gain"])

    gains = tops.gains_by_tree(n_features)
    each = parts.select("tree", "feature", "gains").mapInArrow(gained, "tree int, f int, gain double").groupBy("tree", "f").agg(F.sum("gain").alias("gain"))
    for r in each.collect():
        gains[r.tree, r.f] += r.gain
    return StoredForest(tops, stub, cuts, parts, gains)
