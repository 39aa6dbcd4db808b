"""Histogram trees: splits, growth in one task and over many, boosting, forests and flat scoring."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark import RDD, Broadcast
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabscope.operators import trees
from tabscope.operators.trees import Block, Rule
from tabscope.plans.trainers import FEATURES, TreeScorer
from tabscope.session import shared_path


def plain_best(bins, stats, rule, features):
    """The split of the largest gain, by trying each cut of each feature."""
    best = None
    whole = rule.strength(trees.sums(stats, rule))
    for f in features:
        for cut in np.unique(bins[:, f])[:-1]:
            goes = bins[:, f] <= cut
            low, high = trees.sums(stats[:, goes], rule), trees.sums(stats[:, ~goes], rule)
            if min(goes.sum(), (~goes).sum()) < rule.least_rows:
                continue
            if not rule.classes and min(low[1], high[1]) < rule.least_hessian:
                continue
            gain = rule.strength(low) + rule.strength(high) - whole
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * max(1.0, gain)):
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("rule", [Rule(classes=3), Rule(l2=1.0, least_hessian=1.0), Rule(least_rows=7)])
def test_best_split(rule):
    rng = np.random.default_rng(1)
    for _ in range(40):
        bins = rng.integers(0, 6, (30, 4)).astype(np.uint8)
        if rule.classes:
            stats = np.stack([rng.integers(0, 3, 30), rng.random(30)]).astype(float)
        else:
            stats = np.stack([rng.normal(size=30), rng.random(30)])
        want = plain_best(bins, stats, rule, range(4))
        for found in (
            trees.best_split(trees.histogram(bins, stats, rule), np.arange(4), rule),
            trees.best_split_of_few(bins, stats, np.arange(4), rule),
        ):
            assert (found is None) == (want is None)
            if want:
                assert (found.feature, found.cut) == want[1:] and found.gain == pytest.approx(want[0])
                goes = bins[:, found.feature] <= found.cut
                assert found.left_rows == goes.sum() and np.allclose(found.left, trees.sums(stats[:, goes], rule))


def test_dealt_nodes_grow_side_by_side(monkeypatch):
    """Subtrees grown together are those grown one at a time, and their small nodes share steps."""
    rng = np.random.default_rng(8)
    items = []
    for tree, (n, path, depth) in enumerate([(700, 1, 0), (90, 5, 2), (1, 3, 1), (40, 1 << 70, 70), (300, 2, 1)]):
        bins = rng.integers(0, 12, (n, 7)).astype(np.uint8)
        bins[n // 2 :] = bins[: n - n // 2]  # equal rows of different classes can't be told apart
        items.append((bins, np.stack([rng.integers(0, 4, n), 0.5 + rng.random(n)]), tree, path, depth))
    calls, plain = [], trees.splits_of_few
    monkeypatch.setattr(trees, "splits_of_few", lambda *x: calls.append(1) or plain(*x))
    for rule in (Rule(classes=4, tried=2, seed=3), Rule(classes=4, tried=3, max_depth=71), Rule(classes=4, tried=7)):
        calls.clear()
        found = trees.grow_side_by_side(items, rule)
        for (bins, stats, *place), own in zip(items, found, strict=True):
            want = trees.node_arrays(trees.grow_here(bins, stats, rule, *place), rule)
            assert set(own) == set(trees.PART)
            for name in own:
                assert np.allclose(own[name], want[name], rtol=1e-12, atol=1e-12), name
        assert len(calls) < sum(len(own["feature"]) for own in found) / 4


def blocks_of(spark, x, y, w, parts):
    """Rows cut to blocks, with a cut between any two values."""
    cuts = [(v[:-1] + v[1:]) / 2 for v in (np.unique(c) for c in x.T)]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)
    own = [Block(k, bins[k::parts], y[k::parts].astype(np.int32), w[k::parts]) for k in range(parts)]
    return spark.sparkContext.parallelize(own, parts).cache(), cuts


def table(n=240, seed=2, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, 5)) + y[:, None] * np.array([1.5, -1, 0.5, 0, 0]), 2)
    return x, y, 0.5 + rng.random(n)


def nodes(flat):
    return [flat.roots, flat.feature, flat.left, flat.right, np.round(flat.threshold, 9), np.round(flat.values, 9)]


@pytest.fixture
def checkpoints(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))


@pytest.mark.parametrize("rule", [Rule(max_depth=4, l2=1.0, least_hessian=1.0), Rule(max_leaves=9, least_rows=5, least_hessian=1e-3)])
def test_many_tasks_grow_what_one_does(spark, checkpoints, monkeypatch, rule):
    """Histograms over all tasks, dealt nodes, or both: the boosted trees are the same, also past a checkpoint."""
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 3)
    monkeypatch.setattr(trees, "STORED_ROUNDS", 2)
    found = []
    for local in (10_000, 60, 0):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local)
        found.append(nodes(trees.boost(blocks, len(y), cuts, 3, 5, 0.3, rule)))
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], other, strict=True))


def test_jobs_of_a_round(spark, checkpoints, monkeypatch):
    """All classes of a round share their jobs: one for each level, and one where nodes fit in a task."""
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    blocks.count()
    tracker = spark.sparkContext.statusTracker()
    for local, most in ((10_000, 1), (0, 4)):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local)
        group = f"round-{local}"
        spark.sparkContext.setJobGroup(group, group)
        trees.boost(blocks, len(y), cuts, 3, 1, 0.3, Rule(max_depth=3, l2=1.0))
        assert 0 < len(tracker.getJobIdsForGroup(group)) <= most
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("rule", [Rule(max_depth=4, l2=1.0, least_hessian=1.0), Rule(max_leaves=9, least_rows=5, least_hessian=1e-3)])
def test_boosted_trees_grow_whole_or_by_nodes(spark, checkpoints, monkeypatch, rule):
    """Trees grown where their bins stay are those of histograms and dealt nodes, also with several classes to a task."""
    x, y, w = table(classes=11)
    blocks, cuts = blocks_of(spark, x, y, w, 3)
    found = []
    for local, boosted in ((10, 25), (60, 1), (10, 1)):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(trees, "BOOSTED", boosted)
        found.append(nodes(trees.boost(blocks, len(y), cuts, 11, 2, 0.3, rule)))
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], other, strict=True))


def test_boosted_round_is_one_job(spark, checkpoints, monkeypatch):
    """Boosting grows twelve times the rows of a forest's dealt node in one job a round."""
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    blocks.count()
    monkeypatch.setattr(trees, "LOCAL_ROWS", 20)
    spark.sparkContext.setJobGroup("whole", "whole")
    trees.boost(blocks, len(y), cuts, 3, 2, 0.3, Rule(max_depth=3, l2=1.0))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole")) == 2


def test_boosting_keeps_arrays_of_past_rounds(spark, checkpoints, monkeypatch):
    """The driver never holds more trees in the making than those of one round."""
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    sizes, plain = [], trees.flattened
    monkeypatch.setattr(trees, "flattened", lambda grown, *more: sizes.append(len(grown)) or plain(grown, *more))
    flat = trees.boost(blocks, len(y), cuts, 3, 4, 0.3, Rule(max_depth=3, l2=1.0))
    assert sizes == [3] * 4 and len(flat.roots) == 12


def test_rounds_dont_carry_steps_of_others(spark, checkpoints, monkeypatch):
    """Functions of the rounds have a size of their own; steps are told, and taken back once their scores are stored."""
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    monkeypatch.setattr(trees, "STORED_ROUNDS", 3)
    functions, plain = [], RDD.map
    monkeypatch.setattr(RDD, "map", lambda rdd, f, *more: functions.append(f) or plain(rdd, f, *more))
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda told, *more: gone.append(told) or destroy(told, *more))
    trees.boost(blocks, len(y), cuts, 3, 8, 0.3, Rule(max_depth=5, l2=1.0))
    rounds = [f for f in functions if f.__name__ == "scored"]
    assert len(rounds) == 8
    assert [f.__defaults__[0] for f in rounds] == gone


def test_dealt_nodes_load_tasks_evenly():
    assert sorted(trees.even_tasks({(k, 0): 7 for k in range(10)}, 10).values()) == list(range(10))
    dealt = trees.even_tasks({(0, 0): 9, (1, 4): 5, (2, 1): 4, (3, 0): 0}, 2)
    assert dealt[0, 0] != dealt[1, 4] == dealt[2, 1]


@pytest.mark.parametrize("n", [300, 5_000])
def test_histogram_by_feature(n):
    rng = np.random.default_rng(4)
    bins, stats = rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.normal(size=(2, n))
    want = np.zeros((3, trees.BINS, 3))
    for j in range(3):
        np.add.at(want[j], bins[:, j], np.column_stack([*stats, np.ones(n)]))
    assert np.allclose(trees.histogram(bins, stats, Rule()), want, atol=1e-9)


def test_growth_by_largest_gain():
    """The leaf of the largest gain splits first, however deep it lies; the bound counts leaves."""
    x, y, w = table(400, 5, 2)
    bins = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], axis=1).clip(0, 255).astype(np.uint8)
    stats = np.stack([w * (0.5 - y), np.full(len(y), 0.25)])
    rule = Rule(max_leaves=6, least_rows=2)
    tree = trees.grow_here(bins, stats, rule, 0, 1, 0)
    chosen, lacking = tree.by_gain(rule, 1 << 30)
    assert len(chosen) == 5
    open_leaves = {0}
    for node in chosen:
        gains = {k: tree.best[k].gain for k in open_leaves if tree.best[k]}
        assert node == max(gains, key=lambda k: (gains[k], -k))
        open_leaves.remove(node)
        if tree.feature[node] >= 0:
            open_leaves |= {tree.left[node], tree.right[node]}
    deep = trees.grow_here(bins, stats, Rule(least_rows=2), 0, 1, 0)
    assert max(deep.depth) > 6


def test_forest_has_no_depth_bound(spark):
    """Classes that alternate along one feature make a chain of more than 30 levels."""
    n = 120
    x = np.stack([np.arange(n), np.zeros(n)], axis=1).astype(float)
    y = np.arange(n) % 2
    w = 1.5 ** np.arange(n)  # the heaviest rows go first, one by one
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    cuts[1] = np.zeros(0)
    flat = trees.forest(blocks, n, cuts, 2, 4, seed=3)
    assert flat.depth() > 30
    p = flat.probabilities(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.8


def test_forest_grows_alike_over_many_tasks(spark, monkeypatch):
    x, y, w = table(150, 7)
    blocks, cuts = blocks_of(spark, x, y, w, 3)
    found = []
    for local in (10_000, 30, 0):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(trees, "JOB_CELLS", 1 << 14 if local else 1 << 24)
        flat = trees.forest(blocks, len(y), cuts, 3, 3, seed=1, max_depth=None if local else 4)
        if local:
            found.append(flat)
        else:
            assert 0 < flat.depth() <= 4
    same = lambda f: np.round(f.probabilities(x), 9).tolist()
    assert same(found[0]) == same(found[1])


def test_forest_deals_whole_trees(spark, monkeypatch):
    """Up to many times ``LOCAL_ROWS`` a tree is grown by one task without a job per level; by histograms it is the same."""
    x, y, w = table(400, 12)
    blocks, cuts = blocks_of(spark, x, y, w, 3)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 20)
    calls, plain = [], trees.count_large
    monkeypatch.setattr(trees, "count_large", lambda *a: calls.append(1) or plain(*a))
    whole = trees.forest(blocks, len(y), cuts, 3, 3, seed=1)
    assert not calls
    monkeypatch.setattr(trees, "FOREST", 1)
    levels = trees.forest(blocks, len(y), cuts, 3, 3, seed=1)
    assert len(calls) > 2
    assert np.allclose(whole.probabilities(x), levels.probabilities(x))


def test_rows_keep_features_together():
    bins = np.arange(60, dtype=np.uint8).reshape(12, 5)
    rows = np.array([1, 4, 9])
    by_feature = np.asfortranarray(bins)
    assert np.array_equal(trees.taken(by_feature, rows), bins[rows]) and trees.taken(by_feature, rows).flags.f_contiguous
    assert np.array_equal(trees.taken(bins, rows), bins[rows]) and trees.taken(by_feature, np.arange(12)) is by_feature


def test_large_forest_stays_in_storage(spark, monkeypatch):
    """Parts of trees that are grown in tasks never come to the driver; the scores are those of the forest told whole."""
    x, y, w = table(300, 11)
    blocks, cuts = blocks_of(spark, x, y, w, 3)
    monkeypatch.setattr(trees, "SCORED_ROWS", 7)
    monkeypatch.setattr(trees, "SHARED_ROWS", 90)
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["id", FEATURES]).repartition(4)
    for local in (10_000, 60):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(trees, "TOLD_NODES", 500_000)
        told = trees.forest(blocks, len(y), cuts, 3, 5, seed=1)
        monkeypatch.setattr(trees, "TOLD_NODES", 0)
        stored = trees.forest(blocks, len(y), cuts, 3, 5, seed=1)
        assert isinstance(stored, trees.StoredForest) and len(stored.tops.feature) < len(told.feature) / 3
        assert np.allclose(stored.importances(5), told.importances(5)) and told.importances(5).sum() == pytest.approx(1)
        path = shared_path(spark, "forest")
        TreeScorer("random_forest", stored, 5).save(spark, path)
        scored = TreeScorer.load(spark, "random_forest", path).probabilities(rows).orderBy("id").collect()
        assert [r.id for r in scored] == list(range(300))
        assert np.allclose([r.probabilities for r in scored], told.probabilities(x))


def test_model_is_kept_and_loaded_as_arrays(spark, monkeypatch):
    """The driver takes a few times the model's own bytes for it, not an object per node and value."""
    n, rng = 60_000, np.random.default_rng(6)
    ints = {k: rng.integers(-1, 9, n).astype(np.int32) for k in ("feature", "left", "right")}
    for width, boosted in ((1, True), (3, False)):
        roots = np.arange(0, n, 30, dtype=np.int32)
        flat = trees.FlatTrees(3, boosted, roots, threshold=rng.normal(size=n), values=rng.normal(size=(n, width)), gains=rng.random(n), **ints)
        path = shared_path(spark, "model")
        monkeypatch.setattr("tabscope.plans.trainers.PACKED_NODES", 7_000, raising=False)
        tracemalloc.start()
        TreeScorer("any", flat, 9).save(spark, path)
        kept = TreeScorer.load(spark, "any", path).trees
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (kept.n_classes, kept.boosted) == (3, boosted)
        for name in ("roots", "feature", "threshold", "left", "right", "values", "gains"):
            assert np.array_equal(getattr(kept, name), getattr(flat, name)) and getattr(kept, name).dtype == getattr(flat, name).dtype
        assert peak < 5 * (flat.nbytes + flat.gains.nbytes)


def test_class_weights_count(spark):
    """A rare class with a large weight wins where the features can't tell."""
    x = np.zeros((100, 2))
    x[:, 0] = np.arange(100) % 2
    y = (np.arange(100) < 10).astype(int)
    heavy, cuts = blocks_of(spark, x, y, np.where(y == 1, 50.0, 1.0), 2)
    light, _ = blocks_of(spark, x, y, np.ones(100), 2)
    assert (trees.forest(heavy, 100, cuts, 2, 10, 1).probabilities(x)[:, 1] > 0.5).all()
    assert (trees.forest(light, 100, cuts, 2, 10, 1).probabilities(x)[:, 1] < 0.5).all()


def test_flat_trees_score_as_single_ones(spark, checkpoints):
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    flat = trees.boost(blocks, len(y), cuts, 3, 4, 0.3, Rule(max_depth=3, l2=1.0))
    margins = np.zeros((len(x), 3))
    for k, root in enumerate(flat.roots.tolist()):
        for i, row in enumerate(x):
            at = root
            while flat.feature[at] >= 0:
                at = flat.left[at] if row[flat.feature[at]] <= flat.threshold[at] else flat.right[at]
            margins[i, k % 3] += flat.values[at, 0]
    assert np.allclose(flat.probabilities(x), trees.softmax(margins))
    assert flat.probabilities(x[:0]).shape == (0, 3)
    assert flat.importances(5).sum() == pytest.approx(1) and flat.depth() <= 3


def test_boosting_lowers_the_loss(spark, checkpoints):
    x, y, w = table()
    blocks, cuts = blocks_of(spark, x, y, w, 2)
    losses = []
    for rounds in (1, 5, 20):
        p = trees.boost(blocks, len(y), cuts, 3, rounds, 0.1, Rule(max_depth=4, l2=1.0)).probabilities(x)
        losses.append(-(w * np.log(p[np.arange(len(y)), y])).sum())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.6 * losses[0]


def test_cuts_and_bins_agree(spark):
    """Scoring by thresholds puts every training row where its bins put it."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(2000, 11)), 2)
    x[:, 4] = 7.0
    df = spark.createDataFrame([(v.tolist(), int(i % 2), 1.0) for i, v in enumerate(x)], "x array<double>, y int, w double")
    cuts = trees.feature_cuts(df, F.col("x"), 11)
    assert all(len(c) < trees.BINS and (np.diff(c) > 0).all() for c in cuts) and len(cuts[4]) == 0
    blocks = trees.binned(df, F.col("x"), F.col("y"), F.col("w"), cuts).collect()
    rows = np.concatenate([b.bins for b in sorted(blocks, key=lambda b: b.name)])
    want = np.stack([(x[:, [j]] > c[None, :]).sum(axis=1) for j, c in enumerate(cuts)], axis=1)
    assert sorted(map(tuple, rows.tolist())) == sorted(map(tuple, want.tolist()))
    assert len({b.name for b in blocks}) == len(blocks)
