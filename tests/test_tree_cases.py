"""Tree attributions by case."""

import numpy as np

from stayscope.operators import treeshap


def test_equal_cases_are_computed_once(monkeypatch):
    """Many rows on short paths: the games are solved per case, not per row, and equal those of single rows."""
    draw = np.random.default_rng(5)
    used = np.array([draw.choice(6, 3, replace=False) for _ in range(7)])
    low, share = draw.normal(size=(7, 3)), draw.uniform(0, 1, (7, 3))
    group = treeshap.LeafGroup(used, low, low + 1.5, share, draw.normal(size=7))
    x, solved, gains = draw.normal(size=(500, 6)), [0], treeshap._gains

    def counted(share, met):
        solved[0] += met.size
        return gains(share, met)

    single = np.zeros((500, 6))
    for i in range(500):
        group.add(x[i: i + 1], single[i: i + 1])
    monkeypatch.setattr(treeshap, "_gains", counted)
    whole = np.zeros((500, 6))
    group.add(x, whole)
    assert np.allclose(whole, single, atol=1e-12) and solved[0] == 7 * 3 * 8


def _grown(draw, depth, features):
    """A tree whose paths meet some features more than once; a branch may end early."""
    nodes, waiting = {0: (0, 1000.0)}, [0]
    made = {}
    while waiting:
        at = waiting.pop()
        level, cover = nodes[at]
        if level == depth or level > 1 and draw.random() < 0.2:
            made[at] = {"left": -1, "right": -1, "feature": -1, "threshold": 0.0, "cover": cover, "prediction": float(draw.normal())}
            continue
        left, right, part = len(nodes), len(nodes) + 1, draw.uniform(0.1, 0.9)
        nodes[left], nodes[right] = (level + 1, cover * part), (level + 1, cover * (1 - part))
        made[at] = {"left": left, "right": right, "feature": int(draw.integers(features)), "threshold": float(draw.integers(-2, 3)) / 2, "cover": cover}
        waiting += [left, right]
    return {at: node | {"categories": -1} for at, node in made.items()}


def test_subtrees_looked_up_together_equal_leaves_one_by_one(monkeypatch):
    """Ties with thresholds, repeated features, missing and infinite values; leaves are not visited one by one for many rows."""
    draw = np.random.default_rng(3)
    trees = [_grown(draw, depth, 5) for depth in (1, 3, 7, 8)]
    leaves = [treeshap._leaves(tree, 1.0, True) for tree in trees]
    tables = treeshap.TreeTables(
        [group for found in leaves for group in treeshap._grouped(found)], 0.0, 0.0, [treeshap._path_tree(tree, 1.0, True) for tree in trees]
    )
    x = draw.integers(-3, 4, (2 * treeshap.CASE_ROWS, 5)) / 2
    x[5, 2], x[6, 0], x[7, 1] = np.nan, -np.inf, np.inf
    expected, visited, add = tables._by_leaf(x, 5), [], treeshap.LeafGroup.add
    monkeypatch.setattr(treeshap.LeafGroup, "add", lambda group, rows, phi: (visited.append(len(rows)), add(group, rows, phi)))
    assert np.allclose(tables.attribute(x, 5), expected, atol=1e-12)
    assert max(visited) == 2  # the rows with values that meet no condition


def test_long_paths_are_attributed_leaf_by_leaf(spark):
    """A path of more features than a case has bits leaves all trees to the leaves."""
    from stayscope.operators.boosting import BoostedTrees, Tree

    long, at = Tree([*range(14)]), None
    at = long.add(0.0, 100.0)
    for feature in range(14):
        left, right = long.add(0.5, 0.4 * long.cover[at]), long.add(0.0, 0.6 * long.cover[at])
        long.feature[at], long.threshold[at], long.left[at], long.right[at] = feature, 0.0, left, right
        at = right
    tables = treeshap.tree_tables(BoostedTrees([long], 14, 14), spark)
    x = np.random.default_rng(1).normal(size=(treeshap.CASE_ROWS, 14))
    assert tables.trees == [] and np.allclose(tables.attribute(x, 14)[:50], tables.attribute(x[:50], 14), atol=1e-12)
