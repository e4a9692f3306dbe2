"""A small set of fitted detectors, stored as numbers, that queries and the stream use where none is given.

They were fitted by ``plans.batch`` 's own classes on the first 15,000 labelled rows of the observation projection, over
six features, and rounded to four digits, so that other engines can be given the same parameters.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from driftwarden.operators import detectors
from driftwarden.plans.batch import Artifacts

# The fitted parameters.
COLUMNS = ["temperature_rate_per_hour", "temperature_roll_range_60m", "pressure_rate_per_hour", "pressure_roll_range_60m", "humidity_rate_per_hour", "humidity_roll_range_60m"]
MEDIAN = [-0.0048, 1.859, 0.0, 7.1, 0.0, 32.0]
MEAN = [-0.008542, 2.11, -0.01642, 6.588, 0.1407, 24.71]
DEVIATION = [8.281, 1.434, 23.59, 2.267, 101.4, 13.68]
COMPONENTS = [
    [-0.3238, 0.6024, -0.02825, 0.5807, -0.0116, 0.4405],
    [0.7174, -0.3218, 0.0193, 0.3573, 0.06669, 0.4993],
    [-0.007813, 0.01345, -0.705, -0.00551, 0.7077, -0.04343],
]
#: A tree is the depth of a leaf, or (column, cut of its scaled value, tree up to the cut, tree above it).
TREES = [
    (4, -0.6373, (3, -1.322, 2.0, (1, -0.03505, 3.0, 3.0)), (5, -0.8847, (3, 0.8573, 3.0, 3.0), (2, 0.348, 4.0, 3.0))),
    (4, -0.4759, (3, 0.2112, 2.0, (2, -1.031, 3.0, 5.327)), 1.0),
    (2, -0.1384, (4, 0.6285, 2.0, 2.0), (0, -0.7833, 2.0, (3, -1.022, 3.0, 4.852))),
    (0, -1.898, 1.0, (4, -0.2031, (0, 0.6593, 5.327, 3.0), 2.0)),
]
TREE_ROWS = 8
LIMITS = {"statistical": 10.0, "pca": 1.897, "isolation_forest": 0.6921}
CENTRE = {"pca_score": 0.3136, "isolation_forest_score": 0.5653, "statistical_score": 1.456}
SPREAD = {"pca_score": 0.4173, "isolation_forest_score": 0.1268, "statistical_score": 1.08}


def rows_of(tree, level: int = 0) -> int:
    """Fitted rows in a tree: a leaf's depth is its level and what so many rows add."""
    if isinstance(tree, tuple):
        return sum(rows_of(t, level + 1) for t in tree[2:])
    return min(range(1, TREE_ROWS + 1), key=lambda n: abs(level + detectors.path_normaliser(n) - tree))


def flat(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left child, leaf depth, fitted rows) by node, children side by side after their parent."""
    feature, cut, left, depth, held = [-1], [0.0], [0], [0.0], [rows_of(tree)]
    todo = [(0, tree, 0)]
    while todo:
        node, own, level = todo.pop()
        if not isinstance(own, tuple):
            depth[node] = own
            continue
        feature[node], cut[node], left[node] = own[0], own[1], len(feature)
        for child in own[2:]:
            todo.append((len(feature), child, level + 1))
            feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0), held.append(rows_of(child, level + 1))
    return np.array(feature), np.array(cut), np.array(left), np.array(depth), np.array(held)


@cache
def stored() -> Artifacts:
    scaler = detectors.Scaler(COLUMNS, MEDIAN, MEAN, DEVIATION)
    components = detectors.PrincipalComponents(scaler, COMPONENTS, LIMITS["pca"])
    forest = detectors.IsolationForest(scaler, [flat(t) for t in TREES], TREE_ROWS, LIMITS["isolation_forest"])
    return Artifacts(LIMITS["statistical"], components, forest, detectors.ModelEvidence(CENTRE, SPREAD), 1.0, 1.0)
