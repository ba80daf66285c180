"""Scores of altered rows under boosted trees, over Arrow batches.

A fitted model becomes a few arrays, and tasks score whole batches with them. A row that
differs from a scored one in one feature only passes the trees that split on that feature again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import SparkSession

from retentia.sources.sink import checkpoint_folder


class BoostedTrees:
    """The nodes of all trees in arrays; a leaf leads to itself. Read from the model as it is saved; its size is that of the model, whatever the rows."""

    def __init__(self, model: GBTClassificationModel):
        spark = SparkSession.active()
        path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
        model.save(path)
        split = "nodeData.split."
        nodes = spark.read.parquet(f"{path}/data").selectExpr(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            f"{split}featureIndex", f"{split}leftCategoriesOrThreshold AS cut", f"{split}numCategories",
        ).orderBy("treeID", "id").collect()
        tree = np.array([r["treeID"] for r in nodes])
        weights = np.array(model.treeWeights)
        self.roots = np.searchsorted(tree, np.arange(len(weights))).astype(np.int32)
        inner = np.array([r["leftChild"] >= 0 for r in nodes])
        own = np.arange(len(nodes))
        first = self.roots[tree]
        self.left = np.where(inner, first + [r["leftChild"] for r in nodes], own).astype(np.int32)
        self.right = np.where(inner, first + [r["rightChild"] for r in nodes], own).astype(np.int32)
        self.feature = np.where(inner, [r["featureIndex"] for r in nodes], 0).astype(np.int32)
        self.values = np.array([r["prediction"] for r in nodes]) * weights[tree]
        nominal = [i for i in own if inner[i] and nodes[i]["numCategories"] >= 0]
        self.cut = np.array([r["cut"][0] if n and r["numCategories"] < 0 else np.inf for n, r in zip(inner, nodes)])
        # One line of a table for each split of a category; what is no category of the feature goes the way that Spark sends it.
        self.line = np.full(len(nodes), -1, np.int32)
        self.line[nominal] = np.arange(len(nominal))
        width = max([nodes[i]["numCategories"] for i in nominal], default=0)
        self.goes_left = np.zeros((len(nominal), width + 1), bool)
        for at, i in enumerate(nominal):
            known, chosen = nodes[i]["numCategories"], np.array(nodes[i]["cut"], int)
            self.goes_left[at] = 2 * len(chosen) > known
            self.goes_left[at, :known] = False
            self.goes_left[at, chosen] = True
        splits = sorted({(int(t), int(f)) for t, f in zip(tree[inner], self.feature[inner])})
        #: Trees that split on a feature, for those that any tree splits on.
        self.trees_of = {f: np.array([t for t, g in splits if g == f]) for f in {f for _, f in splits}}
        self.depth, reached = 0, self.roots
        while inner[reached].any():
            reached = np.unique(np.r_[self.left[reached], self.right[reached]])
            self.depth += 1

    def leaves(self, x: np.ndarray, trees: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What each tree adds to the margin of each row."""
        at = np.broadcast_to(self.roots[trees], (len(x), len(self.roots[trees])))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            v = x[rows, self.feature[at]]
            left = v <= self.cut[at]
            if len(self.goes_left):
                line = self.line[at]
                where = np.nonzero(line >= 0)
                level = v[where]
                other = self.goes_left.shape[1] - 1
                place = np.where((level >= 0) & (level < other) & (level == np.floor(level)), level, other).astype(int)
                left[where] = self.goes_left[line[where], place]
            at = np.where(left, self.left[at], self.right[at])
        return self.values[at]

    def chances(self, leaves: np.ndarray) -> np.ndarray:
        """Probability of class 1. Rows with the same leaves have the same one."""
        margin = np.zeros(len(leaves))
        for t in range(leaves.shape[1]):
            margin += leaves[:, t]
        with np.errstate(over="ignore"):
            return 1.0 - 1.0 / (1.0 + np.exp(2.0 * margin))

    def swapped(self, own: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(feature, rows, chance before, chance after) with one feature at a time taken from the other row, for the rows whose value differs."""
        leaves = self.leaves(own)
        plain = self.chances(leaves)
        for f, trees in sorted(self.trees_of.items()):
            rows = np.flatnonzero(own[:, f] != other[:, f])
            mixed, changed = own[rows], leaves[rows]
            mixed[:, f] = other[rows, f]
            changed[:, trees] = self.leaves(mixed, trees)
            yield f, rows, plain, self.chances(changed)

    def walked(self, own: np.ndarray, other: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Change of the chance as features switch from the other row's to the row's own in the given order, by feature."""
        n, width = own.shape
        rows, state, credit = np.arange(n), other.copy(), np.zeros((n, width))
        used = np.zeros(width, bool)
        used[list(self.trees_of)] = True
        last = self.chances(self.leaves(state))
        for step in range(width):
            f = order[:, step]
            moved = np.flatnonzero(used[f] & (own[rows, f] != other[rows, f]))
            state[moved, f[moved]] = own[moved, f[moved]]
            chance = self.chances(self.leaves(state[moved]))
            credit[moved, f[moved]] = chance - last[moved]
            last[moved] = chance
        return credit


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of lists that are all of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)
