"""A trained model as a table of tree nodes, and its prediction as a column expression.

The expression walks the trees over an array of inputs, so a prediction can stand
inside other expressions, such as a loop over the steps of a forecast.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F

_TREE = re.compile(r"\s*Tree \d+ \(weight (\S+)\):")
_SPLIT = re.compile(r"\s*If \(feature (\d+) (?:<= (\S+)|in \{(.*)\})\)")
_OTHER = re.compile(r"\s*Else ")
_LEAF = re.compile(r"\s*Predict: (\S+)")

_SCHEMA = """struct<root: array<int>, weight: array<double>, feature: array<int>, threshold: array<double>,
  categories: array<array<double>>, left: array<int>, right: array<int>, value: array<double>>"""


@dataclass
class TreeTable:
    """Nodes of all trees, one after the other. A leaf is its own child on both sides, so that a walk of
    ``depth`` steps ends at a leaf wherever it lies."""

    root: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    categories: list[list[float] | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: int = 0

    @classmethod
    def of(cls, model: PipelineModel) -> TreeTable:
        """The trees of a fitted pipeline, from the description of its model."""
        table = cls()
        waiting: list[tuple[int, int]] = []  # splits whose right side is still to come, with their depth
        parent: tuple[int, int, bool] | None = None  # node, depth and side that the next node hangs on
        for line in model.stages[-1].toDebugString.splitlines():
            if found := _TREE.match(line):
                table.root.append(len(table.feature))
                table.weight.append(float(found[1]))
                parent = None
            elif _OTHER.match(line):
                parent = (*waiting.pop(), False)
            elif found := _SPLIT.match(line):
                node = table._node(int(found[1]), float(found[2] or 0.0), None if found[3] is None else
                                   [float(c) for c in found[3].split(",") if c], 0.0)
                at = table._hang(node, parent)
                waiting.append((node, at))
                parent = (node, at, True)
            elif found := _LEAF.match(line):
                table._hang(table._node(0, 0.0, None, float(found[1])), parent)
        return table

    def _node(self, feature: int, threshold: float, categories, value: float) -> int:
        node = len(self.feature)
        for values, new in ((self.feature, feature), (self.threshold, threshold), (self.categories, categories),
                            (self.left, node), (self.right, node), (self.value, value)):
            values.append(new)
        return node

    def _hang(self, node: int, parent: tuple[int, int, bool] | None) -> int:
        """Put ``node`` under its parent; returns its depth."""
        if parent is None:
            return 0
        above, depth, on_left = parent
        (self.left if on_left else self.right)[above] = node
        self.depth = max(self.depth, depth + 1)
        return depth + 1

    def predict(self, inputs: Column) -> Column:
        """The model's prediction for an array of its inputs, in the order they were trained in.

        The table is one literal, whatever the number of trees; what is looked at per row are the nodes on the
        way down, ``depth`` a tree.
        """
        nodes = F.from_json(F.lit(json.dumps({
            name: getattr(self, name) for name in ("root", "weight", "feature", "threshold", "categories", "left", "right", "value")
        })), _SCHEMA)

        def go_down(node: Column, x: Column) -> Column:
            value = F.get(x, F.get(nodes["feature"], node))
            among = F.get(nodes["categories"], node)
            goes_left = F.when(among.isNull(), value <= F.get(nodes["threshold"], node)).otherwise(F.array_contains(among, value))
            return F.when(goes_left, F.get(nodes["left"], node)).otherwise(F.get(nodes["right"], node))

        def add_tree(total: Column, tree: Column) -> Column:
            leaf = F.get(nodes["root"], tree)
            if self.depth:
                leaf = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), leaf, lambda node, _: go_down(node, total["x"]))
            return F.struct((total["sum"] + F.get(nodes["weight"], tree) * F.get(nodes["value"], leaf)).alias("sum"), total["x"].alias("x"))

        start = F.struct(F.lit(0.0).alias("sum"), inputs.alias("x"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.root) - 1)), start, add_tree, lambda total: total["sum"])
