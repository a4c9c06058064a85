"""Comparison trees: AND / OR trees over features, as one boolean Column."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.features import raw_feature


def leaves(tree: dict[str, Any] | None) -> list[dict[str, Any]]:
    """The leaf specs of a tree, left to right."""
    if not tree:
        return []
    if "comp_a" in tree:
        return leaves(tree["comp_a"]) + leaves(tree["comp_b"])
    if "secondary" in tree:
        return leaves(tree["threshold_a"]) + leaves(tree["threshold_b"])
    return [tree]


def tree_condition(tree: dict[str, Any] | None, features: dict[str, dict[str, Any]], ready: set[str] = frozenset()) -> Column | None:
    """The tree's condition, or None if it is empty.

    features: specs by alias; ready: aliases that are columns of the pair table already.
    """
    if not tree:
        return None
    if "comp_a" in tree:
        left, right = (tree_condition(tree[k], features, ready) for k in ("comp_a", "comp_b"))
        return _joined(tree, left, right)
    if "secondary" in tree:  # a pair of thresholds over columns of the pair table
        left, right = (F.col(tree[k]["feature_name"]) >= tree[k]["threshold"] for k in ("threshold_a", "threshold_b"))
        return _joined(tree, left, right)
    return _leaf(tree, features, ready)


def _joined(tree: dict[str, Any], left: Column, right: Column) -> Column:
    op = str(tree.get("operator")).upper()
    if op == "AND":
        return left & right
    if op == "OR" and "secondary" not in tree:
        return left | right
    raise ValueError(f"operator {tree.get('operator')!r} can't join these")


def _leaf(leaf: dict[str, Any], features: dict[str, dict[str, Any]], ready: set[str]) -> Column:
    alias = leaf.get("feature_name")
    if "column_name" in leaf:
        value = F.expr(leaf["column_name"])
    elif alias in ready:
        value = F.col(alias)
    elif alias in features:
        value = raw_feature(features[alias])
    else:
        raise ValueError(f"no feature is named {alias!r}")
    kind = leaf.get("comparison_type")
    if kind is None:
        return value
    if kind != "threshold":
        raise ValueError(f"a comparison is a threshold or a plain feature, not {kind!r}")
    return _suffix(value, leaf["threshold_expr"]) if leaf.get("threshold_expr") else value >= leaf["threshold"]


def _suffix(value: Column, text: str) -> Column:
    """A comparison given as text, such as '<= 10'."""
    m = re.fullmatch(r"\s*(<=|>=|<>|!=|==|=|<|>)\s*(.+?)\s*", text)
    if not m:
        raise ValueError(f"threshold_expr has to be a comparison, not {text!r}")
    right = F.expr(m[2])
    ops = {"<=": value <= right, ">=": value >= right, "<": value < right, ">": value > right, "=": value == right, "==": value == right, "!=": value != right, "<>": value != right}
    return ops[m[1]]
