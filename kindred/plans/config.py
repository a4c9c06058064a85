"""Configuration files: loading and validation."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from kindred.functions.features import AGGREGATES, FEATURES, HOUSEHOLD_AGGREGATES, referenced_columns
from kindred.functions.transforms import TRANSFORMS
from kindred.functions.trees import leaves
from kindred.sources.io import datasource_path

SELECTIONS = (
    "bigrams", "sql_condition", "array", "union", "hash", "soundex", "power", "popularity", "attach_variable",
    "neighbor_aggregate", "attach_family_col", "related_individuals", "related_individual_rows",
)


def load(path: str) -> dict[str, Any]:
    """A .toml or .json file; without an extension, whichever of the two exists."""
    p = Path(path)
    found = [p] if p.suffix in (".toml", ".json") else [q for q in (Path(f"{p}.toml"), Path(f"{p}.json")) if q.exists()]
    if not found or not found[0].exists():
        raise FileNotFoundError(f"no configuration at {path}, {path}.toml or {path}.json")
    text = found[0].read_text(encoding="utf-8-sig")
    conf = tomllib.loads(text) if found[0].suffix == ".toml" else json.loads(text)
    return conf | {"conf_path": str(found[0])}


class Columns:
    """Column names that are there so far, without regard to case."""

    def __init__(self, names):
        self.names = {n.lower() for n in names}

    def need(self, name: str, where: str) -> None:
        if name.lower() not in self.names:
            raise ValueError(f"{where}: column {name} is not available")

    def add(self, name: str, where: str, fresh: bool = True) -> None:
        if fresh and name.lower() in self.names:
            raise ValueError(f"{where}: {name} is defined twice")
        self.names.add(name.lower())


def validate(conf: dict[str, Any], raw_a: DataFrame, raw_b: DataFrame) -> None:
    """ValueError with the first mistake; every section sees the columns that the ones before it leave."""
    for key in ("id_column", "datasource_a", "datasource_b", "column_mappings"):
        if key not in conf:
            raise ValueError(f"section {key} is missing")
    a, b = Columns(raw_a.columns), Columns(raw_b.columns)
    for side in ("datasource_a", "datasource_b"):
        if not conf[side].get("alias"):
            raise ValueError(f"{side}: alias is missing")
        datasource_path(conf[side])
    if conf["datasource_a"]["alias"] == conf["datasource_b"]["alias"]:
        raise ValueError("the datasources have the same alias")
    id_column = conf["id_column"]
    for cols, side in ((a, "datasource_a"), (b, "datasource_b")):
        cols.need(id_column, side)
    _filters(conf, a, b)
    mapped = _mappings(conf, a, b)
    if id_column.lower() in mapped.names:
        raise ValueError("column_mappings: the id column is kept as it is and can't be an alias")
    mapped.add(id_column, "id_column")
    for s in conf.get("substitution_columns", []):
        mapped.need(s["column_name"], "substitution_columns")
        for t in s.get("substitutions", []):
            if "substitution_file" not in t:
                raise ValueError("substitution_columns: substitution_file is missing")
            if "join_column" in t:
                mapped.need(t["join_column"], "substitution_columns")
    _selections(conf, mapped)
    _blocking(conf, mapped)
    features = _features(conf, mapped)
    for key in ("comparisons", "hh_comparisons"):
        for leaf in leaves(conf.get(key)):
            name = leaf.get("feature_name")
            if name is not None and name not in features:
                raise ValueError(f"{key}: no feature is named {name}")
    variables = set(features) | set(AGGREGATES) | set(HOUSEHOLD_AGGREGATES)
    for p in conf.get("pipeline_features", []):
        for n in p.get("input_columns") or [p["input_column"]]:
            if n not in variables:
                raise ValueError(f"pipeline_features: no feature is named {n}")
        if p["output_column"] in variables:
            raise ValueError(f"pipeline_features: {p['output_column']} is defined twice")
        variables.add(p["output_column"])
    for key in ("training", "hh_training"):
        section = conf.get(key)
        if section:
            for n in section.get("independent_vars", []):
                if n not in variables:
                    raise ValueError(f"{key}: no feature is named {n}")
            if "dataset" not in section or "dependent_var" not in section:
                raise ValueError(f"{key}: dataset and dependent_var are needed")
    wanted = conf.get("hh_matching", {}).get("records_to_match", "unmatched_only")
    if wanted not in ("unmatched_only", "all"):
        raise ValueError(f"hh_matching: records_to_match is unmatched_only or all, not {wanted}")


def _filters(conf, a: Columns, b: Columns) -> None:
    for f in conf.get("filter", []):
        if not f.get("expression") and not f.get("training_data_subset"):
            raise ValueError("filter: an expression or training_data_subset is needed")
        if f.get("datasource") not in (None, "a", "b"):
            raise ValueError(f"filter: datasource is a or b, not {f['datasource']}")
        if f.get("household"):
            for key, cols, side in (("serial_a", a, "a"), ("serial_b", b, "b")):
                if f.get("datasource") in (None, side):
                    if key not in f:
                        raise ValueError(f"filter: {key} is missing")
                    cols.need(f[key], "filter")


def _mappings(conf, a: Columns, b: Columns) -> Columns:
    out = Columns([])
    for m in conf["column_mappings"]:
        if "column_name" not in m:
            raise ValueError("column_mappings: column_name is missing")
        for side, cols in (("a", a), ("b", b)):
            if m.get(f"set_value_column_{side}") is None:
                name = m.get(f"override_column_{side}", m["column_name"])
                if name.lower() not in out.names:
                    cols.need(name, "column_mappings")
        for t in [*m.get("transforms", []), *m.get("override_transforms", [])]:
            if t.get("type") not in TRANSFORMS:
                raise ValueError(f"column_mappings: no transform is named {t.get('type')}")
        out.add(m.get("alias", m["column_name"]), "column_mappings")
    return out


def _selections(conf, cols: Columns) -> None:
    for s in conf.get("feature_selections", []):
        if s.get("transform") not in SELECTIONS:
            raise ValueError(f"feature_selections: no transform is named {s.get('transform')}")
        inputs = [s.get(k) for k in ("input_column", "input_col") if s.get(k)] + list(s.get("input_columns") or s.get("input_cols") or [])
        for n in inputs:
            cols.need(n, "feature_selections")
        out = s.get("output_column") or s.get("output_col")
        if not out:
            raise ValueError("feature_selections: output_column is missing")
        cols.add(out, "feature_selections")


def _blocking(conf, cols: Columns) -> None:
    for r in conf.get("blocking", []):
        if "column_name" not in r:
            raise ValueError("blocking: column_name is missing")
        if r.get("explode") and (r.get("expand_length") or r.get("dataset")):
            if not r.get("derived_from"):
                raise ValueError("blocking: derived_from is missing")
            cols.need(r["derived_from"], "blocking")
        else:
            cols.need(r["column_name"], "blocking")


def _features(conf, cols: Columns) -> list[str]:
    out: list[str] = []
    for f in conf.get("comparison_features", []):
        if "alias" not in f:
            raise ValueError("comparison_features: alias is missing")
        if f.get("comparison_type") not in FEATURES:
            raise ValueError(f"comparison_features: no comparison type is named {f.get('comparison_type')}")
        if f["alias"] in out:
            raise ValueError(f"comparison_features: {f['alias']} is defined twice")
        if f["comparison_type"] != "fetch_td":
            for n in referenced_columns(f):
                cols.need(n, f"comparison_features, {f['alias']}")
        out.append(f["alias"])
    return out
