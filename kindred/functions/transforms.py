"""Cleaning transforms of column mappings: each is a function from a Column and its settings to a Column.

All are null-safe under ANSI mode: casts that fail and elements that are missing give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS: dict[str, Callable[[Column, dict[str, Any], bool], Column]] = {}


def transform(name: str):
    def keep(f):
        TRANSFORMS[name] = f
        return f

    return keep


def _any_of(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


def _plain(name: str, build: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = lambda c, spec, is_a: build(c)


_plain("lowercase_strip", lambda c: F.lower(F.trim(c)))
_plain("rationalize_name_words", lambda c: F.regexp_replace(c, r"[^a-z?'*\-]+", " "))
_plain("remove_qmark_hyphen", lambda c: F.regexp_replace(c, r"[?*\-]+", ""))
_plain("remove_punctuation", lambda c: F.regexp_replace(c, r"""[?\-\\/"':,.\[\]{}]+""", ""))
_plain("replace_apostrophe", lambda c: F.regexp_replace(c, r"'+", " "))
_plain("remove_alternate_names", lambda c: F.regexp_replace(c, r"^(\w+) or .*$", "$1"))
_plain("condense_strip_whitespace", lambda c: F.regexp_replace(F.trim(c), r"\s\s+", " "))
_plain("remove_one_letter_names", lambda c: F.regexp_replace(c, r"^(?:\w )+", ""))
_plain("split", lambda c: F.split(c, " "))
_plain("length", lambda c: F.length(c))
_plain("cast_as_int", lambda c: c.try_cast("int"))
_plain("get_floor", lambda c: F.floor(c).try_cast("int"))


@transform("add_to_a")
def add_to_a(c, spec, is_a):
    return c + F.lit(spec["value"]) if is_a else c


@transform("concat_to_a")
def concat_to_a(c, spec, is_a):
    return F.concat(c, F.lit(spec["value"])) if is_a else c


@transform("concat_to_b")
def concat_to_b(c, spec, is_a):
    return c if is_a else F.concat(c, F.lit(spec["value"]))


@transform("concat_two_cols")
def concat_two_cols(c, spec, is_a):
    return F.concat(c, F.col(spec["column_to_append"]))


@transform("remove_suffixes")
def remove_suffixes(c, spec, is_a):
    return F.regexp_replace(c, rf"\s+(?:{_any_of(spec['values'])})\s*$", "")


@transform("remove_stop_words")
def remove_stop_words(c, spec, is_a):
    return F.regexp_replace(c, rf"\b(?:{_any_of(spec['values'])})\b", "")


@transform("remove_prefixes")
def remove_prefixes(c, spec, is_a):
    return F.regexp_replace(c, rf"^(?:{_any_of(spec['values'])}) ", "")


@transform("condense_prefixes")
def condense_prefixes(c, spec, is_a):
    return F.regexp_replace(c, rf"^({_any_of(spec['values'])}) ", "$1")


@transform("array_index")
def array_index(c, spec, is_a):
    return F.get(c, F.lit(int(spec["value"])))


@transform("mapping")
def mapping(c, spec, is_a):
    """Whole-value replacements, one after another, so that a later key can map what an earlier one made."""
    out = c.cast("string")
    for old, new in spec["mappings"].items():
        out = F.regexp_replace(out, f"^(?:{old})$", str(new))
    return out.try_cast("long") if spec.get("output_type") == "int" else out


@transform("swap_words")
def swap_words(c, spec, is_a):
    for old, new in spec["values"].items():
        c = F.regexp_replace(c, rf"(?<![^\s]){re.escape(old)}(?![^\s])", new)
    return c


@transform("substring")
def substring(c, spec, is_a):
    values = spec["values"]
    if len(values) != 2:
        raise ValueError(f"substring takes a start and a length, not {values}")
    return F.substring(c, int(values[0]), int(values[1]))


@transform("expand")
def expand(c, spec, is_a):
    n = int(spec["value"])
    x = c.try_cast("int")
    return F.sequence(x - n, x + n)


@transform("divide_by_int")
def divide_by_int(c, spec, is_a):
    return F.try_divide(c.try_cast("int"), F.lit(int(spec["value"])))


@transform("when_value")
def when_value(c, spec, is_a):
    return F.when(c.try_cast("int") == int(spec["value"]), F.lit(spec["if_value"])).otherwise(F.lit(spec["else_value"]))


def apply_transform(column: Column, spec: dict[str, Any], is_a: bool) -> Column:
    """The column after one transform; ValueError for an unknown type."""
    try:
        build = TRANSFORMS[spec["type"]]
    except KeyError:
        raise ValueError(f"no transform is named {spec.get('type')!r}") from None
    return build(column, spec, is_a)
