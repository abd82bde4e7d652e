"""Row filters from nested specifications.

A leaf is [column, op, value] or [column, op, value, options]; a list of specifications means all of them; {"all": [...]}, {"any": [...]}
and {"not": spec} combine. Missing values (null or NaN) fail every test but `!=`, `not in` and `isna`.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if df.schema[name].dataType.simpleString() in ("double", "float") else c.isNull()


def _leaf(df: DataFrame, leaf: list) -> tuple[Column, str]:
    if len(leaf) not in (2, 3, 4) or not isinstance(leaf[0], str):
        raise ValueError(f"not a leaf: {leaf!r}")
    name, op, value, options = (*leaf, *[None] * (4 - len(leaf)))
    if name not in df.columns:
        raise KeyError(name)
    options, c, missing = options or {}, F.col(f"`{name}`"), _missing(df, name)
    text = f"`{name}` {op} {value!r}"
    compare = {"==": lambda: c == value, "<": lambda: c < value, ">": lambda: c > value, "<=": lambda: c <= value, ">=": lambda: c >= value}
    if op in compare:
        return ~missing & F.coalesce(compare[op](), F.lit(False)), text
    if op == "!=":
        return missing | F.coalesce(c != value, F.lit(True)), text
    if op in ("in", "not in"):
        inside = ~missing & F.coalesce(c.isin(value if isinstance(value, (list, tuple, set)) else [value]), F.lit(False))
        return (inside if op == "in" else ~inside), text
    if op == "between":
        low, high = value
        closed = options.get("inclusive", "both")
        if closed not in ("both", "neither", "left", "right"):
            raise ValueError(f"inclusive: {closed!r}")
        left = c >= low if closed in ("both", "left") else c > low
        right = c <= high if closed in ("both", "right") else c < high
        return ~missing & F.coalesce(left & right, F.lit(False)), text
    if op in ("isna", "notna"):
        return (missing if op == "isna" else ~missing), text
    if op in ("contains", "startswith", "endswith", "regex"):
        absent = F.lit(bool(options.get("na", False)))
        if op == "startswith":
            got = c.startswith(value)
        elif op == "endswith":
            got = c.endswith(value)
        elif op == "regex" or options.get("regex", True):
            got = c.rlike(("" if options.get("case", True) else "(?i)") + value)
        else:
            got = c.contains(value) if options.get("case", True) else F.lower(c).contains(value.lower())
        return F.coalesce(got, absent), text
    raise ValueError(f"unknown op: {op!r}")


def compile_spec(df: DataFrame, spec: Any) -> tuple[Column, str]:
    """(condition, text) of a specification; KeyError for an unknown column, ValueError for anything that isn't a specification."""
    if isinstance(spec, dict):
        if len(spec) != 1 or (key := next(iter(spec))) not in ("all", "any", "not"):
            raise ValueError(f"not a specification: {spec!r}")
        if key == "not":
            c, text = compile_spec(df, spec["not"])
            return ~c, f"not ({text})"
        parts = [compile_spec(df, x) for x in spec[key]]
        if not parts:
            raise ValueError(f"empty {key}")
        join = (lambda a, b: a & b) if key == "all" else (lambda a, b: a | b)
        return reduce(join, (c for c, _ in parts)), f" {'and' if key == 'all' else 'or'} ".join(f"({t})" for _, t in parts)
    if isinstance(spec, (list, tuple)):
        if not spec:
            raise ValueError("empty specification")
        return _leaf(df, list(spec)) if isinstance(spec[0], str) else compile_spec(df, {"all": list(spec)})
    raise ValueError(f"not a specification: {spec!r}")


def filter_by_spec(df: DataFrame, spec: Any) -> tuple[DataFrame, DataFrame, str]:
    """(rows that pass, all rows with their boolean `mask`, the specification as text)."""
    condition, text = compile_spec(df, spec)
    return df.where(condition), df.withColumn("mask", condition), text
