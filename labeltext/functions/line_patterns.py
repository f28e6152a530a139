"""Line patterns: name -> function of Columns returning a Column.

``register_pattern`` adds one; no Python code runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labeltext.fixed_values import LINE_PATTERNS, PAIR_SEPARATOR

_PATTERNS: dict[str, Callable[..., Column]] = {}


def register_pattern(name: str, pattern: str | Callable[..., Column]) -> None:
    """Register a ``{}`` pattern or a function of Columns under ``name``."""
    if callable(pattern):
        _PATTERNS[name] = pattern
        return
    literals = pattern.split("{}")

    def fill(*values: Column) -> Column:
        if len(values) != len(literals) - 1:
            raise ValueError(f"pattern {name} takes {len(literals) - 1} values, got {len(values)}")
        parts = [F.lit(literals[0])]
        for value, literal in zip(values, literals[1:]):
            parts += [value, F.lit(literal)]
        return F.concat(*parts)

    _PATTERNS[name] = fill


def apply_pattern(name: str, *values: Column) -> Column:
    """The line a registered pattern makes of the given Columns."""
    if name not in _PATTERNS:
        raise ValueError(f"unknown pattern {name!r}; known: {sorted(_PATTERNS)}")
    return _PATTERNS[name](*values)


def single_line_pair(source: Column, target: Column) -> Column:
    """Source and target on one line."""
    return F.concat(source, F.lit(PAIR_SEPARATOR), target)


for _name, _pattern in LINE_PATTERNS.items():
    register_pattern(_name, _pattern)
