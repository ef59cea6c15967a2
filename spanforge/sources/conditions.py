"""Conditions that a scan hands to its source: (column, operator, value) triples, all of which must hold.

A source may answer a condition loosely (return more rows); the scan applies all of them exactly above the source.
Conditions travel as an option of the scan. Spark's own push-down for Python sources is left off: in 4.1 a filter once
pushed stays with the DataFrame's source and drops rows from its other uses.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple[str, str, object]
#: Operators with what they do to a column and to a value that is not null.
OPERATORS: dict[str, tuple[Callable[[Column, object], Column], Callable[[object, object], bool]]] = {
    "=": (lambda c, v: c == v, lambda x, v: x == v),
    "<": (lambda c, v: c < v, lambda x, v: x < v),
    "<=": (lambda c, v: c <= v, lambda x, v: x <= v),
    ">": (lambda c, v: c > v, lambda x, v: x > v),
    ">=": (lambda c, v: c >= v, lambda x, v: x >= v),
    "in": (lambda c, v: c.isin(list(v)), lambda x, v: x in v),
    "starts": (lambda c, v: c.startswith(v), lambda x, v: x.startswith(v)),
    "ends": (lambda c, v: c.endswith(v), lambda x, v: x.endswith(v)),
    "contains": (lambda c, v: c.contains(v), lambda x, v: v in x),
    "is null": (lambda c, v: c.isNull(), lambda x, v: False),
    "is not null": (lambda c, v: c.isNotNull(), lambda x, v: True),
}


def packed(conditions: Sequence[Condition]) -> str:
    """Conditions as an option's text; dates as ISO strings."""
    for column, operator, _ in conditions:
        if operator not in OPERATORS:
            raise ValueError(f"{column}: unknown operator {operator!r}; known are {sorted(OPERATORS)}")
    plain = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else [plain(x) for x in v] if isinstance(v, (list, tuple, set, frozenset)) else v
    return json.dumps([[c, o, plain(v)] for c, o, v in conditions])


def unpacked(text: str | None) -> list[Condition]:
    return [tuple(x) for x in json.loads(text or "[]")]


def exactly(conditions: Sequence[Condition]) -> Column:
    """The conditions as Spark evaluates them."""
    return reduce(Column.__and__, [OPERATORS[o][0](F.col(f"`{c}`"), v) for c, o, v in conditions], F.lit(True))


def holds(condition: Condition, value: object) -> bool:
    """Whether a decoded value may meet a condition; dates are compared as ISO strings."""
    _, operator, wanted = condition
    if value is None:
        return operator == "is null"
    return OPERATORS[operator][1](value.isoformat() if isinstance(value, dt.date) else value, wanted)


def quoted(value: object) -> str:
    """A literal of standard SQL."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _like(column: str, before: str, value: object, after: str) -> str:
    """Without regard to case, so at least what the exact condition gives."""
    escaped = str(value).upper().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"upper({column}) LIKE {quoted(before + escaped + after)} ESCAPE '\\'"


def as_sql(condition: Condition) -> str:
    """A condition for a server; conditions on texts may let more rows through than the exact one."""
    column, operator, value = condition
    name = '"' + column.replace('"', '""') + '"'
    if operator in ("is null", "is not null"):
        return f"{name} {operator.upper()}"
    if operator == "in":
        return f"{name} IN ({', '.join(map(quoted, value))})" if value else "1 = 0"
    patterns = {"starts": ("", "%"), "ends": ("%", ""), "contains": ("%", "%")}
    if operator in patterns:
        # upper() of a server may know ASCII only: other texts are not handed over
        return _like(name, patterns[operator][0], value, patterns[operator][1]) if str(value).isascii() else "1 = 1"
    return f"{name} {operator} {quoted(value)}"
