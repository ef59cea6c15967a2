"""Rules of the declared records as tables of implications, for ``validate.problems``.

A row of a table reads: where the first condition holds, the second must, or the row has the problem. Conditions are SQL
over the default column names; ``names`` gives others. What a condition cannot tell, for a value is missing, breaks no rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, str]
Implication = tuple[str, str, str]
# fixed values
LAST_OLDER_YEAR, OLDER_VINTAGE, NEWER_VINTAGE = 2020, 2010, 2020
MEASURES = ("workers_total", "median_household_income", "transit_share", "long_commute_share")
SHARES = ("transit_share", "long_commute_share")


def written(column: str) -> str:
    return f"trim(coalesce(CAST({{{column}}} AS STRING), '')) <> ''"


def day(column: str) -> str:
    """The first ten characters where they are a written date."""
    return f"regexp_extract(trim(CAST({{{column}}} AS STRING)), '^([0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}})', 1)"


def dated(column: str, precision: str) -> list[Implication]:
    """A year is written as its January 1, a month as its first day."""
    known = f"{day(column)} <> '' AND {{{precision}}}"
    return [
        (f"{known} = 'year'", f"{day(column)} LIKE '%-01-01'", f"{column}: precision year but not January 1"),
        (f"{known} = 'month'", f"{day(column)} LIKE '%-01'", f"{column}: precision month but not the first"),
    ]


#: The earlier date does not come later.
IN_ORDER: Implication = (f"{written('start_date')} AND {written('end_date')}", "substr({start_date}, 1, 10) <= substr({end_date}, 1, 10)", "end_date: before start_date")

EVENT: list[Implication] = [
    *dated("event_date", "date_precision"),
    ("NOT coalesce({needs_review}, false)", written("event_date"), "event_date: missing, and not for review"),
]
TENURE: list[Implication] = [
    *dated("start_date", "start_precision"),
    *dated("end_date", "end_precision"),
    ("{end_status} = 'ended'", written("end_date"), "end_status: ended without an end_date"),
    (written("end_date"), "{end_status} NOT IN ('ongoing', 'unknown')", "end_status: not ended but an end_date"),
    (written("exit_mode"), "{end_status} <=> 'ended'", "exit_mode: only where ended"),
    IN_ORDER,
]
OPERATOR_KNOWN = "trim(coalesce({operator_relation}, '')) NOT IN ('', 'unknown')"
AWARD: list[Implication] = [
    ("{in_scope}", "{scope_reason} <=> 'in_scope'", "in_scope: kept against its reason"),
    ("{scope_reason} = 'in_scope'", "coalesce({in_scope}, false)", "in_scope: left out against its reason"),
    (written("venue_id"), "coalesce({in_scope}, false)", "venue_id: on a row out of scope"),
    ("true", f"({{venue_match}} <=> 'unmatched') <> ({written('venue_id')})", "venue_match: disagrees with venue_id"),
    (OPERATOR_KNOWN, "NOT {scope_reason} <=> 'operator_unresolved'", "scope_reason: unresolved, but the operator is known"),
    ("{in_scope}", OPERATOR_KNOWN, "in_scope: kept with an unknown operator"),
    IN_ORDER,
]
VINTAGE: list[Implication] = [
    (f"{written('zcta')} AND {{year}} IS NOT NULL", f"{{zcta_vintage}} <=> IF({{year}} <= {LAST_OLDER_YEAR}, {OLDER_VINTAGE}, {NEWER_VINTAGE})", "zcta_vintage: not that of its year"),
    (written("zcta"), "NOT {zcta_match} <=> 'no_zcta'", "zcta_match: no_zcta but a zcta"),
    (f"{{zcta_vintage}} = {OLDER_VINTAGE}", "{zcta_match} <> '2020_only'", "zcta_match: 2020_only in the older vintage"),
    (f"{{zcta_vintage}} = {NEWER_VINTAGE}", "{zcta_match} <> '2010_only'", "zcta_match: 2010_only in the newer vintage"),
    *((written(m), written("zcta"), f"{m}: without a zcta") for m in MEASURES),
    *(("true", f"{{{s}}} BETWEEN 0 AND 1", f"{s}: outside 0 to 1") for s in SHARES),
    ("true", "{workers_total} >= 0", "workers_total: negative"),
    ("{transit_share} IS NOT NULL", "coalesce({workers_total}, 0) <> 0", "transit_share: without workers"),
]


def broken(table: list[Implication], **names: str) -> list[Rule]:
    """(condition, problem) for each row of a table."""
    columns = {c: f"`{names.get(c, c)}`" for when, then, _ in table for c in re.findall(r"\{(\w+)\}", f"{when} {then}") if not c.isdigit()}
    return [(F.expr(f"coalesce({when.format_map(columns)}, false) AND NOT coalesce({then.format_map(columns)}, true)"), problem) for when, then, problem in table]


def of_event(**names: str) -> list[Rule]:
    return broken(EVENT, **names)


def of_tenure(**names: str) -> list[Rule]:
    return broken(TENURE, **names)


def of_award(**names: str) -> list[Rule]:
    """An award after scoping and the join to places: the flag, its reason, the operator and the place must agree."""
    return broken(AWARD, **names)


def of_vintage(**names: str) -> list[Rule]:
    """A place's figures of one year: the vintage follows from the year, and figures need a place and a denominator."""
    return broken(VINTAGE, **names)
