"""Date columns. Dates that are not dates become null; nothing raises."""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
#: How far two dates of a precision may differ and still be the same, in days; any other precision has the default.
TOLERANCE = {"exact": 31, "month": 62, "year": 366, "approx": 731}
DEFAULT_TOLERANCE = 366
PRECISION_RANK = {"exact": 0, "month": 1, "year": 2, "approx": 3}


def iso_date(text: Column) -> Column:
    """A date of exactly ``YYYY-MM-DD``; shorter forms are null, not the first of the month."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def flexible_date(text: Column) -> Column:
    """``Month D, YYYY``, ``D Month YYYY``, ISO or ``M/D/YYYY``; the first form that gives a date of the calendar."""
    text = F.trim(text)

    def form(pattern: str, rebuilt: str, format_: str) -> Column:
        return F.when(text.rlike(pattern), F.try_to_date(F.initcap(F.regexp_replace(text, pattern, rebuilt)), format_))

    return F.coalesce(
        form(r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4})$", "$1 $2 $3", "MMM d yyyy"),
        form(r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.? (\d{4})$", "$2 $1 $3", "MMM d yyyy"),
        iso_date(text),
        form(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$1 $2 $3", "M d yyyy"),
    )


MONTH_NAMES = [calendar.month_name[k].lower() for k in range(1, 13)]
#: Whole names, their first three letters, and the one abbreviation of four.
MONTH_WORDS = {w: k for k, name in enumerate(MONTH_NAMES, 1) for w in (name, name[:3])} | {"sept": 9}
ORDINALS = ("st", "nd", "rd", "th")
#: A run of letters or of digits is a token; what stands between two tokens is a gap.
TOKEN = "[A-Za-z]+|[0-9]+"


class _Words:
    """A text's tokens by place: gap k stands before token k."""

    def __init__(self, split: Column):
        self.tokens, self.gaps = split["tokens"], split["gaps"]

    @staticmethod
    def read(text: Column, what: Callable[[_Words], Column]) -> Column:
        """What is to be read from a text's tokens. The text is split once: a lambda's variable is not computed again."""
        months = F.create_map(*[F.lit(x) for item in MONTH_WORDS.items() for x in item])
        classed = lambda t: F.struct(t.alias("t"), F.try_element_at(months, t).alias("month"), t.cast("string").rlike("^[0-9]").alias("number"), F.length(t).alias("n"))
        tokens = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), classed)
        split = F.struct(tokens.alias("tokens"), F.split(text, TOKEN, -1).alias("gaps"))
        return F.get(F.transform(F.array(split), lambda x: what(_Words(x))), F.lit(0))

    def gap(self, k: Column, pattern: str) -> Column:
        return F.get(self.gaps, k).rlike(pattern)

    def number(self, k: Column, least: int, most: int) -> Column:
        token = F.get(self.tokens, k)
        return token["number"] & token["n"].between(least, most)

    def value(self, k: Column) -> Column:
        return F.get(self.tokens, k)["t"]

    def month(self, k: Column) -> Column:
        return F.get(self.tokens, k)["month"]

    def ordinal(self, k: Column) -> Column:
        """1 where token k ends the number before it (3rd), else 0."""
        return F.when(self.gap(k, "^$") & self.value(k).isin(*ORDINALS), 1).otherwise(0)

    def alone(self, first: Column, last: Column) -> Column:
        """Whether no letter, digit or underline touches the stretch from token to token."""
        n = F.size(self.tokens)
        before = (first == 0) & ~self.gap(first, r"[\p{L}\p{N}_]$") | (first > 0) & self.gap(first, r"[^\p{L}\p{N}_]$")
        after = (last == n - 1) & ~self.gap(last + 1, r"^[\p{L}\p{N}_]") | (last < n - 1) & self.gap(last + 1, r"^[^\p{L}\p{N}_]")
        return before & after

    def found(self, at: Column) -> Column:
        """The date written from a token on, as (rank of its form, place, year, month, day); null if none is."""
        day_at = at + 1
        year_at = day_at + 1 + self.ordinal(day_at + 1)
        month_first = self.month(at).isNotNull() & self.gap(day_at, r"^\.?\s+$") & self.number(day_at, 1, 2) & self.gap(year_at, r"^,?\s+$") & self.number(year_at, 4, 4) & self.alone(at, year_at)
        month_at = at + 1 + self.ordinal(at + 1)
        day_first = self.number(at, 1, 2) & self.gap(month_at, r"^\s+$") & self.month(month_at).isNotNull() & self.gap(month_at + 1, r"^\.?,?\s+$") & self.number(month_at + 1, 4, 4) & self.alone(at, month_at + 1)
        between = lambda sign: self.gap(at + 1, f"^{sign}$") & self.gap(at + 2, f"^{sign}$") & self.alone(at, at + 2)
        iso = self.number(at, 4, 4) & self.number(at + 1, 2, 2) & self.number(at + 2, 2, 2) & between("-")
        slashes = self.number(at, 1, 2) & self.number(at + 1, 1, 2) & self.number(at + 2, 4, 4) & between("/")
        of = lambda rank, y, m, d: F.struct(F.lit(rank).alias("rank"), at.alias("at"), y.alias("y"), m.cast("string").alias("m"), d.alias("d"))
        return (
            F.when(month_first, of(0, self.value(year_at), self.month(at), self.value(day_at)))
            .when(day_first, of(1, self.value(month_at + 1), self.month(month_at), self.value(at)))
            .when(iso, of(2, self.value(at), self.value(at + 1), self.value(at + 2)))
            .when(slashes, of(3, self.value(at + 2), self.value(at), self.value(at + 1)))
        )

    def places(self) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(self.tokens) - 1, F.lit(0)))


def date_within(text: Column) -> Column:
    """The first date written in a text: a month's name before or behind the day, else ISO, else ``M/D/YYYY``.

    Days may be ordinals and commas may be missing; a month is a whole name or its abbreviation. The best form found
    decides, of equals the first: a day that its month does not have, or a month without a day, is no date.
    """
    best = _Words.read(text, lambda words: F.array_min(F.array_compact(F.transform(words.places(), words.found))))
    return F.try_to_date(F.concat_ws("-", best["y"], best["m"], best["d"]), "yyyy-M-d")


def month_only(text: Column) -> Column:
    """Whether a text names a month and a year but no date: reported, never filled in."""
    def at(words: _Words) -> Callable[[Column], Column]:
        return lambda k: F.coalesce(words.month(k).isNotNull() & words.gap(k + 1, r"^\.?\s+$") & words.number(k + 1, 4, 4) & words.alone(k, k + 1), F.lit(False))

    named = _Words.read(text, lambda words: F.exists(words.places(), at(words)))
    return date_within(text).isNull() & F.coalesce(named, F.lit(False))


def knowledge_base_date(text: Column) -> Column:
    """``+YYYY-MM-DDT…`` where month or day 00 means unknown and becomes 01; year 0000 is null."""
    part = lambda k: F.regexp_extract(text, r"^\+?(\d{4})-(\d{2})-(\d{2})", k)
    fixed = lambda x: F.when(x == "00", "01").otherwise(x)
    return F.when(text.rlike(r"^\+?\d{4}-\d{2}-\d{2}") & (part(1) != "0000"), F.try_to_date(F.concat_ws("-", part(1), fixed(part(2)), fixed(part(3))), "yyyy-MM-dd"))


def year_of(text: Column) -> Column:
    """The year that a date text begins with."""
    return F.substring(text, 1, 4).try_cast("int")


def precision_consistent(date: Column, precision: Column) -> Column:
    """A year is written as January 1, a month as its first day."""
    return F.when(precision == "year", (F.month(date) == 1) & (F.day(date) == 1)).when(precision == "month", F.day(date) == 1).otherwise(F.lit(True))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def tolerance_days(precision: Column, table: dict[str, int] = TOLERANCE, otherwise: int = DEFAULT_TOLERANCE) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), precision), F.lit(otherwise))


def recent(date: Column, as_of: Column, days: int = 3 * 365) -> Column:
    return F.datediff(as_of, date) <= days


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def covers(start_year: Column, end_year: Column, year: Column) -> Column:
    """A span without a start covers nothing; one without an end goes on."""
    return F.coalesce((start_year <= year) & (F.coalesce(end_year, F.lit(9999)) >= year), F.lit(False))


def plausible_in(opened: Column, closed: Column, year: Column) -> Column:
    """Unknown opening and closing years count as open."""
    return (F.coalesce(opened, F.lit(-9999)) <= year) & (F.coalesce(closed, F.lit(9999)) >= year)


def plausible_as(opened: Column, closed: Column, alias_start: Column, alias_end: Column, year: Column) -> Column:
    """Open in a year under a name of its own years; what is not known does not count against it."""
    return plausible_in(opened, closed, year) & plausible_in(alias_start, alias_end, year)
