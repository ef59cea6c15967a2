"""Tagging operators: rows get a decision; none is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """The tag of the first rule that holds; a rule whose condition is null does not."""
    chain = F.when(F.lit(False), None)
    for condition, tag in rules:
        chain = chain.when(condition, F.lit(tag))
    return chain.otherwise(F.lit(otherwise))


def keyword_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None) -> Column:
    """The first class any of whose needles occurs in the text."""
    lowered = F.lower(text)
    return first_match([(_any(lowered.contains(n) for n in needles), name) for name, needles in rules], otherwise)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def prefix_class(code: Column, exact: dict[str, Sequence[str]], prefixes: dict[str, Sequence[str]], otherwise: str | None) -> Column:
    rules = [(code.isin(*codes), name) for name, codes in exact.items()]
    rules += [(_any(code.startswith(p) for p in starts), name) for name, starts in prefixes.items()]
    return first_match(rules, otherwise)


def all_match(items: Column, pattern: str) -> Column:
    """Whether there are items and every one matches."""
    return (F.size(items) > 0) & F.forall(items, lambda x: x.rlike(pattern))


def all_in(items: Column, words: Sequence[str]) -> Column:
    return F.forall(items, lambda x: x.isin(*words))


def split_by_tag(df: DataFrame, tag: str, kept: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the tag ``kept`` and the others, as a side output."""
    return df.filter(F.col(tag) == kept), df.filter(~F.col(tag).eqNullSafe(F.lit(kept)))


def band_filter(df: DataFrame, value: str, cuts: Sequence[float], wanted: Sequence[int]) -> DataFrame:
    """Add ``band`` and ``state``: matched, unknown (no value) or out; unknown rows are kept for the caller to add back."""
    from spanforge.functions.numbers import bucket_of

    band = bucket_of(F.col(value), cuts)
    return df.withColumn("band", band).withColumn("state", F.when(F.col("band").isNull(), "unknown").when(F.col("band").isin(*wanted), "matched").otherwise("out"))


def faceted_counts(df: DataFrame, facet: str, others: Column) -> DataFrame:
    """(facet, total, n): rows per value that pass the other facets' filters, zero where none do."""
    return df.groupBy(facet).agg(F.count("*").alias("total"), F.count_if(others).alias("n"))


def render_window(start: Column, end: Column, known_through: Column, status: Column) -> tuple[Column, Column]:
    """Years in which a span is drawn: to its end, open if ongoing, to the last evidence if unknown; none without a start."""
    low = F.year(start)
    high = F.when(status == "ended", F.year(end)).when(status == "ongoing", F.lit(9999)).otherwise(F.year(F.coalesce(known_through, start)))
    return low, F.when(low.isNotNull(), high)
