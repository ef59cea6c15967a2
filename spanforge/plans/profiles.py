"""Profiles of scoped records, audits of samples, and the map in one year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.numbers import wilson
from spanforge.operators import aggregates, windows


def scoped_profile(records: DataFrame, scope: str, kept: str, operator: str, year: str, amount: str) -> dict[str, DataFrame]:
    """Counts by scope reason over all records, and profiles of those in scope by operator and by year."""
    inside = records.filter(F.col(scope) == kept)
    return {
        "scope_counts": records.groupBy(scope).agg(F.count("*").alias("n")),
        "by_operator": aggregates.profile(inside, aggregates.labelled(operator, "Unattributed"), F.col(amount)),
        "by_year": aggregates.profile(inside.filter(F.col(year).isNotNull()), F.col(year), F.col(amount)),
    }


def audit_scores(judged: DataFrame, verdict: str, domain: tuple[str, ...], correct: str, strata: tuple[str, ...]) -> DataFrame:
    """(stratum, value, good, n, low, high) by each stratum and over all; verdicts off the domain are left out of n."""
    known = judged.filter(F.col(verdict).isin(*domain))
    parts = F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), *(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata))
    counts = known.select(verdict, F.explode(parts).alias("p")).groupBy("p.stratum", "p.value").agg(F.count_if(F.col(verdict) == correct).alias("good"), F.count("*").alias("n"))
    low, high = wilson(F.col("good"), F.col("n"))
    return counts.withColumn("low", low).withColumn("high", high)


def year_map(spans: DataFrame, entity: str, holder: str, start: str, end: str, order: str, year: Column, most: int = 8) -> DataFrame:
    """(entity, label): who holds each entity in a year; contested ones and all but the largest holders under labels of their own."""
    covered = (F.year(start) <= year) & (F.coalesce(F.year(end), F.lit(9999)) >= year)
    now = windows.handoff_or_contested(spans.filter(covered), entity, holder, start, end, order)
    counts = now.filter("NOT contested").groupBy("holder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "holder").limit(most).select(F.col("holder").alias("top"))
    named = now.join(F.broadcast(counts), F.col("holder") == F.col("top"), "left")
    return named.select(entity, F.when(F.col("contested"), "Contested").otherwise(F.coalesce("top", F.lit("Other"))).alias("label"))


def place_values(entities: DataFrame, zone: str, value: str, cuts: list[float]) -> DataFrame:
    """(zone, value, bin): one value for each zone, then its bin by fixed cuts; a zone without a value has none."""
    from spanforge.functions.numbers import bucket_of

    first = entities.groupBy(zone).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("ord"))).alias(value))
    return first.withColumn("bin", bucket_of(F.col(value), cuts))




def verdict_report(rows: DataFrame, verdict: str, known: Sequence[str], correct: str, undecided: Sequence[str] = ()) -> DataFrame:
    """(kind, verdict, n) of an audit's rows, so that each row is accounted for.

    ``correct``, ``failure`` (each failure mode by name), ``undecided``, ``unfilled`` where nothing is written, and
    ``unrecognised`` for verdicts that are not known, each as it was written.
    """
    said = F.trim(F.col(verdict))
    kind = F.when(F.coalesce(said, F.lit("")) == "", "unfilled").when(~said.isin(*known), "unrecognised").when(said == correct, "correct").when(said.isin(*undecided), "undecided").otherwise("failure")
    return rows.select(kind.alias("kind"), F.when(kind != "unfilled", said).alias("verdict")).groupBy("kind", "verdict").agg(F.count("*").alias("n"))
