"""Field specifications, and the problems and repairs they give."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column of a declared table. Kinds: str, enum, date, bool, number, list."""

    name: str
    kind: str
    required: bool = False
    values: tuple[str, ...] = ()
    note: str = ""


KINDS = {"str": T.StringType(), "enum": T.StringType(), "date": T.DateType(), "bool": T.BooleanType(), "number": T.DoubleType(), "list": T.ArrayType(T.StringType())}
JSON_KINDS = {"str": "string", "enum": "string", "date": "string", "bool": "boolean", "number": "number", "list": "array"}


def struct_type(fields: Sequence[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, KINDS[f.kind], True, {"required": f.required, "values": list(f.values), "note": f.note}) for f in fields])


def json_schema(fields: Sequence[Field]) -> dict:
    """A closed JSON schema of the fields."""
    properties: dict[str, dict] = {}
    for f in fields:
        entry: dict = {"type": JSON_KINDS[f.kind] if f.required else [JSON_KINDS[f.kind], "null"]}
        if f.values:
            entry["enum"] = [*f.values, *([] if f.required else [None])]
        if f.kind == "list":
            entry["items"] = {"type": "string"}
        properties[f.name] = entry | ({"description": f.note} if f.note else {})
    return {"type": "object", "properties": properties, "required": [f.name for f in fields], "additionalProperties": False}


def blank(value: Column) -> Column:
    """Null, or nothing but white space."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def problems(df: DataFrame, fields: Sequence[Field], rules: Sequence[tuple[Column, str]] = ()) -> Column:
    """An array of problem texts: missing required values, values off their list, malformed dates, unknown columns, broken rules.

    A blank value is missing where it is required and no further problem; elsewhere it is none.
    """
    found = []
    for f in fields:
        c, text, empty = F.col(f.name), F.trim(F.col(f.name).cast("string")), blank(F.col(f.name))
        if f.required:
            found.append((empty, f"{f.name}: missing"))
        if f.values:
            found.append((~empty & ~c.cast("string").isin(*f.values), f"{f.name}: not in list"))
        if f.kind == "date":
            found.append((~empty & ~F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{f.name}: not a date"))
    known = {f.name for f in fields}
    found += [(F.lit(True), f"{c}: unknown field") for c in df.columns if c not in known]
    return F.array_compact(F.array(*(F.when(condition, F.lit(text)) for condition, text in [*found, *rules])))


def repaired(df: DataFrame, repairs: Sequence[tuple[str, Column, Column, str]]) -> DataFrame:
    """Columns set where a condition holds: (column, condition, value, note); ``repairs`` lists the notes of what was done."""
    notes = F.array_compact(F.array(*(F.when(condition, F.lit(note)) for _, condition, _, note in repairs)))
    out = df.withColumn("repairs", notes)
    for column, condition, value, _ in repairs:
        out = out.withColumn(f"_new_{column}", F.when(condition, value).otherwise(F.col(column)))
    for column, *_ in repairs:
        out = out.withColumn(column, F.col(f"_new_{column}")).drop(f"_new_{column}")
    return out


def flagged(reasons: Column, condition: Column, reason: str) -> Column:
    """A reason appended once where the condition holds."""
    return F.when(condition, F.array_union(reasons, F.array(F.lit(reason)))).otherwise(reasons)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"missing_{c}") for c in columns))
