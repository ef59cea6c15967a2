"""Labels written over lines, read by a table function that carries state along a document's lines.

``Name: value`` begins a label; lines that begin with a blank go on with it; an empty line ends it. The first value of a
label counts. A body label ends the labels: what follows, from its own value on, is the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from spanforge.session import bounded_batches, importable

LABEL = re.compile(r"([A-Za-z][A-Za-z /-]{0,40}?)\s*:\s*(.*)")
BODY = frozenset(["body", "text", "full text"])
SCHEMA = StructType([StructField(c, StringType()) for c in ("document", "label", "value")] + [StructField(c, IntegerType()) for c in ("first_line", "n_lines")])


class LabelledLines:
    """The labels of documents given as rows (document, line_no, line); Spark deals rows by document and orders them by number.

    One row for each label, in the order of their lines; the body, if there is one, is a row of label ``body``.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in lines.dataType]
        if names != ["document", "line_no", "line"]:
            raise ValueError(f"the table must have document, line_no and line, not {names}")
        return AnalyzeResult(SCHEMA, partitionBy=[PartitioningColumn("document")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.found: dict[str, tuple[int, list[str]]] = {}
        self.now: list[str] | None = None
        self.document: str | None = None
        self.body: list[str] | None = None
        self.body_line = 0

    def eval(self, lines: Row) -> None:
        self.document = lines["document"]
        self.add(lines["line_no"], lines["line"] or "")

    def add(self, number: int, line: str) -> None:
        if self.body is not None:
            self.body.append(line)
            return
        if line[:1] in " \t":  # no label; also the empty line
            more = line.strip()
            if not more:
                self.now = None
            elif self.now is not None:
                self.now.append(more)
            return
        match = LABEL.fullmatch(line)
        if match:
            name, value = match[1].lower(), match[2].strip()
            if name in BODY:
                self.body, self.body_line, self.now = [value] if value else [], number, None
                return
            self.now = None
            if name not in self.found:
                self.now = [value]
                self.found[name] = number, self.now
        elif not line.strip():
            self.now = None

    def terminate(self) -> Iterator[tuple]:
        for name, (number, parts) in self.found.items():
            yield self.document, name, " ".join(parts).strip(), number, len(parts)
        if self.body is not None:
            yield self.document, "body", "\n".join(self.body).strip(), self.body_line, len(self.body)


def labels(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(document, label, value, first_line, n_lines) for rows (document, line_no, line)."""
    importable(spark)
    read = F.udtf(LabelledLines)
    return read(lines.select(F.col("document").cast("string").alias("document"), F.col("line_no").cast("int").alias("line_no"), F.col("line").cast("string").alias("line")).asTable())


def labels_of(texts: DataFrame, document: str, text: str) -> DataFrame:
    """What ``labels`` gives over ``lines_of`` packed texts, each row a document of its own.

    A text's lines lie together in their order already, so they are read where they are: no row for each line, no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for own, body in zip(frame["document"], frame["text"], strict=True):
                read = LabelledLines()
                read.document = own
                for number, line in enumerate(body.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                    read.add(number, line)
                rows += read.terminate()
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=SCHEMA.names)
                    rows = []
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    importable(texts.sparkSession)
    bounded_batches(texts.sparkSession)
    return texts.select(F.col(document).cast("string").alias("document"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL").mapInPandas(run, SCHEMA)


def lines_of(texts: DataFrame, document: str, text: str) -> DataFrame:
    """(document, line_no, line) for packed texts, numbered from 0."""
    return texts.select(F.col(document).cast("string").alias("document"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("line_no", "line"))
