"""File sources: JSON, CSV exports, vintage tables, folders, snapshots, packed documents."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.dates import flexible_date
from spanforge.functions.documents import file_to_text
from spanforge.functions.hashing import content_id
from spanforge.functions.numbers import coded_number


class SchemaDrift(ValueError):
    """A source lacks columns that it is declared to have."""


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array file; a missing file has no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def first_lines(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Each file's first line, read by one job with a task for each file; files without a line are left out."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                if frame["start"].iat[0] == 0:
                    yield frame[["path", "value"]].iloc[:1]
                return  # what is behind the first line is not read

    # a partition holds one split, so that each file's beginning is the beginning of a task
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        return {r.path: r.value for r in lines.mapInPandas(first, "path string, value string").collect()}
    finally:
        spark.conf.set(key, before)


def by_header(spark: SparkSession, pattern: str, required: Sequence[str], **options) -> list[DataFrame]:
    """One table of strings for each header among the files of a pattern: Spark takes one header for all that it reads at once.

    The first lines of all files are read by one job. A header that a single line does not settle (an open quotation, names
    that are empty or repeated, or none) is left to Spark's reader, file by file. A file without a required column raises.
    Names are trimmed of a byte-order mark.
    """
    lines = first_lines(spark, pattern)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(spark.read.text(pattern).inputFiles()):
        names = next(csv.reader([lines.get(path, "").removeprefix("\ufeff")], delimiter=options.get("sep", ",")), [])
        columns = tuple(c.strip() for c in names)
        if path not in lines or lines[path].count('"') % 2 or "" in columns or len(set(columns)) < len(columns) or columns != tuple(names):
            columns = tuple(c.removeprefix("\ufeff") for c in spark.read.options(header=True, **options).csv(path).columns)
        missing = [c for c in required if c not in columns]
        if missing:
            raise SchemaDrift(f"{path}: missing columns: {', '.join(missing)}")
        layouts.setdefault(columns, []).append(path)
    read = lambda columns, paths: spark.read.options(header=True, **options).schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(paths)
    return [read(columns, paths) for columns, paths in layouts.items()]


def row_count(spark: SparkSession, pattern: str) -> int:
    """Data rows of CSV files that are not loaded otherwise; a pattern without files has none."""
    try:
        return spark.read.options(header=True, multiLine=True, escape='"').csv(pattern).count()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0


def feature_collection(spark: SparkSession, path: str, properties: T.StructType | str) -> DataFrame:
    """(lng, lat, *properties) of a GeoJSON file's point features; other geometries have no point."""
    kind = properties if isinstance(properties, str) else properties.simpleString().removeprefix("struct<").removesuffix(">")
    schema = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{kind}>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return features.select(point[0].alias("lng"), point[1].alias("lat"), "f.properties.*")


def all_of(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def csv_exports(spark: SparkSession, pattern: str, required: Sequence[str]) -> DataFrame:
    """All CSV files of a pattern as strings, blanks null, with the file each row is from; columns may stand in any order."""
    blanks = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in required]
    file = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file")
    return all_of([df.select(*blanks, file) for df in by_header(spark, pattern, required, multiLine=True, escape='"')])


def vintage_table(spark: SparkSession, pattern: str, columns: dict[str, str], key: str = "GEO_ID", year_in_name: str = r"5Y(\d{4})") -> DataFrame:
    """Yearly tables, each by its own header: the year from the file name, the place from the key's last five digits, the
    label row skipped, few columns read, coded cells as numbers."""
    place = F.regexp_extract(key, r"US(\d{5})$", 1)
    year = F.regexp_extract("_metadata.file_name", year_in_name, 1).try_cast("int")
    cells = [coded_number(F.col(f"`{c}`")).alias(name) for c, name in columns.items()]
    return all_of([df.filter(place != "").select(year.alias("year"), place.alias("place"), *cells) for df in by_header(spark, pattern, [key, *columns])])


def registered_tables(spark: SparkSession, root: str, registry: dict[str, str], format_: str = "parquet") -> dict[str, DataFrame]:
    """Name to table for declared folders; a folder that is missing raises."""
    return {name: spark.read.format(format_).load(f"{root}/{folder}") for name, folder in registry.items()}


def snapshot(df: DataFrame, path: str, query: str, fetched_at: str) -> dict:
    """Write a source's rows with a manifest of the query, their number and their digest; return the manifest."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    # a sum: independent of the order of rows, and repeated rows count
    row = written.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*written.columns).cast("decimal(20,0)")).alias("x")).first()
    manifest = {"query": query, "rows": row.n, "digest": f"{int(row.x or 0) % (1 << 64):016x}", "fetched_at": fetched_at}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/manifest").first().value)


def collected_files(spark: SparkSession, folder: str, suffixes: Sequence[str], ignored: Sequence[str] = (".DS_Store",)) -> DataFrame:
    """Every file below a folder as (path, name, length, content, sha256, outcome): copied, duplicate (of a smaller path) or skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("name"), "length", "content", F.sha2("content", 256).alias("sha256")).filter(~F.col("name").isin(*ignored))
    wanted = F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes)
    first = F.min("path").over(W.partitionBy("sha256", wanted))
    return files.withColumn("outcome", F.when(~wanted, "skipped").when(F.col("path") != first, "duplicate").otherwise("copied"))


def texts_of(files: DataFrame) -> DataFrame:
    """(path, sha256, text, error) of copied files."""
    kept = files.filter("outcome = 'copied'").withColumn("_read", file_to_text(F.col("name"), F.col("content")))
    return kept.select("path", "sha256", "_read.text", "_read.error")


MARKER = r"(?m)^\s*(?:Document \d+ of \d+|\d+ of \d+ DOCUMENTS)\s*$"


def split_documents(texts: DataFrame, key: str, text: str, marker: str = MARKER, least: int = 200) -> DataFrame:
    """(key, position, offset, block, kept): the parts of packed files between marker lines; short ones are tagged, not dropped.

    ``offset`` is the place of the block's first character in the text.
    """
    whole, size = F.col(text), lambda x: F.length(x).cast("long")
    marks = F.regexp_extract_all(whole, F.lit(f"({marker})"), F.lit(1))
    # a part begins behind the parts and the markers before it
    ends = lambda pieces: F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + size(x))))
    parts = texts.select(key, F.split(whole, marker).alias("_parts"), marks.alias("_marks"))
    parts = parts.select(key, F.posexplode("_parts").alias("position", "_part"), ends(F.col("_parts")).alias("_before"), ends(F.col("_marks")).alias("_marked"))
    block = F.regexp_replace("_part", r"^\s+|\s+$", "")
    begin = F.get("_before", F.col("position")) + F.get("_marked", F.col("position")) + F.length(F.regexp_extract("_part", r"^\s*", 0))
    return parts.select(key, "position", begin.alias("offset"), block.alias("block"), (F.length(block) >= least).alias("kept"))


def split_at_links(texts: DataFrame, key: str, text: str, link: str = r"^\s*https?://\S+\s*$", edge: str = r"\|\s*$", least: int = 200) -> DataFrame:
    """(key, position, offset, block, kept) of packed files without markers, whose documents each hold a line with their link.

    A document begins behind the last line above its link that ends the document before (``edge``), or at the text's start.
    """
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_no", "_line"))
    order = W.partitionBy(key).orderBy("_no")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.length("_line").cast("long") + 1).over(so_far), F.lit(0).cast("long"))
    edges = F.coalesce(F.max(F.when(F.col("_line").rlike(edge), F.col("_no") + 1)).over(so_far), F.lit(0))
    placed = lines.select(key, "_no", "_line", place.alias("_at"), edges.alias("_edge"))
    starts = placed.filter(F.col("_line").rlike(link)).select(key, F.col("_edge").alias("_no")).distinct()
    begun = placed.join(starts.withColumn("_begins", F.lit(1)), [key, "_no"], "left")
    numbered = begun.withColumn("position", F.sum(F.coalesce("_begins", F.lit(0))).over(order) - 1).filter("position >= 0")
    joined = numbered.groupBy(key, F.col("position").cast("int").alias("position")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_line"))), lambda x: x["_line"]), "\n").alias("_part"), F.min("_at").alias("_at"))
    block = F.regexp_replace("_part", r"^\s+|\s+$", "")
    begin = F.col("_at") + F.length(F.regexp_extract("_part", r"^\s*", 0))
    return joined.select(key, "position", begin.alias("offset"), block.alias("block"), (F.length(block) >= least).alias("kept"))


LABELS = {"title": r"(?mi)^(?:headline|title)\s*:\s*(.+)$", "publication": r"(?mi)^(?:publication|source)\s*:\s*(.+)$", "date_raw": r"(?mi)^(?:date|load-date|publication date)\s*:\s*(.+)$"}


def parse_documents(blocks: DataFrame, block: str) -> DataFrame:
    """Add title, publication, date, body and problems: labels where written, else the first lines in order."""
    lines = F.filter(F.transform(F.split(F.col(block), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    label = lambda name: F.nullif(F.trim(F.regexp_extract(block, LABELS[name], 1)), F.lit(""))
    line = lambda k: F.get(lines, F.lit(k))
    body = F.trim(F.regexp_extract(block, r"(?si)^(?:body|full text|text)\s*:\s*(.+)$|^.*?\n(?:body|full text|text)\s*:\s*(.+)$", 2))
    out = blocks.withColumn("title", F.coalesce(label("title"), line(1), line(0))).withColumn("publication", F.coalesce(label("publication"), line(0)))
    out = out.withColumn("date_raw", F.coalesce(label("date_raw"), line(2))).withColumn("date", flexible_date(F.regexp_replace("date_raw", r"\s+\w+day$", "")))
    rest = F.array_join(F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0))), "\n")
    out = out.withColumn("body", F.coalesce(F.nullif(body, F.lit("")), F.nullif(rest, F.lit(""))))
    problems = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("title", "publication", "date", "body")]
    return out.withColumn("problems", F.array_compact(F.array(*problems))).withColumn("article_id", content_id("ar-", 12, F.col("title"), F.col("date_raw"), F.col("body")))


def inline_entry(entry: Column) -> Column:
    """``Name | City, ST | YEAR`` as a struct; parts may be missing."""
    parts = F.transform(F.split(entry, r"\|"), lambda x: F.trim(x))
    place = F.split(F.get(parts, F.lit(1)), r",\s*")
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(place, F.lit(0)).alias("city"), F.get(place, F.lit(1)).alias("state"), F.get(parts, F.lit(2)).try_cast("int").alias("year"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One lower-case word per line, letters only."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).distinct()


def spreadsheet(spark: SparkSession, path: str, sheet: str, columns: Sequence[str]) -> DataFrame:
    """A worksheet whose header must be as declared, with each row's number; needs openpyxl. Workbooks are small, read on the driver."""
    try:
        import openpyxl
    except ImportError:
        raise NotImplementedError("openpyxl is not installed") from None
    rows = list(openpyxl.load_workbook(path, read_only=True)[sheet].iter_rows(values_only=True))
    if list(rows[0][: len(columns)]) != list(columns):
        raise SchemaDrift(f"header of {sheet} is {rows[0]}")
    data = [(k, *(None if x is None or str(x).strip() == "" else str(x).strip() for x in row[: len(columns)])) for k, row in enumerate(rows[1:], 2)]
    return spark.createDataFrame([r for r in data if any(x is not None for x in r[1:])], ", ".join(["sheet_row int", *(f"{c} string" for c in columns)]))


