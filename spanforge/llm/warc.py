"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own. The members of a task are packed into chunks, which
start and end at members; a chunk is a row of a table in the shared folder (concatenated in order, an archive's chunks are
a valid .warc.gz file). The index sorts captures by reversed-host URL key into compressed blocks and keeps a sparse
directory with the first key of each block; a lookup searches the directory, then the block, then reads one byte range:
only blocks and chunks that hold what is looked up are read.

Defined results: a null html is an empty payload; a null or odd url is kept as it is and sorts under its own text;
records with equal payloads of at least ``least_bytes`` bytes are one response (the largest page_id) and revisits of it;
rows with equal page_id and payload are all written and all read back, with the same type; no rows give no archives; a
payload of any length is one record, compressed in chunks; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import shared_path, stored, table

CHUNK_BYTES = 1 << 20
#: The directory, which every task searches, has so many rows at most; blocks grow beyond that.
DIRECTORY_ROWS = 50_000
BLOCK_ENTRIES = 3_000
#: Blocks or chunks that a lookup names to the scan, at most.
PUSHED_NAMES = 1_000
#: Digests of more records than this share of the repeated ones, and than this number, go to the pages by a broadcast of at most 1 / HOT rows.
HOT, HOT_ROWS = 1e-4, 1_000
CRLF = "\r\n"


def url_key(url: Column) -> Column:
    """The host's labels reversed, then port and path: ``http://www.a.org/x`` is ``org,a,www)/x``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/:?#]*)", 1))
    tail = F.substring(rest, F.length(host) + 1, F.lit(1 << 30))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add payload, payload_bytes, sha1 (hex), ``refers_to`` (null for a response) by the digests that occur more than once.

    Digests that a notable share of the pages has are few: they go to the pages, so those pages do not meet in one task.
    """
    digests = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    digests = digests.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    repeated = digests.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    repeated = stored(repeated, "warc-repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(HOT_ROWS, total * HOT)
    placed = digests.join(F.broadcast(repeated.filter(often).select("sha1", F.col("response").alias("often"))), "sha1", "left")
    seldom = placed.filter("often IS NULL").join(repeated.filter(~often).select("sha1", "response"), "sha1", "left").drop("often")
    typed = seldom.unionByName(placed.filter("often IS NOT NULL").withColumnRenamed("often", "response"))
    revisit = (F.col("page_id") < F.col("response")) & (F.col("payload_bytes") >= least_bytes)
    return typed.withColumn("refers_to", F.when(revisit, F.col("response"))).drop("response")


def target_uri(url: str | None) -> str:
    """A URI of the url: what a URI may not hold is written in per cents; no scheme, or no url, makes it a ``urn:page:``."""
    quoted = quote(url or "", safe="%!#$&'()*+,/:;=?@[]~-._")
    return quoted if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", quoted) else f"urn:page:{quoted}"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record of the id ``name``: a response holds an HTTP head and the payload, a revisit only the head.

    The page's id, the url where its URI differs, and the full payload's length stand in fields of their own.
    """
    http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]).encode()
    block = http + payload if refers_to is None else http
    uri = target_uri(url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Id: {page_id}",
        f"Page-Payload-Length: {len(payload)}",
        *([f"Page-Url: {json.dumps(url)}"] if url != uri else []),
    ]
    if refers_to is not None:
        head += [f"Page-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(head).encode() + block + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """The fields of a gzip member's record; a response's digest is taken anew from its payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    _, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x == "None" else int(x)
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": number(fields["Page-Id"]),
        "url": json.loads(fields["Page-Url"]) if "Page-Url" in fields else fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("Page-Refers-To")),
        "payload": payload if response else None,
        "payload_bytes": len(payload) if response else int(fields["Page-Payload-Length"]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write chunk rows (name, data, entries) and return the table as read back.

    ``name`` is archive and number of the chunk; ``entries`` lists its captures: key, page_id, offset and length in the chunk.
    """
    spark, space = records.sparkSession, uuid.uuid5(uuid.NAMESPACE_URL, path)
    keyed = records.withColumn("key", url_key(F.col("url")))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        archive = f"{TaskContext.get().partitionId():06d}"
        data, entries, chunk, n = bytearray(), [], 0, 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"{archive}-{chunk:06d}"], "data": [bytes(data)], "entries": [json.dumps(entries)]})

        for frame in frames:
            for page_id, url, payload, sha1, refers_to, key in zip(frame["page_id"], frame["url"], frame["payload"], frame["sha1"], frame["refers_to"], frame["key"], strict=True):
                own = None if pd.isna(page_id) else int(page_id)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                name, n = str(uuid.uuid5(space, f"{archive}/{n}")), n + 1
                member = gzip.compress(record(name, own, url, payload, digest, None if pd.isna(refers_to) else int(refers_to)), 2, mtime=0)
                if data and len(data) + len(member) > CHUNK_BYTES:
                    yield flush()
                    data, entries, chunk = bytearray(), [], chunk + 1
                entries.append((key, own, len(data), len(member)))
                data += member
        if entries:
            yield flush()

    chosen = keyed.select("page_id", "url", "payload", "sha1", "refers_to", "key")
    chosen.mapInPandas(pack, "name string, data binary, entries string").write.parquet(path)
    return spark.read.schema("name string, data binary, entries string").parquet(path)


def captures(archives: DataFrame) -> DataFrame:
    """(key, page_id, name, offset, length) of every record."""
    entries = F.from_json(F.regexp_replace("entries", r"^$", "[]"), "array<array<string>>")
    return archives.select("name", F.explode(entries).alias("e")).select(
        F.col("e")[0].alias("key"), F.col("e")[1].cast("long").alias("page_id"), "name", F.col("e")[2].cast("long").alias("offset"), F.col("e")[3].cast("long").alias("length")
    )


def entry_order(key: str, page_id: float | None) -> tuple:
    return key, page_id is not None and page_id == page_id, page_id or 0


def write_index(found: DataFrame, path: str) -> DataFrame:
    """Sort captures by (key, page_id) and write compressed blocks (block, first_key, n, data); return the table as read back."""
    n = found.count()
    size = max(BLOCK_ENTRIES, -(-n // DIRECTORY_ROWS))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        lines: list[tuple] = []
        number = 0

        def flush(part: list[tuple]) -> pd.DataFrame:
            name = f"{TaskContext.get().partitionId():06d}-{number:06d}"
            return pd.DataFrame({"block": [name], "first_key": [part[0][0]], "first_id": [part[0][1]], "n": [len(part)], "data": [zlib.compress("\n".join(map(json.dumps, part)).encode(), 6)]})

        for frame in frames:
            ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
            lines += zip(frame["key"], ids, frame["name"], map(int, frame["offset"]), map(int, frame["length"]), strict=True)
            while len(lines) >= size:
                yield flush(lines[:size])
                lines, number = lines[size:], number + 1
        if lines:
            yield flush(lines)

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("name"), F.col("offset")]
    schema = "block string, first_key string, first_id long, n int, data binary"
    found.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(build, schema).write.parquet(path)
    return found.sparkSession.read.schema(schema).parquet(path)


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Find the captures of (key, page_id) rows: (page_id, name, offset, length) for every entry with that key and id.

    The directory has DIRECTORY_ROWS rows and a few per task at most; a key's block, and those after it while they begin
    with the same key and id, hold its entries.
    """
    rows = index.select("first_key", "first_id", "block").collect()
    rows = sorted((*entry_order(r.first_key, r.first_id), r.block) for r in rows)
    directory = queries.sparkSession.sparkContext.broadcast(rows)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = [r[:3] for r in directory.value]
        for frame in frames:
            out = []
            for key, page_id in zip(frame["key"], frame["page_id"], strict=True):
                own = entry_order(key, None if pd.isna(page_id) else int(page_id))
                low, high = max(bisect.bisect_left(firsts, own) - 1, 0), bisect.bisect_right(firsts, own)
                out += [(key, page_id, directory.value[k][3]) for k in range(low, max(high, min(low + 1, len(firsts))))]
            yield pd.DataFrame(out, columns=["key", "page_id", "block"]).astype({"page_id": "Int64"})

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in blocks["data"]:
            entries = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            order = [entry_order(e[0], e[1]) for e in entries]
            for key, page_id in zip(wanted["key"], wanted["page_id"], strict=True):
                own = entry_order(key, None if pd.isna(page_id) else int(page_id))
                for k in range(bisect.bisect_left(order, own), bisect.bisect_right(order, own)):
                    out.append(entries[k][1:])
        return pd.DataFrame(out, columns=["page_id", "name", "offset", "length"]).astype({"page_id": "Int64"})

    routed = stored(queries.mapInPandas(route, "key string, page_id long, block string"), "routed")
    blocks = only(index.select("block", "data"), "block", routed)
    return routed.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(search, "page_id long, name string, offset long, length long")


def only(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows whose name is wanted. Up to PUSHED_NAMES names go to the scan, which then reads the pages that hold them; beyond
    that most of the table is wanted, and it is joined as it is."""
    names = wanted.select(name).distinct().limit(PUSHED_NAMES + 1).collect()
    return rows.filter(F.col(name).isin([r[name] for r in names])) if len(names) <= PUSHED_NAMES else rows


def read_records(ranges: DataFrame, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Read each byte range and parse its record; ``payloads`` adds url and payload."""

    def read(wanted: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in chunks["data"]:
            for offset, length in zip(wanted["offset"], wanted["length"], strict=True):
                out.append(parse_record(data[int(offset) : int(offset) + int(length)]))
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
        return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    ranges = stored(ranges, "ranges")
    chunks = only(archives.select("name", "data"), "name", ranges)
    return ranges.groupBy("name").cogroup(chunks.groupBy("name")).applyInPandas(read, schema)


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write every page, build the index, look every page up and read its record back."""
    spark = pages.sparkSession
    archives = write_archives(with_record_types(pages), shared_path(spark, "warc"))
    index = write_index(captures(archives), shared_path(spark, "warc-index"))
    wanted = pages.select(url_key(F.col("url")).alias("key"), "page_id").distinct()
    return read_records(lookup(wanted, index), archives, payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to the archives, found through the index and read back."""
    return archive_and_read(table(spark, sf_dir, "pages"))
