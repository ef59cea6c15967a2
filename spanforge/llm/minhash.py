"""Near-duplicates by circulant MinHash: banding, then exact Jaccard verification.

Two permutations give a whole signature: the first scatters the shingles over a ring, the second, shifted by k along the
ring, gives coordinate k. Documents that agree in a band become candidates; links are confirmed on the full shingle sets.

Documents with equal sets, by two 64-bit names, are one class from the start. A bucket is compared inside tasks, and only
a spanning forest leaves the task; what the forests connect is verified together on the full sets, largest agreement
first, and a pair that is connected already needs no test. A large bucket or group is first compared with one of its
members: those near it are its star and need no comparison among themselves, so only the others are compared block by
block. No link between different sets is skipped other than by the banding itself (missed with a chance of about 1e-7 at
the threshold) or by an agreement more than 4.75 standard deviations too low.

Defined results: a null or blank text has an empty set and is linked with nothing; equal rows are linked; a null id takes
part, and its component is the smallest id reached, null if there is none; an empty table gives no rows; a text of any
length has one set of all its shingles; columns other than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, drop_path, release, shared_path, stored, stored_at, table
from spanforge.llm.components import connected_components
from spanforge.llm.hashing import BASE, U, by_bytes, mix, shingle_sets

ROWS_PER_BAND, BANDS = 5, 28
COORDINATES = ROWS_PER_BAND * BANDS
#: Classes compared at once in a task; larger buckets and groups are compared block against block.
BLOCK = 600
#: Bytes of their sets, about.
BLOCK_BYTES = 8 << 20
#: Classes with more rows than this share of all, and than this number, meet their result by a broadcast of at most 1 / HOT rows.
HOT, HOT_ROWS = 1e-4, 1_000


def circulant_signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COORDINATES values per non-empty set."""
    ring = mix(shingles ^ U(0x5851F42D4C957F2D))  # the first permutation
    starts = offsets[:-1][np.diff(offsets) > 0]
    rows = np.empty((COORDINATES, len(starts)), np.uint64)
    for k in range(COORDINATES):
        rows[k] = np.minimum.reduceat(mix(ring + U(k)), starts)  # the second, shifted by k
    return rows.T


def bands_of(signatures: np.ndarray) -> np.ndarray:
    grouped = signatures.reshape(len(signatures), BANDS, ROWS_PER_BAND)
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None] * U(BASE), len(signatures), axis=0)
    for k in range(ROWS_PER_BAND):
        keys = mix(keys * U(3) + grouped[:, :, k])
    return keys


def text_key(text: str) -> Column:
    """Tells rows with equal or no ids apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, cid, twin, bands, signature): ``cid`` and ``twin`` name the set; null where it is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            for low, high in by_bytes(texts, 1 << 18):
                shingles, offsets = shingle_sets([t.encode().lower() for t in texts[low:high]], width)
                sizes = np.diff(offsets)
                full = sizes > 0
                names, twins, bands, coded = ([None] * (high - low) for _ in range(4))
                if full.any():
                    signatures = circulant_signatures(shingles, offsets)
                    starts = offsets[:-1][full]
                    summed = np.add.reduceat(mix(shingles + U(BASE)), starts) + sizes[full].astype(np.uint64)
                    second = np.add.reduceat(mix(shingles ^ U(0x2545F4914F6CDD1D)), starts)
                    own = zip(np.flatnonzero(full).tolist(), mix(summed).view(np.int64).tolist(), mix(second).view(np.int64).tolist(), bands_of(signatures).view(np.int64), (signatures >> U(56)).astype(np.uint8), strict=True)
                    for k, name, twin, keys, coordinates in own:
                        names[k], twins[k], bands[k], coded[k] = name, twin, keys, coordinates.tobytes()
                yield pd.DataFrame({"doc_id": frame["doc_id"].array[low:high], "text_key": frame["text_key"].array[low:high], "n_shingles": sizes, "cid": pd.array(names, "Int64"), "twin": pd.array(twins, "Int64"), "bands": bands, "signature": coded})

    return docs.select("doc_id", "text", text_key("text")).mapInPandas(run, "doc_id long, text_key long, n_shingles long, cid long, twin long, bands array<long>, signature binary")


def _forest(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], linked) -> list[tuple[int, int]]:
    """Tested edges that connect what can be connected; ``linked(i, j)`` is asked only for what is not yet connected."""
    label, edges = np.arange(len(ids)), []
    for one, other in pairs:
        apart = label[one] != label[other]
        for i, j in zip(one[apart].tolist(), other[apart].tolist(), strict=True):
            a, b = label[i], label[j]
            if a != b and linked(i, j):
                label[label == b] = a
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as ``percent`` says."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def agreeing_pairs(signatures: np.ndarray, least: int, left: np.ndarray | None = None, sizes: np.ndarray | None = None, share: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with ``least`` equal coordinates, most equal first; only pairs across blocks where ``left`` marks the first block."""
    found = []
    for i in range(len(signatures) - 1):
        if left is not None and not left.all() and left.any():
            others = np.flatnonzero(left != left[i])
            others = others[others > i]
        else:
            others = np.arange(i + 1, len(signatures))
        if sizes is not None:
            others = others[np.minimum(sizes[others], sizes[i]) >= share * np.maximum(sizes[others], sizes[i])]
        equal = (signatures[others] == signatures[i]).sum(axis=1, dtype=np.uint16)
        keep = equal >= least
        if keep.any():
            found.append((equal[keep].astype(np.uint8), np.full(keep.sum(), i, np.uint16), others[keep].astype(np.uint16)))
    if found:
        # a close pair of blocks has a million pairs: small numbers, handed on a few at a time
        equal, one, other = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(255 - equal, kind="stable").astype(np.uint32)
        for k in range(0, len(order), 1 << 12):
            part = order[k : k + (1 << 12)]
            yield one[part], other[part]


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """Repeat rows (group, cid, star, weight) for the pairs of blocks to compare; add ``pair`` and ``first`` (in the pair's first block).

    The rows of a group's star are linked already, so they meet only the others; these meet each other, too. A group that
    hangs together closely is all star, and its rows are repeated a few times at most.
    """
    star, weight = F.col("star"), F.col("weight")
    some = lambda own: F.greatest(F.ceil(F.count_if(own) / BLOCK), F.ceil(F.sum(F.when(own, weight).otherwise(0)) / BLOCK_BYTES)).cast("int")
    totals = rows.groupBy(group).agg(some(star).alias("_stars"), some(~star).alias("_others"))
    joined = rows.join(totals, group).withColumn("_own", F.pmod(F.xxhash64("cid"), F.greatest(F.when(star, F.col("_stars")).otherwise(F.col("_others")), F.lit(1))).cast("int"))
    own, kind = F.col("_own"), "array<struct<across:boolean,low:int,high:int>>"
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda across, low, high: F.struct(F.lit(across).alias("across"), low.alias("low"), high.alias("high"))
    across = F.transform(numbers(F.when(star, F.col("_others")).otherwise(F.col("_stars"))), lambda o: place(True, F.when(star, own).otherwise(o), F.when(star, o).otherwise(own)))
    within = F.when(star, F.array().cast(kind)).otherwise(F.transform(numbers(F.col("_others")), lambda o: place(False, F.least(o, own), F.greatest(o, own))).cast(kind))
    repeated = joined.withColumn("_x", F.explode(F.concat(across.cast(kind), within)))
    first = F.when(F.col("_x.across"), star).otherwise(own == F.col("_x.low"))
    return repeated.withColumn("pair", F.xxhash64(group, "_x.across", "_x.low", "_x.high")).withColumn("first", first).drop("_own", "_x", "_stars", "_others", "star", "weight")


def _around_pivots(rows: DataFrame, group: str, held: str, near: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Compare the rows of large groups with one of them each: (rows with ``star``, edges of the stars).

    ``rows`` has group, cid, weight and ``held``, what ``near`` tests. Small groups have no star.
    """
    first = F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("_p")
    totals = rows.groupBy(group).agg(F.count("*").alias("_n"), F.sum("weight").alias("_w"), first)
    large = totals.filter((F.col("_n") > BLOCK) | (F.col("_w") > 2 * BLOCK_BYTES)).select(group, F.col("_p.cid").alias("pivot"))
    # written, so that the joins deal both sides anew and can split a group that is everywhere
    pivots = stored(large.join(rows.select(group, F.col("cid").alias("pivot"), F.col(held).alias("_held")), [group, "pivot"]), "pivots")
    if not pivots.limit(1).count():
        return rows.withColumn("star", F.lit(False)), rows.select(F.col("cid").alias("a"), F.col("cid").alias("b")).filter("false")
    small = rows.join(pivots.select(group), group, "left_anti").withColumn("star", F.lit(False))
    tested = stored(rows.join(pivots, group).withColumn("star", near(F.col(held), F.col("_held"))).drop("_held"), "stars")
    edges = tested.filter("star AND cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    return small.unionByName(tested.drop("pivot")), edges


def _in_bins(rows: DataFrame, per_bin: int, size: str | None = None) -> DataFrame:
    """Add ``bin``: so many that each holds about ``per_bin`` rows, and BLOCK_BYTES of the ``size`` column."""
    total = rows.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.octet_length(size)), F.lit(0)) if size else F.lit(0)).alias("w")).first()
    return rows.withColumn("bin", F.pmod(F.col("pair"), F.lit(max(1, total.n // per_bin + 1, total.w // BLOCK_BYTES + 1))))


def candidate_groups(classes: DataFrame, least: int) -> DataFrame:
    """(cid, grp): classes connected by bucket neighbours of enough agreement."""
    rows = classes.select("cid", F.explode("bands").alias("key"))
    # buckets with the same members are compared once
    buckets = rows.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("cid").alias("x"), F.bit_xor(F.xxhash64("cid")).alias("y")).filter("m > 1")
    buckets = buckets.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
    path = shared_path(classes.sparkSession, "bucket-members")
    members = stored_at(rows.join(buckets, "key").join(classes.select("cid", "signature"), "cid").withColumn("weight", F.lit(COORDINATES)), path)

    @F.pandas_udf("boolean")
    def agree(own: pd.Series, pivot: pd.Series) -> pd.Series:
        return pd.Series([p is not None and int((np.frombuffer(x, np.uint8) == np.frombuffer(p, np.uint8)).sum()) >= least for x, p in zip(own, pivot, strict=True)], dtype=bool)

    starred, edges = _around_pivots(members, "key", "signature", agree)
    blocks = checkpoint(_blocks(starred, "key").select("cid", "signature", "pair", "first"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, part in frame.sort_values(["pair", "cid"]).groupby("pair", sort=False):
            ids, first = part["cid"].to_numpy(), part["first"].to_numpy()
            signatures = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(len(part), -1)
            edges += _forest(ids, agreeing_pairs(signatures, least, first), lambda i, j: True)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    found = _in_bins(blocks, 500).groupBy("bin").applyInPandas(compare, "a long, b long")
    groups = connected_components(found.unionByName(edges))
    drop_path(classes.sparkSession, path)  # the components are checkpointed
    return groups.select(F.col("node").alias("cid"), F.col("component").alias("grp"))


def shared_names(sketched: DataFrame) -> DataFrame:
    """The first names that sets with different second names share: hardly ever there are any."""
    pairs = sketched.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("twin").alias("low"), F.max("twin").alias("high"))
    return stored(pairs.filter("low <> high").select("cid", F.lit(True).alias("shared")), "shared-names")


def told_apart(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """Sets of shared first names get names of their own from both."""
    if not shared.limit(1).count():
        return sets.drop("twin")
    return sets.join(shared, "cid", "left").withColumn("cid", F.when(F.col("shared"), F.xxhash64("cid", "twin")).otherwise(F.col("cid"))).drop("twin", "shared")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): text_key, n_shingles, component_id, the smallest doc_id that links reach, and grp, null for empty sets.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word shingles.
    """
    share = percent / 100
    least = int(COORDINATES * (share - 4.75 * (share * (1 - share) / COORDINATES) ** 0.5))
    sketched = stored(sketch(docs, width), "sketch")
    shared = shared_names(sketched)
    sketched = told_apart(sketched, shared)
    classes = sketched.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    groups = checkpoint(candidate_groups(classes, least))
    # one text for each class to be verified
    carriers = groups.join(classes.select("cid", "least_id", "signature"), "cid")
    holders = carriers.select(F.col("least_id").alias("holder")).distinct()
    texts = docs.select("doc_id", "text").join(holders, docs["doc_id"].eqNullSafe(holders["holder"]), "left_semi")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = ["" if t is None else t for t in frame["text"]]
            for low, high in by_bytes(kept, 1 << 18):
                shingles, offsets = shingle_sets([t.encode().lower() for t in kept[low:high]], width)
                full = np.diff(offsets) > 0
                names = twins = np.zeros(0, np.int64)
                if full.any():
                    starts = offsets[:-1][full]
                    summed = np.add.reduceat(mix(shingles + U(BASE)), starts) + np.diff(offsets)[full].astype(np.uint64)
                    names, twins = mix(summed).view(np.int64), mix(np.add.reduceat(mix(shingles ^ U(0x2545F4914F6CDD1D)), starts)).view(np.int64)
                yield pd.DataFrame({"cid": names, "twin": twins, "shingles": [shingles[a:b].tobytes() for a, b in zip(offsets[:-1][full], offsets[1:][full], strict=True)]})

    @F.pandas_udf("boolean")
    def similar(own: pd.Series, pivot: pd.Series) -> pd.Series:
        return pd.Series([p is not None and _linked(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64), percent) for x, p in zip(own, pivot, strict=True)], dtype=bool)

    spark = docs.sparkSession
    known = told_apart(texts.mapInPandas(sets, "cid long, twin long, shingles binary"), shared).groupBy("cid").agg(F.first("shingles").alias("shingles"))
    sets_path, members_path = shared_path(spark, "sets"), shared_path(spark, "members")
    held = stored_at(carriers.select("cid", "grp", "signature").join(known, "cid").withColumn("weight", F.octet_length("shingles")), sets_path)
    release(spark)
    starred, star_edges = _around_pivots(held, "grp", "shingles", similar)
    members = stored_at(_blocks(starred, "grp").select("cid", "signature", "pair", "first", "shingles"), members_path)
    release(spark)

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, part in frame.sort_values(["pair", "cid"]).groupby("pair", sort=False):
            ids, first = part["cid"].to_numpy(), part["first"].to_numpy()
            signatures = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(len(part), -1)
            own = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            sizes = np.array([len(x) for x in own])

            edges += _forest(ids, agreeing_pairs(signatures, least, first, sizes, share - 1e-9), lambda i, j, own=own: _linked(own[i], own[j], percent))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    edges = _in_bins(members, 300, "shingles").groupBy("bin").applyInPandas(verify, "a long, b long")
    found = connected_components(edges.unionByName(star_edges))
    for path in (members_path, sets_path):  # the components are checkpointed
        drop_path(spark, path)
    labelled = classes.select("cid", "least_id", "copies").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "cid"))
    least_ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least_ids, "component")
    named = stored(named.select("cid", "component_id", F.col("component").alias("grp"), "copies"), "named")
    # a set that many rows have must not gather them in one task: such sets are few and go to the rows
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(HOT_ROWS, total * HOT)
    columns = [F.coalesce("component_id", "doc_id").alias("component_id"), "grp"]
    rows = sketched.select("doc_id", "text_key", "n_shingles", "cid")
    often, seldom = named.filter(hot).drop("copies"), named.filter(~hot).drop("copies")
    placed = rows.join(F.broadcast(often), "cid", "left")
    first = placed.filter("grp IS NOT NULL").select("doc_id", "text_key", "n_shingles", *columns)
    rest = placed.filter("grp IS NULL").drop("component_id", "grp").join(seldom, "cid", "left")
    return first.unionByName(rest.select("doc_id", "text_key", "n_shingles", *columns))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id; rows without words all stay."""
    found = near_duplicates(docs, width, percent)
    first = found.filter("grp IS NOT NULL").groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_key").alias("kept_key"))
    empty = found.filter("grp IS NULL").select(F.col("text_key").alias("kept_key")).distinct()
    # the row travels as one column, so that its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key("text").alias("kept_key"), F.col("doc_id").alias("kept_id"))
    wordless = keyed.join(empty, "kept_key", "left_semi")
    chosen = keyed.join(kept, (keyed["kept_key"] == kept["kept_key"]) & keyed["kept_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    # of equal rows one stays
    order = Window.partitionBy("kept_key", "kept_id").orderBy(F.lit(0))
    chosen = chosen.withColumn("row_no", F.row_number().over(order)).filter("row_no = 1").drop("row_no")
    return chosen.unionByName(wordless).select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over three-word shingles at a similarity of 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    found = found.select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
