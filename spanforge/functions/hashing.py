"""Content-derived identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(prefix: str, size: int, *parts: Column) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the parts joined by ``|``; null parts are empty."""
    seed = F.array_join(F.array(*(p.cast("string") for p in parts)), "|", "")
    return F.concat(F.lit(prefix), F.substring(F.sha2(seed, 256), 1, size))


def payload_hash(names: Sequence[str]) -> Column:
    """SHA-256 of named columns as JSON in the order of their names, for caches keyed by content: the same request has one key however it is put together."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)
