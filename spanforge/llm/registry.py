"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import pipeline
from spanforge.llm.classlm import op9_class_lm
from spanforge.llm.divergence import SQL as DIVERGENCE_SQL
from spanforge.llm.divergence import op12_divergence
from spanforge.llm.htmlmain import op13_main_text
from spanforge.llm.kmeanstree import op5_neighbours
from spanforge.llm.language import op7_language
from spanforge.llm.minhash import op10_near_duplicates
from spanforge.llm.mixing import op4_mixing
from spanforge.llm.pieces import op6_pieces
from spanforge.llm.runs import op11_runs
from spanforge.llm.suffix_dedup import op8_suffix_dedup
from spanforge.llm.topk import op3_topk
from spanforge.llm.toxicity import op1_toxicity
from spanforge.llm.warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_topk": op3_topk,
        "op4_mixing": op4_mixing,
        "op5_neighbours": op5_neighbours,
        "op6_pieces": op6_pieces,
        "op7_language": op7_language,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_class_lm": op9_class_lm,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_runs": op11_runs,
        "op12_divergence": op12_divergence,
        "op13_main_text": op13_main_text,
        "pipeline": pipeline.run,
    }


WARC_SQL = """
    WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages), h AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS x FROM d),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM h)
    SELECT page_id, n::BIGINT AS payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest FROM m"""

TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op3_topk": TOPK_SQL, "op12_divergence": DIVERGENCE_SQL}
