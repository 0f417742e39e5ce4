"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Null and empty texts have no words; a text of fewer than ``width`` words has no
window and stays whole; repeated rows of one doc_id are one document as far as
"smaller doc_id" goes, so neither removes the other, and each loses what its own
text shares with earlier documents.  Rows without doc_id stay whole.  Extra columns
take no part.  Windows are equal when their hashes under one fingerprint are: both
lie in a field of 2**61 elements, so different ones meet with chance 2**-110 or less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import keyed, span_hashes, table, text_bytes, word_spans
from orrery.llm.repeats import merged, repeated_intervals

WIDTH = 50


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = word_spans(data, offsets)
    return span_hashes(data, start, end), first


def cut(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that earlier documents already have."""
    docs = keyed(docs)
    joined = docs.join(repeated_intervals(docs, word_tokens, width), ["doc_id", "text_key"], "left")

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = {"n_words": [], "n_removed": [], "kept": []}
            for text, found in zip(texts, batch.column("spans").to_pylist()):
                words = (text or "").encode().split()
                n, parts, at = len(words), [], 0
                for lo, hi in merged(found):
                    parts += words[at:lo]
                    at = hi
                parts += words[at:]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(parts))
                out["kept"].append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array([k.decode() for k in out["kept"]], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(w) - 48)) r(i)),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
