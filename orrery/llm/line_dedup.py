"""Line dedup: fingerprints of lines, joined by position, extended both ways; later repeated runs go.

A line's hash covers its words, so white space at its ends or between words does
not matter.  Fingerprints are (a) every line of at least LINE_WORDS words, (b) such a
line with up to GRAM - 1 short lines after it, or before it, to one that is not
blank, and (c) all grams of GRAM short lines.  A fingerprint is joined with its
first place, the least (doc_id, text, line); from there the match is extended up and
down while lines are equal, and the run is deleted where it is the later.  So
every line with words goes that lies in a run with any earlier copy, if the run
holds a longer line or at least GRAM short ones: some fingerprint within the run
holds the line, and the first place of that one holds it too.
The first place of anything always stays, so no text is lost from the corpus.

Null text has no lines and stays null; an empty text has one empty line.  Blank
lines are never fingerprints but go with a run around them.  Rows that repeat both
doc_id and text are not earlier than each other; rows that share a doc_id with
different texts come in the order of a hash of the text.  Rows without doc_id stay
whole.  Columns other than doc_id and text are carried or ignored, never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import _TOKENS, binary_column, columns_of, keyed, line_spans, mix, prefix_hash, range_hash, slices, span_hashes, staged, table, text_bytes, window_hashes, word_spans
from orrery.llm.repeats import merged

LINE_WORDS = 5
GRAM = 3


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, first): each line's hash and word count, and each text's first line."""
    start, end, first = line_spans(data, offsets)
    word_start, word_end, _ = word_spans(data, offsets)
    prefix = prefix_hash(span_hashes(data, word_start, word_end), _TOKENS)
    lo, hi = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
    return range_hash(prefix, lo, np.maximum(lo, hi), _TOKENS), np.maximum(hi - lo, 0), first


def fingerprints(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, line_words: int = LINE_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, line) of every selected place."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    long = np.flatnonzero(words >= line_words)
    grams, text, position = window_hashes(hashes, first, gram)
    at = first[:-1][text] + position
    total = np.concatenate([[0], np.cumsum(words >= line_words)])
    spoken = np.concatenate([[0], np.cumsum(words)])
    usable = (total[at + gram] == total[at]) & (spoken[at + gram] > spoken[at])
    grams, text, position = grams[usable], text[usable], position[usable]
    prefix = prefix_hash(hashes, _TOKENS)
    beside = []  # (hash, first line) of long lines with their short neighbours
    for step in (1, -1):
        at = long
        for k in range(1, gram):
            end = at + k * step
            inside = (end >= 0) & (end < len(owner))
            at, end = at[inside], end[inside]
            short = (owner[end] == owner[at]) & (words[end] < line_words)
            at, end = at[short], end[short]
            spoken = words[end] > 0
            lo, hi = np.minimum(at, end)[spoken], np.maximum(at, end)[spoken] + 1
            beside.append((range_hash(prefix, lo, hi, _TOKENS), lo))
    wide, lines = (np.concatenate([b[k] for b in beside]) if beside else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    return (
        np.concatenate([mix(hashes[long]), mix(wide ^ np.uint64(0x2545F491)), mix(grams ^ np.uint64(0x5BD1E995))]),
        np.concatenate([owner[long], owner[lines], text]).astype(np.int64),
        np.concatenate([long - first[:-1][owner[long]], lines - first[:-1][owner[lines]], position]).astype(np.int64),
    )


def select(batches):
    """(fp, doc_id, text_key, line)"""
    for whole in batches:
        for batch in slices(whole):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            fp, text, line = fingerprints(*line_hashes(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ids[text]), pa.array(keys[text]), pa.array(line.astype(np.int32))], names=["fp", "doc_id", "text_key", "line"])


def hashed(batches):
    """(doc_id, text_key, lines): all line hashes of a text."""
    for whole in batches:
        for batch in slices(whole):
            hashes, _, first = line_hashes(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), binary_column(hashes, first)], names=["doc_id", "text_key", "lines"])


def extend(batches):
    """(doc_id, text_key, lo, hi): matched runs of lines, from texts (doc_id, text_key, lines) met with first ones (doc0, key0, lines0) at pairs."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for doc, key, doc0, key0, pairs, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "doc0", "key0", "pairs", "lines", "lines0"))):
            a = np.frombuffer(a, np.uint64).tolist()
            b = a if (doc, key) == (doc0, key0) else np.frombuffer(b, np.uint64).tolist()
            reached: dict[int, int] = {}
            for line, line0 in sorted((p["line"], p["line0"]) for p in pairs):
                shift = line - line0
                if line < reached.get(shift, 0) or line >= len(a) or line0 >= len(b) or a[line] != b[line0]:
                    continue
                lo, hi = line, line + 1
                while lo > 0 and lo > shift and a[lo - 1] == b[lo - 1 - shift]:
                    lo -= 1
                while hi < len(a) and hi - shift < len(b) and a[hi] == b[hi - shift]:
                    hi += 1
                reached[shift] = hi
                out.append((doc, key, lo, hi))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "text_key", "lo", "hi"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of keyed docs: runs of lines that have an earlier copy."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    places = docs.mapInArrow(select, "fp long, doc_id long, text_key long, line int")
    at = F.struct("doc_id", "text_key", "line")
    # written, so that the join below is of two plain exchanges and a hot line can be split
    first = staged(places.groupBy("fp").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("fp", "first"))
    later = places.join(first, "fp").where(at > F.col("first"))
    pairs = later.select("doc_id", "text_key", F.col("first.doc_id").alias("doc0"), F.col("first.text_key").alias("key0"), "line", F.col("first.line").alias("line0"))
    pairs = pairs.groupBy("doc_id", "text_key", "doc0", "key0").agg(F.collect_set(F.struct("line", "line0")).alias("pairs"))
    lines = staged(docs.mapInArrow(hashed, "doc_id long, text_key long, lines binary").dropDuplicates(["doc_id", "text_key"]))
    met = pairs.join(lines, ["doc_id", "text_key"]).join(lines.toDF("doc0", "key0", "lines0"), ["doc0", "key0"])
    runs = met.select("doc_id", "text_key", "doc0", "key0", "pairs", "lines", "lines0").mapInArrow(extend, "doc_id long, text_key long, lo int, hi int")
    return runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def rewritten(docs: DataFrame) -> DataFrame:
    """docs with text cut; added are _n_lines and _n_removed, which replace columns of docs so named."""
    docs = docs.drop("_n_lines", "_n_removed")
    found = repeated_lines(keyed(docs)).select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("spans").alias("_cut_spans"))
    joined = docs.join(found, (docs["doc_id"] == found["_cut_id"]) & (F.xxhash64(docs["text"]) == found["_cut_key"]), "left").drop("_cut_id", "_cut_key")
    schema = joined.drop("_cut_spans").schema.add("_n_lines", "long").add("_n_removed", "long")
    names = schema.names

    def work(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_cut_spans").to_pylist()):
                lines = text.split("\n") if text is not None else []
                kept, at = [], 0
                for lo, hi in merged(spans):
                    kept += lines[at:lo]
                    at = hi
                kept += lines[at:]
                texts.append("\n".join(kept) if text is not None else None)
                counts.append(len(lines))
                removed.append(len(lines) - len(kept))
            new = {"text": pa.array(texts, pa.string()), "_n_lines": pa.array(counts, pa.int64()), "_n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n) if n in new else batch.column(n) for n in names], names=names)

    return joined.mapInArrow(work, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewritten(columns_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
