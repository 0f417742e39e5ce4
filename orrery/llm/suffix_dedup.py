"""Suffix-array dedup: strings of WIDTH bytes that start in more than one place, by difference-cover suffix sorting.

Suffixes are dealt to partitions by fingerprint.  Of the gram hashes in each window
of WIDTH bytes the smallest (leftmost) is its anchor; equal windows have equal
anchors at equal distance, so suffixes that share WIDTH bytes come to one place.
Windows under one anchor place form a run, WIDTH + n - 1 bytes of context:

1. runs whose anchor gram occurs nowhere else cannot repeat and go no further;
2. runs of equal context (128-bit digests of the bytes) repeat as a whole.  Counts
   are combined within each slice before they move, and the runs are marked by a
   join on the digest, in which a hot passage is split like any skewed key;
3. contexts that differ under one anchor (the borders of copies) are suffix-sorted,
   one of each, in blocks of bounded size, every two blocks of a large anchor
   together: triples of the sampled two thirds of positions are sorted and named,
   the names sorted by recursion, the remaining third merged in, and neighbours in
   the order that agree in WIDTH bytes, compared byte by byte, mark their windows.

Each text is UTF-8 bytes; matches stay within texts.  Null is empty; texts shorter
than WIDTH have no window; rows without doc_id stay whole and are no evidence.
Rows are places each: a row that repeats another whole goes with it, and rows that
share a doc_id lose what their own text repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orrery.llm.common import binary_column, keyed, partitions, sliding_min, slices, staged, table, text_bytes
from orrery.llm.repeats import merged

WIDTH = 400
GRAM = 128
#: Contexts sorted at once, in bytes: names of all levels then fit 21 bits.
SORT_BYTES = 1_000_000
#: Contexts of one block, in bytes; two of a large anchor are sorted together.
BLOCK_BYTES = SORT_BYTES // 3


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (integers from 1, below 2**21 values) in order: the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    if n % 3 == 1:  # a last least symbol parts the two sampled classes
        out = suffix_array(np.append(s + 1, 1))
        return out[out < n]
    t = np.concatenate([s, [0, 0, 0]]).astype(np.uint64)
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = t[sample] << np.uint64(42) | t[sample + 1] << np.uint64(21) | t[sample + 2]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(sample), dtype=np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if int(new.sum()) < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, dtype=np.uint64)
    rank[sample] = names
    sampled = sample[order]
    # the remaining third: first symbol, then the rank of what follows
    rest = np.arange(0, n, 3)
    short = lambda i: t[i] << np.uint64(21) | rank[i + 1]
    long = lambda i: t[i] << np.uint64(42) | t[i + 1] << np.uint64(21) | rank[i + 2]
    rest = rest[np.argsort(short(rest), kind="stable")]
    of_one, of_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before_rest = np.searchsorted(short(of_one), short(rest)) + np.searchsorted(long(of_two), long(rest))
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(rest)) + before_rest
    out[place] = rest
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = sampled
    return out


def repeated_windows(contexts: list[np.ndarray], counts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its first ``count`` windows agree in ``width`` bytes with a window elsewhere."""
    sizes = np.array([len(c) + 1 for c in contexts])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = np.ones(int(sizes.sum()), dtype=np.int64)  # 1 parts the contexts
    raw = np.zeros(len(joined) + 8, dtype=np.uint8)
    valid = np.zeros(len(joined), dtype=bool)
    for c, lo, n in zip(contexts, at, counts):
        joined[lo : lo + len(c)] = c.astype(np.int64) + 2
        raw[lo : lo + len(c)] = c
        valid[lo : lo + n] = True
    order = suffix_array(joined)
    order = order[valid[order]]
    eight = np.ndarray((len(joined) + 1,), "<u8", raw, 0, (1,))
    same = np.arange(len(order) - 1)  # neighbours that agree so far
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        same = same[eight[order[same] + k] == eight[order[same + 1] + k]]
    hit = np.zeros(len(joined), dtype=bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [hit[lo : lo + n] for lo, n in zip(at, counts)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` (8 or more) bytes in a row, by doubling.  Only deals work out: what it brings together is compared on bytes."""

    def combined(a, b):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    out, have = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)), 8
    out = combined(out, np.uint64(gram))
    while have * 2 <= gram:
        out, have = combined(out[:-have], out[have:]), have * 2
    return combined(out[: len(out) - (gram - have)], out[gram - have :]) if gram > have else out


RUN = "anchor long, c1 long, c2 long, doc_id long, text_key long, start int, n int"


def runs_of(width: int, gram: int, combine: bool):
    """RUN of every run of windows of (doc_id, text, text_key), or, if ``combine``, of the first of each context in a slice, with their number k."""
    reach = width - gram + 1

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
                data, offsets = text_bytes(batch.column("text"))
                counts = np.maximum(np.diff(offsets) - width + 1, 0)
                if not counts.sum():
                    continue
                grams = gram_hashes(data, gram)
                # upper half of the hash, then place: the leftmost of equals wins, whatever the slice
                least = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), reach)
                text = np.repeat(np.arange(len(counts)), counts)
                start = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                new = np.ones(len(start), dtype=bool)
                new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                begin = start[head]
                view = memoryview(np.ascontiguousarray(data))
                digests = b"".join([hashlib.blake2b(view[lo:hi], digest_size=16).digest() for lo, hi in zip(begin.tolist(), (begin + n + width - 1).tolist())])
                context = np.frombuffer(digests, np.int64).reshape(-1, 2)
                columns = [grams[place[head]].view(np.int64), context[:, 0], context[:, 1], ids[text[head]], keys[text[head]], (begin - offsets[:-1][text[head]]).astype(np.int32), n.astype(np.int32)]
                names = ["anchor", "c1", "c2", "doc_id", "text_key", "start", "n"]
                if combine:
                    order = np.lexsort((context[:, 1], context[:, 0]))
                    first = np.ones(len(order), dtype=bool)
                    first[1:] = (context[order[1:]] != context[order[:-1]]).any(1)
                    columns = [c[order[first]] for c in columns] + [np.diff(np.append(np.flatnonzero(first), len(order)))]
                    names.append("k")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return work


def cut_contexts(width: int):
    """(anchor, lo, hi, doc_id, text_key, start, n, k, bytes) from the runs of a text."""
    names = ["anchor", "lo", "hi", "doc_id", "text_key", "start", "n", "k"]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column("text"))
            start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            low = offsets[:-1] + start
            parts = [data[lo : lo + k + width - 1] for lo, k in zip(low, n)]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], binary_column(np.concatenate(parts), at)], names=[*names, "bytes"])

    return work


def border_hits(width: int):
    """(doc_id, text_key, lo, hi) of the repeated windows among differing contexts, which come sorted by (anchor, lo, hi)."""

    def solve(rows):
        contexts, counts = [np.frombuffer(r[5], np.uint8) for r in rows], np.array([r[3] for r in rows])
        out = []
        for (doc, key, start, _, k, _), hit in zip(rows, repeated_windows(contexts, counts, width)):
            if k > 1:
                continue  # decided already
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(doc, key, start + lo, start + hi - 1 + width) for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "text_key", "lo", "hi"])

    def work(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "lo", "hi", "doc_id", "text_key", "start", "n", "k", "bytes"))):
                # several small anchors are sorted at once, but of one anchor no two pairs of blocks, which share contexts
                if rows and (anchor, lo, hi) != last and (size >= BLOCK_BYTES or anchor == last[0]):
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[-1]), (anchor, lo, hi)
        if rows:
            yield solve(rows)

    return work


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, spans) of keyed docs: byte intervals covered by windows that start elsewhere too."""
    n = partitions(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    combined = docs.mapInArrow(runs_of(width, gram, True), f"{RUN}, k long").repartition(n, "anchor")
    contexts = combined.groupBy("anchor", "c1", "c2").agg(F.sum("k").alias("k"), F.min(F.struct("doc_id", "text_key", "start", "n")).alias("run"))
    contexts = staged(contexts.withColumn("contexts", F.count("*").over(W.partitionBy("anchor"))).where("k > 1 OR contexts > 1"))
    runs = docs.mapInArrow(runs_of(width, gram, False), RUN).drop("anchor")
    # one strategy at every size, of two plain exchanges, in which hot contexts are split
    whole = runs.join(contexts.where("k > 1").select("c1", "c2").hint("merge"), ["c1", "c2"], "left_semi")
    whole = whole.select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + width).alias("hi"))
    probes = contexts.where("contexts > 1").select("anchor", "c1", "k", "run.*")
    blocks = probes.groupBy("anchor").agg(F.ceil(F.sum(F.col("n") + width) / BLOCK_BYTES).cast("int").alias("blocks"))
    probes = probes.join(blocks, "anchor").withColumn("block", F.pmod("c1", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = probes.select("anchor", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "text_key", "start", "n", "k")
    cut_out = probes.join(docs, ["doc_id", "text_key"]).select(*probes.columns, "text").mapInArrow(cut_contexts(width), "anchor long, lo int, hi int, doc_id long, text_key long, start int, n int, k long, bytes binary")
    borders = cut_out.repartition(n, "anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi").mapInArrow(border_hits(width), "doc_id long, text_key long, lo int, hi int")
    return whole.unionByName(borders).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary)"""

    def work(batches):
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, parts, at = (text or "").encode(), [], 0
                holes = merged(found)
                for lo, hi in holes:
                    parts.append(raw[at:lo])
                    at = hi
                parts.append(raw[at:])
                rest = b"".join(parts)
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(len(holes))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    docs = keyed(docs)
    joined = docs.join(repeated_bytes(docs, width, gram), ["doc_id", "text_key"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 399]) AS k FROM b, unnest(range(1, octet_length(b) - 398)) r(i)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
parted AS (SELECT doc_id, i, (coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 1000) > 400)::INT AS new FROM hit),
grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM parted),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 399 AS hi FROM grouped GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM runs
  UNION ALL SELECT doc_id, max(hi) + 1, 2000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN a <= least(z, octet_length(b)) THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS h FROM pieces JOIN b USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(hi - lo + 1) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, hex(b)))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
