"""Repeated windows of tokens, found exactly, with one shuffle of what can repeat.

Every window of ``width`` tokens gets a Rabin-Karp hash.  Windows travel in runs:
neighbours that share the smallest hash of their half-width grams (the winnowed
fingerprint) go together under it.  Equal windows have equal fingerprints, so they
meet in one place, and a document's share of a hot passage is spread over all of
the passage's fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import binary_column, partitions, sliding_min, slices, text_bytes, window_hashes

RUNS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("hashes", pa.binary())])
HITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def runs_of(tokens: Tokens, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, text_key) to runs of windows; ``tokens`` maps (bytes, offsets) to (hashes, index of each text's first)."""
    gram = (width + 1) // 2
    reach = width - gram + 1

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
                hashes, first = tokens(*text_bytes(batch.column("text")))
                window, text, position = window_hashes(hashes, first, width)
                if not len(window):
                    continue
                grams, _, _ = window_hashes(hashes, np.array([0, len(hashes)]), gram)
                anchor = sliding_min(grams, reach)[first[:-1][text] + position]
                new = np.ones(len(window), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor[at].view(np.int64)), pa.array(ids[text[at]].astype(np.int64)), pa.array(keys[text[at]]),
                    pa.array(position[at].astype(np.int32)), binary_column(window, np.append(at, len(window))),
                ], schema=RUNS)

    return work


def later_copies(width: int, within: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs sorted by (anchor, doc_id, start) to the token intervals of windows seen earlier.

    Earlier means in a document with a smaller id or, if ``within``, also before in
    the same document.  Kept between batches: the distinct windows of one anchor.
    """

    def work(batches):
        kept_anchor, kept_hash, kept_doc = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            start = batch.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = text_bytes(batch.column("hashes"))
            window = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64)
            begin = offsets // 8
            count = np.diff(begin)
            run = np.repeat(np.arange(len(docs)), count)
            doc = docs[run]
            n = len(kept_hash) if kept_anchor is not None and kept_anchor == anchor[0] else 0
            hashes = np.concatenate([kept_hash[:n], window])
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            lead = np.ones(len(ordered), dtype=bool)
            lead[1:] = ordered[1:] != ordered[:-1]
            head = np.flatnonzero(lead)
            group = np.cumsum(lead) - 1
            owners = np.concatenate([kept_doc[:n], doc])
            least = owners[order[head]]  # rows arrive by doc_id, so the first is the least
            seen = np.empty(len(hashes), dtype=bool)
            seen[order] = (~lead) if within else owners[order] > least[group]
            seen = seen[n:]
            # what the last anchor has shown so far stays for the next batch
            last = anchor[-1]
            mine = np.concatenate([np.full(n, kept_anchor == last if n else False), anchor[run] == last])[order[head]]
            kept_anchor, kept_hash, kept_doc = last, ordered[head][mine], least[mine]
            position = start[run] + np.arange(len(window)) - begin[:-1][run]
            hit = np.flatnonzero(seen)
            if not len(hit):
                continue
            opens = np.ones(len(hit), dtype=bool)
            opens[1:] = (hit[1:] != hit[:-1] + 1) | (run[hit[1:]] != run[hit[:-1]])
            lo = hit[opens]
            hi = hit[np.append(np.flatnonzero(opens)[1:] - 1, len(hit) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo]), pa.array(keys[run[lo]]), pa.array(position[lo].astype(np.int32)), pa.array((position[hi] + width).astype(np.int32))], schema=HITS)

    return work


def repeated_intervals(docs: DataFrame, tokens: Tokens, width: int, within: bool = False) -> DataFrame:
    """(doc_id, text_key, spans array<struct<lo,hi>>) of keyed docs: token intervals covered by windows that occur earlier."""
    n = partitions(docs.sparkSession)
    runs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(runs_of(tokens, width), "anchor long, doc_id long, text_key long, start int, hashes binary")
    met = runs.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    hits = met.mapInArrow(later_copies(width, within), "doc_id long, text_key long, lo int, hi int")
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal intervals of one document's (possibly overlapping) ones."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]
