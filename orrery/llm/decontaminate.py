"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit check.

A walk reads a window word by word: at step j it writes the word under its pointer
and moves on if the j-th random bit of that word is 1.  Two windows at small edit
distance walk apart and together again, so that their outputs differ in few steps:
edit distance has become Hamming distance.  A key samples SAMPLED of the steps; each
of WALKS walks gives KEYS keys, and a window meets an item under any equal one.
An item is walked in segments of SEGMENT words that cover all of it (a shorter item
in one), so that edits in one part of a long item leave the others to be met: some
segment has about the item's share of edits, or less.

Only windows that can pass are walked: an item of L words within d edits keeps, by
pigeonhole, one of any d + 1 disjoint pieces, so a window needs one of the item's
grams of L // (d + 1) words (at most GRAM).  What shares a key is then checked
exactly: the least word edit distance of the item to any stretch of the text around
the window, by bit-parallel dynamic programming.  Reported are pairs within
TOLERANCE of the item's length.

Words are compared without ASCII case.  Null or empty texts and items match
nothing; items of fewer than LEAST_WORDS words match as whole word sequences only,
at distance 0.  Items that repeat are reported each; rows that repeat a doc_id are one
document.  Rows without doc_id or item_id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import columns_of, mix, slices, span_hashes, table, text_bytes, window_hashes, word_spans

TOLERANCE = 0.2
GRAM = 3
LEAST_WORDS = 8
WALKS, KEYS, SAMPLED = 6, 3, 3
#: Words of one walk; a segment with a quarter of its words edited still holds a gram of 3.
SEGMENT = 16
#: Items of one pass, by words: what every task is sent, whatever the benchmark's size.
PASS_WORDS = 500_000
SEED = 77


def allowed(length: int) -> int:
    return int(TOLERANCE * length)


def segments(length: int) -> tuple[int, list[int]]:
    """(words, starts) of the segments of an item: evenly spaced, the first at its start and the last to its end."""
    size, count = min(SEGMENT, length), -(-length // SEGMENT)
    return size, [k * (length - size) // max(count - 1, 1) for k in range(count)]


def walked(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, walk: int) -> list[np.ndarray]:
    """KEYS keys of one walk of 2 * size steps from each start; past the end (of the text) stands a mark."""
    rng = np.random.default_rng([SEED, size, walk])
    steps = 2 * size
    picked = [set(np.sort(rng.choice(steps, SAMPLED, replace=False)).tolist()) for _ in range(KEYS)]
    bits = mix(tokens ^ np.uint64(rng.integers(1, 1 << 62)))
    pointer = starts.copy()
    keys = [np.full(len(starts), np.uint64(size * 1000 + walk * 10 + k)) for k in range(KEYS)]
    last = len(tokens) - 1
    for j in range(max(max(p) for p in picked) + 1):
        at = np.minimum(pointer, last)
        for k, steps_of in enumerate(picked):
            if j in steps_of:
                word = np.where(pointer < ends, tokens[at], np.uint64(3))
                keys[k] = mix(keys[k] * np.uint64(0x9E3779B97F4A7C15) + word)
        pointer = pointer + ((bits[at] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
    return keys


def distance_within(item: list[int], words: list[int], limit: int) -> tuple[int, int] | None:
    """(least edit distance of item to any stretch of words, its end), or None beyond the limit (Myers' bit vectors)."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, None
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) & mask) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & mask), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask  # a stretch may start anywhere
        plus, minus = mh | (~(xv | ph) & mask), ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """The items of one pass: their grams, the keys of their segments by size, and the hashes of short ones by length."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        start, end, first = word_spans(data, offsets)
        self.tokens = span_hashes(data, start, end, lower=True)
        self.ids, self.first = np.array(ids, dtype=np.int64), first
        self.lengths = np.diff(first)
        use = np.flatnonzero(self.lengths >= LEAST_WORDS)
        self.reach = max((min(SEGMENT, int(n)) + SEGMENT // 4 for n in self.lengths[use]), default=0)
        self.width = {int(i): min(GRAM, int(self.lengths[i]) // (allowed(int(self.lengths[i])) + 1)) for i in use}
        grams: dict[int, list[np.ndarray]] = {}
        for i in use:
            part = self.tokens[first[i] : first[i + 1]]
            grams.setdefault(self.width[int(i)], []).append(window_hashes(part, np.array([0, len(part)]), self.width[int(i)])[0])
        self.grams = {w: np.unique(np.concatenate(g)) for w, g in grams.items()}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, LEAST_WORDS):
            mine = np.flatnonzero(self.lengths == n)
            if len(mine):
                hashes = np.concatenate([window_hashes(self.tokens[first[i] : first[i + 1]], np.array([0, n]), n)[0] for i in mine])
                self.short[n] = hashes[np.argsort(hashes)], mine[np.argsort(hashes)]
        self.keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        cut = [(size, int(i), at) for i in use for size, starts in [segments(int(self.lengths[i]))] for at in starts]
        sizes, self.item_of, self.offset_of = (np.array([c[k] for c in cut], dtype=np.int64) for k in range(3))
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            item = self.item_of[mine]
            keys = [k for walk in range(WALKS) for k in walked(self.tokens, first[item] + self.offset_of[mine], first[item + 1], size, walk)]
            self.keys[size] = [(k[np.argsort(k)], mine[np.argsort(k)]) for k in keys]

    def near(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a gram of some item: a gram and a segment's reach before it."""
        mark = np.zeros(len(tokens) + 1, dtype=np.int32)
        for width, known in self.grams.items():
            hashes, text, position = window_hashes(tokens, first, width)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            where = first[:-1][text[hit]] + position[hit]
            low = np.maximum(first[:-1][text[hit]], where - self.reach)
            np.add.at(mark, low, 1)
            np.add.at(mark, where + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def candidates(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, segment) pairs that share a key."""
        starts = self.near(tokens, first)
        if not len(starts):
            return starts, starts
        ends = first[np.searchsorted(first, starts, side="right")]
        out_start, out_segment = [], []
        for size, tables in self.keys.items():
            k = 0
            for walk in range(WALKS):
                for keys in walked(tokens, starts, ends, size, walk):
                    known, parts = tables[k]
                    k += 1
                    lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    hit = np.flatnonzero(hi > lo)
                    counts = (hi - lo)[hit]
                    out_start.append(np.repeat(starts[hit], counts))
                    out_segment.append(parts[np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum())] if len(hit) else np.zeros(0, np.int64))
        pairs = np.unique(np.stack([np.concatenate(out_start), np.concatenate(out_segment)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def whole(self, tokens: np.ndarray, first: np.ndarray):
        """(row, item index, first word, end word, distance 0): the first place of each short item in each text."""
        for n, (known, items) in self.short.items():
            hashes, text, position = window_hashes(tokens, first, n)
            lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            seen = set()
            for k in np.flatnonzero(hi > lo):
                for item in items[lo[k] : hi[k]].tolist():
                    if (int(text[k]), item) not in seen:
                        seen.add((int(text[k]), item))
                        yield int(text[k]), item, int(position[k]), int(position[k]) + n, 0

    def matches(self, batch: pa.RecordBatch):
        """(row, item index, first word, end word, distance): for each text and item the best stretch within the tolerance."""
        data, offsets = text_bytes(batch.column("text"))
        start, end, first = word_spans(data, offsets)
        if not len(start):
            return
        tokens = span_hashes(data, start, end, lower=True)
        yield from self.whole(tokens, first)
        if not self.keys:
            return
        begins, parts = self.candidates(tokens, first)
        rows = np.searchsorted(first, begins, side="right") - 1
        items, begins = self.item_of[parts], begins - self.offset_of[parts]
        by: dict[tuple[int, int], list[int]] = {}
        for row, item, begin in zip(rows.tolist(), items.tolist(), begins.tolist()):
            by.setdefault((row, item), []).append(begin)
        for (row, item), places in by.items():
            pattern = self.tokens[self.first[item] : self.first[item + 1]].tolist()
            limit, best, low = allowed(len(pattern)), None, int(first[row])
            regions: list[list[int]] = []
            for p in sorted(set(places)):  # stretches around the windows, overlapping ones as one; edits before a segment shift it
                lo, hi = max(low, p - 2 * limit), min(int(first[row + 1]), p + len(pattern) + 2 * limit)
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = max(hi, regions[-1][1])
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                found = distance_within(pattern, tokens[lo:hi].tolist(), limit)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1] - low)
            if best:
                yield row, item, max(0, best[1] - len(pattern)), best[1], best[0]


def passes(items: DataFrame, pass_words: int = PASS_WORDS):
    """The items in parts of bounded size, one at a time on the driver."""
    ids, texts, words = [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        words += len(row["text"].split())
        if words >= pass_words:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, items: DataFrame, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance): each document's best match with each item that it holds."""
    spark = docs.sparkSession
    docs = columns_of(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = columns_of(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, first_word long, end_word long, distance long"
    out = spark.createDataFrame([], schema)
    for ids, texts in passes(items, pass_words):
        shared = spark.sparkContext.broadcast((ids, texts))

        def work(batches, shared=shared):
            known = Items(*shared.value)
            for whole in batches:
                for batch in slices(whole):
                    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
                    found = list(known.matches(batch))
                    columns = [[int(doc[f[0]]) for f in found], [int(known.ids[f[1]]) for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word", "end_word", "distance"])

        out = out.unionByName(docs.mapInArrow(work, schema))
    best = F.min(F.struct("distance", "first_word", "end_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.first_word", "best.end_word", "best.distance")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, unchanged."""
    found = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
