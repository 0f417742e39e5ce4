"""Shared pieces of the training-data operators.

Text kernels work on the UTF-8 bytes of a whole Arrow batch at once: words and
lines become hashes in a handful of numpy passes, without a Python object per word.
Sequences are hashed by polynomials over a prime field: modulo a power of two, texts
made for it collide whatever the base.  Batches hold at most ``spark.sql.execution.arrow.maxRecordsPerBatch``
texts, so memory follows the batch and never the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.operators.lineage import staged  # noqa: F401  used by every operator here

#: The field of the polynomial (Rabin-Karp) hashes, a Mersenne prime, and a base drawn from it.
PRIME = (1 << 61) - 1
TOKEN_BASE = 0x16E8FEB86659FD93

#: The white space between words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts in one slice of a batch, by bytes: bounds the temporaries of the kernels.
SLICE_BYTES = 1 << 20
#: Bytes from which a span is hashed by itself.
LONG_SPAN = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads polynomial hashes over all 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below 2**61, by halves of 31 bits: 2**62 is 2 there."""
    half, low, thirty = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return folded((ah * bh << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & thirty) << half) + al * bl)


class Powers:
    """Growing tables of base**i and base**-i modulo PRIME."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def table(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            m = min(done, n - done)
            out[done : done + m] = times(out[:m], np.uint64(pow(base, done, PRIME)))
            done += m
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = self.table(self.base, size), self.table(self.inverse, size)
        return self.up[:n], self.down[:n]


_TOKENS = Powers(TOKEN_BASE)


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """C[i] = sum over j < i of values[j] * base**j modulo PRIME, so that any range is one subtraction."""
    up, _ = powers.upto(len(values) + 1)
    terms = times(folded(values), up[: len(values)])
    # sums of the halves cannot overflow; 2**32 times the upper one folds at its 29th bit
    low, high = np.cumsum(terms & np.uint64((1 << 32) - 1), dtype=np.uint64), np.cumsum(terms >> np.uint64(32), dtype=np.uint64)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    out[1:] = folded((high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + low)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.upto(len(prefix))
    return mix(times(folded(prefix[end] + np.uint64(PRIME) - prefix[start]), down[start]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, text: str = "text"):
    """The batch in slices of about SLICE_BYTES of text (one text at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and for each text the index of its first word (n + 1 values)."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]  # words never cross texts
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets, side="left")


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans for the lines that U+000A divides; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    owner_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    counts = 1 + np.bincount(owner_of_break, minlength=len(offsets) - 1)[: len(offsets) - 1] if len(offsets) > 1 else np.zeros(0, np.int64)
    return start, end, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span: its length, then eight bytes at a time; of long spans a digest."""
    data = _LOWER[data] if lower else data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    n = (end - start).astype(np.int64)
    out = mix(n.astype(np.uint64) + np.uint64(TOKEN_BASE))
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at, left = start[live], n[live]
    while len(live):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def window_hashes(tokens: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of every window of ``width`` tokens that lies within one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(np.cumsum(counts) - counts, counts)
    position = np.arange(total) - base
    start = first[:-1][text] + position
    return range_hash(prefix_hash(tokens, _TOKENS), start, start + width, _TOKENS), text, position


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def binary_column(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary array whose i-th value is the bytes of values[starts[i]:starts[i + 1]]."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever they are called, take no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): rows that share a doc_id are told apart by a hash of their text."""
    return columns_of(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
