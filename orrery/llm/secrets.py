"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

The three base patterns give their leftmost non-overlapping matches; one that is
too short is dropped and not tried again.  Beside them, every run of at least
WINDOW characters of a class is a candidate string: the entropy of each window of
WINDOW characters is kept by incremental counts, and windows at or above the
class's threshold merge into spans.  The allow-list then suppresses spans of
candidates that are known not to be secrets.  Base spans always stay.

Null text is empty and gives zero counts and the digest of ''.  Texts are read
whole; positions are code points.  Rows are independent, so repeated rows repeat
their result, and an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import columns_of, slices, table, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

WINDOW = 20
#: Class: (characters, bits at which a window of WINDOW characters counts as random).
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]", 3.0),
    "entropy_mixed": (r"[A-Za-z0-9+/_=-]", 3.8),
}
#: Candidates that are no secrets: without a digit or without a letter, UUIDs, paths, stated examples.
ALLOWED = re.compile(r"[^0-9]*|[^A-Za-z]*|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:/?[A-Za-z]+[0-9]{0,2})(?:[/_-][A-Za-z]*[0-9]{0,4})+|.*(?:EXAMPLE|example|sample|dummy).*")
_RUNS = {kind: re.compile(f"{chars}{{{WINDOW},}}") for kind, (chars, _) in CLASSES.items()}
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

_HEX_BYTES = np.isin(np.arange(256), list(b"0123456789abcdef"))
_MIXED_BYTES = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))


def entropy_spans(candidate: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal (start, end) covered by windows of at least ``threshold`` bits."""
    if len(candidate) < window:
        return []
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    plogp = _PLOGP if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    bound = window * (math.log2(window) - threshold) + 1e-9  # sum of c log c allowed
    for i, ch in enumerate(candidate):
        if i >= window:
            old = candidate[i - window]
            c = counts[old]
            total += plogp[c - 1] - plogp[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += plogp[c + 1] - plogp[c]
        counts[ch] = c + 1
        if i >= window - 1 and total <= bound:
            lo = i - window + 1
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((lo, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def added_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, (_, threshold) in CLASSES.items():
        for m in _RUNS[kind].finditer(text):
            if not ALLOWED.fullmatch(m[0]):
                out += [(m.start() + lo, m.start() + hi, kind) for lo, hi in entropy_spans(m[0], threshold)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def texts_with_run(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray, length: int) -> np.ndarray:
    """Which texts hold ``length`` bytes of a class in a row (a superset: runs over a border count)."""
    inside = chars[data]
    have = 1
    while have < length and len(inside) > 0:
        step = min(have, length - have)
        inside = inside[: max(0, len(inside) - step)] & inside[step:]
        have += step
    total = np.concatenate([[0], np.cumsum(inside)])
    ends = np.minimum(offsets[1:], len(inside))
    return total[ends] > total[np.minimum(offsets[:-1], len(inside))]


def scan(batches):
    for whole in batches:
        for batch in slices(whole):
            data, offsets = text_bytes(batch.column("text"))
            long_hex = texts_with_run(data, offsets, _HEX_BYTES, 32)
            long_any = texts_with_run(data, offsets, _MIXED_BYTES, WINDOW)
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, spans = [], []
            for text, has_hex, has_any in zip(batch.column("text").to_pylist(), long_hex, long_any):
                text = text or ""
                base = base_spans(text) + (hex_spans(text) if has_hex else [])
                for kind in KINDS[:3]:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added_spans(text)) if has_any else joined(base))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS[:3]], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    return columns_of(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
