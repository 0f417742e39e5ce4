"""Cross-tokenizer alignment: where two tokenizers' tokens end together.

Each text is encoded by both tokenizers.  The ends of their tokens are events; the
events of both sides are unioned, dealt by document and sorted by byte offset within
it, and one pass over them keeps only the tokens since the last common end: where an
A and a B token end together a group closes and their pair is a link.  Events travel
packed, up to SEGMENT bytes of text in a row (document, first byte, side, token ids),
since a token's length follows from its id; a long text is many rows, and its open
group is all that is carried from one to the next.

Corpus-wide counts of linked id pairs are partial sums in every task, then one
aggregation.  Of two tokens that end together the shorter is the end of the longer,
so the number of different pairs is at most the number of token pairs of which one
ends the other (``pair_bound``, about the bytes of both vocabularies): the table of
counts is bounded by the vocabularies, whatever the corpus, and goes to the tasks
whole.

The A file is read as byte-level ranks, which tiktoken encodes faster than the file's
own library; equal ids are tested on every code point.  Texts are cut at single
spaces between two characters that are not white space: neither tokenizer has a token
across such a cut (checked: A divides words there, no piece of B holds a space after
another character; else texts stay whole).  Texts beyond SEGMENT go in stretches, and
words that a task has met before are remembered.
Null and empty texts, and texts of which either tokenizer's joined bytes differ from
the space and the text, have no tokens: zeros and an empty digest.
Rows that repeat a doc_id are each aligned by themselves, told apart by a hash of
the text; equal rows give equal results, one for each row, and each counts in the
corpus.  A null doc_id is a key like others.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from array import array
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import keyed, partitions, staged, table

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a stretch that is encoded at once (more only where no cut is), and bytes whose events are one row.
SEGMENT = 1 << 16
#: Words that a task remembers at once, and the longest of them.
REMEMBERED, LONGEST = 500_000, 40
#: Rows of documents handled together.
TOGETHER = 256
#: Fixed: how byte-level vocabularies of this kind divide a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=\S)")
EVENTS = "doc_id long, text_key long, start long, side int, ids binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Pair:
    """The two tokenizers, by their files; each process loads them once."""

    a_path: str
    b_path: str

    @cached_property
    def description(self) -> dict:
        with open(self.a_path, encoding="utf-8") as file:
            return json.load(file)

    @cached_property
    def a(self):
        """Byte-level BPE by ranks: merges come in the order of their ids."""
        from tiktoken import Encoding

        own = {t["content"] for t in self.description["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x and x.decode(errors="replace") not in own}
        return Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.b_path)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        chars, vocabulary = byte_of_char(), dict(self.description["model"]["vocab"])
        vocabulary |= {t["content"]: t["id"] for t in self.description["added_tokens"]}
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @cached_property
    def kind(self) -> str:
        """What ids are packed as, by its code."""
        return "H" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "I"

    @cached_property
    def tables(self) -> tuple:
        """For each side: lengths of the tokens, and their ids as text after ';' (opens a group), ',' and '|'."""
        ids = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        text = lambda mark: np.array([mark + x for x in ids], dtype=object)
        return np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes]), text(b";"), text(b","), text(b"|")

    @cached_property
    def may_cut(self) -> bool:
        """Whether cuts before single spaces change nothing: A's words end there, and no piece of B holds a space after another character."""
        return all(b" " not in x.lstrip(b" ") for x in self.b_bytes)

    def stretches(self, text: str) -> list[str]:
        """The text in parts of about SEGMENT characters, without the spaces at the cuts."""
        out, at = [], 0
        while self.may_cut and len(text) - at > SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def words(self, parts: list[str]) -> list[list[str]]:
        """Each part in words, between which it may be cut."""
        if not self.may_cut:
            return [[x] for x in parts]
        out = [x.split(" ") for x in parts]
        loose = {w for w in set().union(*out) if not w or w[0].isspace() or w[-1].isspace()}
        return [words if loose.isdisjoint(words) else CUT.split(x) for x, words in zip(parts, out)]

    def encoded(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The packed A and B ids of each word with a space before it; None if the bytes of either differ."""
        out, kind, encode = [], self.kind, self.a.encode_ordinary
        a_bytes, b_bytes, joined = self.a_bytes.__getitem__, self.b_bytes.__getitem__, b"".join
        for word, b in zip(words, self.b.encode(words, num_threads=1)):
            own = f" {word}"
            a, raw = encode(own), own.encode()
            same = joined(map(a_bytes, a)) == raw == joined(map(b_bytes, b))
            out.append((array(kind, a).tobytes(), array(kind, b).tobytes()) if same else None)
        return out

    def pair_bound(self) -> int:
        """How many id pairs can end together: one token is the end of the other."""
        out = 0
        for longer, others in ((self.a_bytes, self.b_bytes), (self.b_bytes, self.a_bytes)):
            ends: dict[bytes, int] = {}
            for x in others:
                ends[x] = ends.get(x, 0) + 1
            out += sum(ends.get(x[k:], 0) for x in longer for k in range(len(x)))
        return out


@lru_cache(maxsize=2)
def loaded(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def token_ends(a_path: str, b_path: str):
    """Documents to events: a row at -1 for each document, then for each SEGMENT bytes of text the ids of either side, from the first one's first byte on."""

    def encode(batches):
        pair = loaded(a_path, b_path)
        squeeze = zstandard.ZstdCompressor(1).compress

        def events(side: int, start: int, ids: np.ndarray):
            first = np.cumsum(lengths := pair.tables[side][ids]) - lengths
            for lo, hi in itertools.pairwise([*np.searchsorted(first, np.arange(0, first[-1] + 1, SEGMENT)).tolist(), len(ids)]):
                if hi > lo:
                    yield start + int(first[lo]), side, squeeze(ids[lo:hi].tobytes())

        memory: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        spoiled: set[str] = set()  # words that come back as other bytes
        for whole in batches:
            for batch in (whole.slice(at, TOGETHER) for at in range(0, whole.num_rows, TOGETHER)):
                parts = [pair.stretches(t) if t else [] for t in batch.column("text").to_pylist()]
                words = pair.words([x for own in parts for x in own])
                if len(memory[0]) > REMEMBERED:
                    for side in memory:
                        side.clear()
                fresh = list(set().union(*words).difference(memory[0]))
                for w, ids in zip(fresh, pair.encoded(fresh)):
                    memory[0][w], memory[1][w] = ids or (b"", b"")
                    if ids is None:
                        spoiled.add(w)
                split = iter(words)
                rows: list[tuple] = []
                for doc, key, own in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), parts):
                    rows.append((doc, key, -1, 0, b""))
                    found = [next(split) for _ in own]
                    if all(spoiled.isdisjoint(x) for x in found):
                        start = 0
                        for x in found:
                            ids = [np.frombuffer(b"".join(map(side.__getitem__, x)), pair.kind) for side in memory]
                            rows += [(doc, key, *event) for side in (0, 1) for event in events(side, start, ids[side])]
                            start += int(pair.tables[0][ids[0]].sum())
                for w in fresh:
                    if len(w) > LONGEST or w in spoiled:
                        del memory[0][w], memory[1][w]
                        spoiled.discard(w)
                columns = zip(("doc_id", "text_key", "start", "side", "ids"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(columns)})

    return encode


class Sweep:
    """One document's events in the order of their offsets: the open group, its digest, its counts and its links."""

    def __init__(self, doc: int | None, key: int, pair: Pair):
        self.doc, self.key, self.pair = doc, key, pair
        self.copies, self.last = 1, None
        self.ids = [np.zeros(0, np.int32)] * 2  # tokens of the open group on either side, and where they end
        self.ends = [np.zeros(0, np.int64)] * 2
        self.n = [0, 0]
        self.groups = 0
        self.links: list[np.ndarray] = []
        self.codes = self.times = np.zeros(0, np.int64)
        self.n_links, self.kept = 0, SEGMENT
        self.digest = hashlib.sha256()

    def take(self, start: int, side: int, packed: bytes) -> None:
        if self.last == (start, side):  # an equal row's event
            return
        self.last = start, side
        ids = np.frombuffer(zstandard.decompress(packed), self.pair.kind).astype(np.int32)
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], start + np.cumsum(self.pair.tables[side][ids])])
        if side:
            self.close()

    def close(self) -> None:
        """Close the groups that end within both sides' tokens so far."""
        (a, b), (a_end, b_end) = self.ids, self.ends
        met = np.searchsorted(b_end, a_end)
        common = a_end[(np.append(b_end, -1)[met] == a_end) & np.append(a_end[1:] != a_end[:-1], True)[: len(a_end)]]
        if not len(common):
            return
        na, nb = np.searchsorted(a_end, common[-1], side="right"), np.searchsorted(b_end, common[-1], side="right")
        self.ids, self.ends = [a[na:], b[nb:]], [a_end[na:], b_end[nb:]]
        a, b, a_end, b_end = a[:na], b[:nb], a_end[:na], b_end[:nb]
        group_a, group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        # a group's A tokens, then its B tokens: each token's place is its own number plus those of the other side before it
        _, _, opens, goes_on, turns = self.pair.tables
        text = np.empty(na + nb, dtype=object)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        place_a, place_b = np.arange(na) + first_b[group_a], np.arange(nb) + (first_a + size_a)[group_b]
        text[place_a], text[place_b] = goes_on[a], goes_on[b]
        text[place_a[first_a]], text[place_b[first_b]] = opens[a[first_a]], turns[b[first_b]]
        joined = b"".join(text.tolist())
        self.digest.update(joined if self.groups else joined[1:])
        self.groups += len(common)
        # every A and every B token that end at a common end
        last_a, last_b = np.flatnonzero(a_end == common[group_a]), np.flatnonzero(b_end == common[group_b])
        here_a, here_b = np.bincount(group_a[last_a], minlength=len(common)), np.bincount(group_b[last_b], minlength=len(common))
        left = np.repeat(last_a, here_b[group_a[last_a]])
        begin_b = np.cumsum(here_b) - here_b
        nth = np.arange(len(left)) - np.repeat(np.cumsum(here_b[group_a[last_a]]) - here_b[group_a[last_a]], here_b[group_a[last_a]])
        right = last_b[begin_b[group_a[left]] + nth]
        self.links += [a[left].astype(np.int64) << 32 | b[right]]
        self.n_links += len(left)
        if self.n_links > 2 * self.kept:  # a long document's links are counted as they come
            self.count()

    def count(self) -> None:
        """Its links so far as distinct pairs with their numbers."""
        codes, back = np.unique(np.concatenate([self.codes, *self.links]), return_inverse=True)
        self.times = np.bincount(back, weights=np.concatenate([self.times, np.ones(len(back) - len(self.codes))])).astype(np.int64)
        self.codes, self.links, self.kept = codes, [], max(self.n_links, SEGMENT)

    def rows(self) -> list[tuple]:
        self.close()
        self.count()
        digest = self.digest.hexdigest() if self.groups else ""
        a, b = (self.codes >> 32).astype(np.int32), (self.codes & 0xFFFFFFFF).astype(np.int32)
        return [(self.doc, *self.n, self.groups, self.n_links, digest, a, b, self.times.astype(np.int32))] * self.copies


def swept(a_path: str, b_path: str):
    """Events sorted by (document, offset, side) to a row for each document."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 3
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def sweep(batches):
        pair = loaded(a_path, b_path)
        now: Sweep | None = None
        for whole in batches:
            out, size = [], 0
            for doc, key, start, side, ids in zip(*(whole.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "side", "ids"))):
                if now is None or (doc, key) != (now.doc, now.key):
                    out += now.rows() if now else []
                    size += 12 * len(out[-1][-1]) if out else 0
                    now = Sweep(doc, key, pair)
                elif start < 0:
                    now.copies += 1
                if start >= 0:
                    now.take(start, side, ids)
                if size > 16 * SEGMENT:
                    yield packed(out)
                    out, size = [], 0
            yield packed(out)
        if now is not None:
            yield packed(now.rows())

    return sweep


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b"))
    return a << 32 | b


def pair_counts(batches):
    """(a, b, n): the links of a task, counted; bounded by the vocabularies."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        codes, back = np.unique(np.concatenate([codes, codes_of(batch)]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, batch.column("times").flatten().to_numpy()]), minlength=len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])


def counted(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of the corpus hold a pair, and whether no pair of that b has more."""
    pairs = links.select("a", "b", "times").mapInArrow(pair_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = staged(pairs)
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times) for every row of docs; a, b, times are its different linked id pairs with their numbers."""
    n = partitions(docs.sparkSession)
    events = keyed(docs).mapInArrow(token_ends(a_path, b_path), EVENTS)
    order = ("doc_id", "text_key", "start", "side")
    return events.repartition(n, "doc_id", "text_key").sortWithinPartitions(*order).mapInArrow(swept(a_path, b_path), ALIGNED)


def scored(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum in place of their pairs."""
    found = pairs.toArrow()  # at most pair_bound() rows
    code = found.column("a").to_numpy() << 32 | found.column("b").to_numpy()
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast((code[order], found.column("n").to_numpy()[order], found.column("best").to_numpy()[order]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches):
        codes, counts, best = shared.value
        for batch in batches:
            at = np.searchsorted(codes, codes_of(batch))
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(batch.column("times").value_lengths().to_numpy(zero_copy_only=False))])
            running = [np.concatenate([[0], np.cumsum(times * values[at])]) for values in (best, counts)]
            sums = [pa.array(total[ends[1:]] - total[ends[:-1]]) for total in running]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "n_best", "count_sum"])

    return rows.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op13(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    rows = staged(aligned(table(spark, sf_dir, "documents"), f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"))
    return scored(rows, counted(rows))
