"""Language identification by error-correcting output codes.

Every learned language gets a codeword; each bit of it is a binary classifier over
letter n-grams (2 to 4 bytes of the lower-cased text, words set apart by one space,
hashed into BUCKETS buckets an order).  A bit's classifier is the log odds of a gram
between the languages that have the bit and those that have not, averaged over the
grams of a text.  Counts of all learnable text come from one pass with a partial sum
in every task.  A second pass, over the half of the learnable documents kept for it,
measures how far each classifier's margins spread and how often it errs; both enter
the decoding: the predicted language is the one whose codeword has the least loss,
log(1 + exp(-2 * bit * margin)), weighted by the log odds of the bit being right.
The score is the best language's share of exp(-loss); below AMBIGUOUS the row is
flagged, since another codeword is nearly as close.

Learnable are rows with text, lang and doc_id whose fold (crc32 of the decimal
doc_id modulo FOLDS) is not HELD_OUT.  Null texts and texts without a letter are
``und`` with score 0, as is everything where nothing can be learned; where one
language is learned it is predicted, with score 1.  Ties go to the first language by
code point.  A null doc_id is not held out and not learned from.  Repeated rows get
equal predictions; whole texts count, however long.  Columns other than doc_id, text
and lang take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.common import SLICE_BYTES, columns_of, partitions, slices, table, text_bytes

FOLDS, HELD_OUT, CALIBRATE = 3, 1, 2
ORDERS = (2, 3, 4)
BITS = 16
BUCKETS = 1 << BITS
FEATURES = BUCKETS * len(ORDERS)
#: Weight of the mean over languages in a language's gram probabilities: bounds every log odds by about log(1 / SMOOTH).
SMOOTH = 0.01
AMBIGUOUS = 0.75
#: More labels than this are refused: the model holds FEATURES counts for each.
MOST_LANGUAGES = 128
#: Up to so many languages have a bit for every way to part them in two.
EXHAUSTIVE = 5
#: Counts of one row of a partial sum.
BLOCK = 1 << 13
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS.flags.writeable = False


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1: all ways to part the languages while they are few, else the widest apart of seeded random codes."""
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << max(n - 1, 0))
        return np.where((bits[None] >> np.arange(n)[:, None]) & 1, -1, 1).astype(np.int8)
    width, rng = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(100):
        code = rng.permuted(np.where(np.arange(n)[:, None] < n // 2, 1, -1) * np.ones((n, width), np.int8), axis=0).astype(np.int8)
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        least = (width - int(agree[~np.eye(n, dtype=bool)].max())) // 2
        if least > apart:
            best, apart = code, least
    return best


def letters_only(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with one space between words and around each text: (bytes, place of the space before each text, and after the last)."""
    spaced = np.insert(_LETTERS[data], offsets, 32)
    gap = spaced == 32
    keep = np.ones(len(spaced), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])  # a run of spaces, those put in included, is one
    return spaced[keep], np.cumsum(keep)[offsets + np.arange(len(offsets))] - 1


def grams(data: np.ndarray, offsets: np.ndarray):
    """(text, feature) of all grams of the texts, in blocks of bounded size whatever the texts' lengths."""
    clean, first = letters_only(data, offsets)
    padded = np.concatenate([clean, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    for lo in range(0, max(len(clean) - 1, 0), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, len(clean) - 1)
        at = np.arange(lo, hi)
        text = np.searchsorted(first, at, side="right") - 1
        end = first[text + 1] + 1
        code = padded[lo:hi]
        for k in range(1, max(ORDERS)):
            code = code << np.uint32(8) | padded[lo + k : hi + k]
            if (order := k + 1) in ORDERS:
                whole = at + order <= end
                bucket = code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
                yield text[whole], bucket[whole].astype(np.int64) + ORDERS.index(order) * BUCKETS


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, fold, held_out, text): texts lower-cased, null where no letter is in them."""
    fold = fold_of(F.col("doc_id"))
    held_out = F.coalesce(fold == HELD_OUT, F.lit(False))
    text = F.when(F.rlike("text", F.lit(r"\p{L}")), F.lower("text"))
    return columns_of(docs, "doc_id", "text", "lang").select("doc_id", "lang", fold.alias("fold"), held_out.alias("held_out"), text.alias("text"))


def gram_counts(languages: list[str]):
    def count(batches):
        total = np.zeros((len(languages), FEATURES), dtype=np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for whole in batches:
            for batch in slices(whole):
                of = np.array([index[x] for x in batch.column("lang").to_pylist()])
                present, local = np.unique(of, return_inverse=True)
                for text, feature in grams(*text_bytes(batch.column("text"))):
                    found = np.bincount(local[text] * FEATURES + feature, minlength=len(present) * FEATURES)
                    total[present] += found.reshape(len(present), FEATURES)
        seen = np.flatnonzero(total.any(axis=1))
        for i in seen:
            blocks = total[i].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), i)), pa.array(np.arange(len(blocks))), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], names=["lang", "block", "counts"]
            )

    return count


def summed(batches):
    """Partial sums of (lang, block) rows that are together in a partition."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for lang, block, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts"))):
            total[lang, block] = total.get((lang, block), 0) + np.frombuffer(zlib.decompress(counts), np.int64)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["lang", "block", "counts"]
    )


def log_odds(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One row of FEATURES weights for each bit: every language counts alike on its side, whatever its size."""
    share = np.empty(counts.shape)
    for i in range(len(ORDERS)):
        part = np.s_[:, i * BUCKETS : (i + 1) * BUCKETS]
        share[part] = counts[part] / np.maximum(counts[part].sum(1, keepdims=True), 1)
    share = (1 - SMOOTH) * share + SMOOTH * (share.mean(0) + 1e-3 / BUCKETS)
    return np.stack([np.log(share[bit > 0].mean(0) / share[bit < 0].mean(0)) for bit in code.T]).astype(np.float32) if code.shape[1] else np.zeros((0, counts.shape[1]), np.float32)


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(text, bit): the mean log odds over a text's grams; 0 without grams."""
    n = len(offsets) - 1
    total, seen = np.zeros((n, len(weights))), np.zeros(n)
    for text, feature in grams(data, offsets):
        if len(text):
            begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            owner = text[begins]
            seen[owner] += np.diff(np.append(begins, len(text)))
            for b, w in enumerate(weights):
                total[owner, b] += np.add.reduceat(w[feature], begins, dtype=np.float64)
    return total / np.maximum(seen, 1)[:, None]


class Model:
    """languages, their codewords, a row of log odds for each bit, and each bit's spread and weight."""

    def __init__(self, languages: list[str], code: np.ndarray, odds: np.ndarray, spread: np.ndarray, weight: np.ndarray):
        self.languages, self.code, self.odds, self.spread, self.weight = languages, code, odds, spread, weight

    def decoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text."""
        z = margins(data, offsets, self.odds) / self.spread
        loss = np.stack([(np.logaddexp(0, -2 * z * word) * self.weight).sum(1) for word in self.code], axis=1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best]


def calibrated(rows: DataFrame, languages: list[str], code: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bit's mean distance from 0 and its weight, from all rows; languages count alike."""
    shared = rows.sparkSession.sparkContext.broadcast((languages, code, odds))

    def measure(batches):
        names, words, weights = shared.value
        index = {x: i for i, x in enumerate(names)}
        total = np.zeros((len(names), 2 * len(weights) + 1))
        for whole in batches:
            for batch in slices(whole):
                of = np.array([index[x] for x in batch.column("lang").to_pylist()])
                m = margins(*text_bytes(batch.column("text")), weights)
                np.add.at(total, of, np.hstack([np.abs(m), m * words[of] <= 0, np.ones((len(of), 1))]))
        for i in np.flatnonzero(total[:, -1]):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([total[i].tolist()], pa.list_(pa.float64()))], names=["lang", "sums"])

    # decimals: their sums do not depend on the order of the tasks
    found = rows.mapInArrow(measure, "lang long, sums array<double>")
    width = 2 * len(odds) + 1
    added = found.groupBy("lang").agg(*[F.sum(F.col("sums")[k].cast("decimal(30,9)")).cast("double").alias(f"s{k}") for k in range(width)]).orderBy("lang").collect()
    if not added or not len(odds):
        return np.ones(len(odds)), np.ones(len(odds))
    sums = np.array([[r[f"s{k}"] for k in range(width)] for r in added])
    n, docs = len(odds), sums[:, -1:]
    spread = (sums[:, :n] / docs).mean(0)
    error = ((sums[:, n : 2 * n] + 0.5) / (docs + 1)).mean(0)
    return np.maximum(spread, 1e-6), np.log((1 - np.minimum(error, 0.499)) / np.minimum(error, 0.499))


def learned(docs: DataFrame) -> Model | None:
    """A model of all learnable rows, None if there is none."""
    spark = docs.sparkSession
    rows = learnable(docs).where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    languages = sorted(r["lang"] for r in names)
    if not languages:
        return None
    parts = rows.select("lang", "text").mapInArrow(gram_counts(languages), "lang long, block long, counts binary")
    sums = parts.repartition(partitions(spark), "lang", "block").mapInArrow(summed, "lang long, block long, counts binary").toArrow()
    counts = np.zeros((len(languages), FEATURES), dtype=np.int64)
    for lang, block, found in zip(*(sums.column(c).to_pylist() for c in ("lang", "block", "counts"))):
        counts[lang, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(found, np.int64)
    code = codewords(len(languages))
    odds = log_odds(counts, code)
    return Model(languages, code, odds, *calibrated(rows.where(F.col("fold") == CALIBRATE).select("lang", "text"), languages, code, odds))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row of docs."""
    rows = learnable(docs).select("doc_id", "held_out", "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole):
                best, score = m.decoded(*text_bytes(batch.column("text")))
                known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
                score = np.where(known, score, 0.0)
                names = [m.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
                )

    return rows.mapInArrow(decode, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs))

