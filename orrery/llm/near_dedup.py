"""MinHash near-dedup by a multi-index Hamming join.

Signatures have SYMBOLS minima of 32 bits.  Cut into chunks of four, two
signatures that differ in at most RADIUS symbols have, by pigeonhole, a chunk with
at most one difference; each chunk is indexed four times, once with each symbol
left out, so every such pair shares a key.  At similarity 0.75 a pair stays within
RADIUS but for a chance of about 1e-6.  Every link is confirmed on full sets.

Documents with equal sets are one class from the start.  Classes that share a key,
directly or over others, come together, and their signatures are compared: those
that differ in at most RADIUS symbols, directly or over others, are candidates.
Only candidates' texts move, and an inverted index of their shingles counts the exact
intersections.  Both comparisons go in blocks of bounded size, every two blocks of a
large group in one place once; what is in one group already is not compared again.

Null, empty and blank texts have the empty set, n_shingles 0, and are their own
component.  Rows without doc_id take no part: component null, kept true.  Rows
that repeat a doc_id are one node of the graph, each with its own text's set, so
what they link to is one component.  ``representatives`` goes by texts instead: of the
rows whose texts link, directly or over other texts, those of the least doc_id stay,
so that a doc_id with two unlike texts never takes the copies of either away from
the corpus.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import binary_column, keyed, mix, partitions, slices, span_hashes, staged, table, text_bytes, window_hashes, word_spans, range_hash, prefix_hash, _TOKENS
from orrery.operators.graph import components

WORDS = 5
PERCENT = 75
CHUNK, CHUNKS = 4, 20
SYMBOLS = CHUNK * CHUNKS
RADIUS = 2 * CHUNKS - 1
#: Shingles of one block of candidates: what one task holds at a time, twice for a pair of blocks.
BLOCK_SHINGLES = 1_000_000
_MULTIPLIERS = np.random.default_rng(41).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    start, end, first = word_spans(data, offsets)
    tokens = span_hashes(data, start, end, lower=True)
    hashes, _, _ = window_hashes(tokens, first, words)
    counts = np.maximum(np.diff(first) - words + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    prefix = prefix_hash(tokens, _TOKENS)
    out = []
    for i in range(len(first) - 1):
        if counts[i]:
            out.append(np.unique(hashes[at[i] : at[i + 1]]))
        elif first[i + 1] > first[i]:
            out.append(range_hash(prefix, first[i : i + 1], first[i + 1 : i + 2], _TOKENS))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS minima of each set, their upper 32 bits; zeros for the empty set."""
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, a in enumerate(_MULTIPLIERS):
            out[full, k] = np.minimum.reduceat(values * a, at) >> np.uint64(32)
    return out


def describe(batches):
    """(doc_id, text_key, n_shingles, h1, h2, sig): size, two sums that name the set, signature."""
    for whole in batches:
        for batch in slices(whole):
            sets = shingle_sets(*text_bytes(batch.column("text")))
            sig = signatures(sets)
            h1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64)
            h2 = np.array([int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                binary_column(sig.ravel(), np.arange(len(sets) + 1) * SYMBOLS),
            ], names=["doc_id", "text_key", "n_shingles", "h1", "h2", "sig"])


def keys_of(batches):
    """(key, id): each chunk of a signature with each of its symbols left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, _ = text_bytes(batch.column("sig"))
        sig = raw.view(np.uint32).reshape(-1, SYMBOLS).astype(np.uint64)
        out = []
        for c in range(CHUNKS):
            part = sig[:, c * CHUNK : (c + 1) * CHUNK]
            for left_out in range(CHUNK):
                h = np.full(len(sig), np.uint64(c * CHUNK + left_out + 1))
                for j in range(CHUNK):
                    if j != left_out:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
                out.append(h)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(ids, len(out)))], names=["key", "id"])


def shared_keys(batches):
    """Rows sorted by (key, id) to (lead, id) of each key's least id and its others; a single row is kept between batches."""
    last_key = last_lead = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        lead = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        if last_key is not None and key[0] == last_key:
            lead[key == last_key] = last_lead
        last_key, last_lead = key[-1], lead[-1]
        give = lead != ids
        yield pa.RecordBatch.from_arrays([pa.array(lead[give]), pa.array(ids[give])], names=["src", "dst"])


def similar(sets: list[np.ndarray]):
    """linked(i, others): which of others reach the similarity to set i, by exact intersections from an inverted index."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    last, both = -1, sizes

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        nonlocal last, both
        if i != last:
            terms = term[at[i] : at[i + 1]]
            lo, n = starts[terms], starts[terms + 1] - starts[terms]
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            last, both = i, np.bincount(posting[where], minlength=len(sets))
        return 100 * both[others] >= PERCENT * (sizes[i] + sizes[others] - both[others])

    return linked


def within_radius(rows: list[np.ndarray]):
    """linked(i, others): which of others, ascending, differ from signature i in at most RADIUS symbols."""
    symbols = np.ascontiguousarray(np.stack(rows).T)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        lo, hi = others[0], others[-1] + 1
        return np.add.reduce(symbols[:, lo:hi] != symbols[:, i : i + 1], axis=0, dtype=np.uint8)[others - lo] <= RADIUS

    return linked


def joined(left: np.ndarray, right: np.ndarray, linked) -> np.ndarray:
    """Each item's group, the least index in it, over links between items marked left and items marked right.

    What is already in one group is not compared: near copies of one text cost one comparison each.
    """
    label = np.arange(len(left))
    within = np.array_equal(left, right)
    for i in np.flatnonzero(left).tolist():
        apart = right & (label != label[i])
        if within:
            apart[: i + 1] = False
        others, size = np.flatnonzero(apart), 64
        while len(others):
            now, others = others[:size], others[size:]
            found = now[linked(i, now)]
            if len(found):
                touched = np.unique(np.append(label[found], label[i]))
                label[np.isin(label, touched)] = touched[0]
                others = others[label[others] != label[i]]
            size *= 4
    return label


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The symbols of each signature."""
    return list(data.view(np.uint32).reshape(-1, SYMBOLS))


def links_of(column: str, elements_of, links):
    """Rows (cluster, lo, hi, block, id, column) sorted by (cluster, lo, hi) to (src, dst): what a pair of blocks joins, as the least id of each group and its others."""

    def solve(rows):
        _, lo, hi = rows[0][0]
        rows = sorted(rows, key=lambda r: r[2])
        block, ids = np.array([r[1] for r in rows]), [r[2] for r in rows]
        label = joined(block == lo, block == hi, links([r[3] for r in rows]))
        return [(ids[k], ids[i]) for i, k in enumerate(label.tolist()) if i != k]

    def work(batches):
        group: list[tuple] = []
        seen: set[int] = set()
        for whole in batches:
            out = []
            for batch in slices(whole, column):
                described = elements_of(*text_bytes(batch.column(column)))
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "lo", "hi"))))
                for key, block, member, elements in zip(keys, batch.column("block").to_pylist(), batch.column("id").to_pylist(), described):
                    if group and group[0][0] != key:
                        out += solve(group)
                        group, seen = [], set()
                    if member not in seen:  # equal rows bring a text more than once
                        group.append((key, block, member, elements))
                        seen.add(member)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])
        if group:
            out = solve(group)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return work


def in_blocks(members: DataFrame) -> DataFrame:
    """members (cluster, id, size, more) as (cluster, lo, hi, block, id, more): once for each pair of blocks that theirs is in."""
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other", "size")


def links_in_blocks(met: DataFrame, column: str, elements_of, links) -> DataFrame:
    """(src, dst), written, of rows as ``in_blocks`` gives them."""
    dealt = met.select("cluster", "lo", "hi", "block", "id", column).repartition(partitions(met.sparkSession), "cluster", "lo", "hi")
    return staged(dealt.sortWithinPartitions("cluster", "lo", "hi").mapInArrow(links_of(column, elements_of, links), "src long, dst long"))


def candidates(classes: DataFrame) -> DataFrame:
    """(id, cluster) of classes (id, sig) with another's signature within RADIUS; a cluster holds all that are so near, directly or over others."""
    keys = classes.select("id", "sig").mapInArrow(keys_of, "key long, id long")
    dealt = keys.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "id")
    stars = staged(dealt.mapInArrow(shared_keys, "src long, dst long").distinct())
    met = components(stars).toDF("id", "cluster").join(classes.select("id", "sig"), "id").withColumn("size", F.lit(SYMBOLS))
    return components(links_in_blocks(in_blocks(staged(met)), "sig", symbols_of, within_radius)).toDF("id", "cluster")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, text_group, first) for every row: the group of its text over links between texts, null without words, and the least doc_id there."""
    docs = keyed(docs)
    all_rows = staged(docs.mapInArrow(describe, "doc_id long, text_key long, n_shingles long, h1 long, h2 long, sig binary"))
    least = F.struct("doc_id", "text_key")
    classes = all_rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min_by("sig", least).alias("sig"), F.min(least).alias("least"))
    classes = staged(classes.select(F.xxhash64("n_shingles", "h1", "h2").alias("id"), "n_shingles", "h1", "h2", "sig", "least.doc_id", "least.text_key"))
    cluster = staged(candidates(classes).join(classes.select("id", F.col("n_shingles").alias("size"), "doc_id", "text_key"), "id"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    met = in_blocks(cluster).hint("merge").join(texts, ["doc_id", "text_key"])
    edges = links_in_blocks(met, "text", shingle_sets, similar)
    placed = classes.join(components(edges), "id", "left").select("n_shingles", "h1", "h2", "doc_id", F.coalesce("component", "id").alias("text_group"))
    firsts = placed.groupBy("text_group").agg(F.min("doc_id").alias("first"))
    found = placed.drop("doc_id").join(firsts, "text_group")
    of_row = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = all_rows.drop("sig").join(found, ["n_shingles", "h1", "h2"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(of_row, F.col("text_group")).alias("text_group"), F.when(of_row, F.col("first")).alias("first"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    rows = staged(grouped(docs))
    # groups of texts that one doc_id joins
    ends = rows.groupBy("doc_id").agg(F.min("text_group").alias("src"), F.max("text_group").alias("dst")).where("src <> dst")
    joined = components(rows.join(ends.select("doc_id", "src"), "doc_id").select("src", F.col("text_group").alias("dst"))).toDF("text_group", "joined")
    firsts = rows.where("text_group IS NOT NULL").groupBy("text_group").agg(F.first("first").alias("first")).join(joined, "text_group")
    firsts = firsts.join(firsts.groupBy("joined").agg(F.min("first").alias("component")), "joined").select("text_group", "component")
    of_doc = rows.where("doc_id IS NOT NULL").join(firsts, "text_group", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "first", "doc_id")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose text links to a text of a smaller doc_id, unchanged."""
    gone = grouped(docs).where("doc_id <> first").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_key")), "left_anti").select(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM w, unnest(range(1, greatest(len(w) - 3, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM ways UNION SELECT reach.id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.id = w.doc_id
"""
