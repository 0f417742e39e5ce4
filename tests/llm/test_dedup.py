"""Operators 5, 6, 7 and 10 against plain versions, and their odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import line_dedup, near_dedup, repeats, substring_dedup, suffix_dedup
from orrery.llm.common import line_spans, slices, span_hashes, text_bytes, word_spans
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def frame(spark, docs):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(docs, SCHEMA).repartition(3).selectExpr("doc_id", "text", "1 AS lo", "'x' AS spans", "2 AS id", "3 AS component", "4 AS anchor")


@pytest.fixture(scope="module")
def docs():
    return brute.corpus()


def test_substrings(spark, docs):
    for width in (50, 7):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in substring_dedup.cut(frame(spark, docs), width).collect()}
        assert got == brute.words_cut(docs, width)


def test_suffixes(spark, docs):
    for width, gram in ((400, 128), (60, 20)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in suffix_dedup.cut(frame(spark, docs), width, gram).collect()}
        assert got == brute.bytes_cut(docs, width)


def test_suffixes_in_blocks(spark, docs, monkeypatch):
    """An anchor with more contexts than one block holds is sorted by pairs of blocks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdef ") for _ in range(900))
    near = [(1000 + i, base[: 20 * i] + "#" + base[20 * i :]) for i in range(40)]
    for rows in (docs, near):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in suffix_dedup.cut(frame(spark, rows), 60, 20).collect()}
        assert got == brute.bytes_cut(rows, 60)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 17, 100, 301):
        for high in (2, 3, 50):
            s = rng.integers(1, high, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.linked(frame(spark, docs)).collect()}
    assert got == brute.near_components(docs)


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.linked(frame(spark, docs)).collect()}
    assert got == brute.near_components(docs)


def test_a_doc_id_with_unlike_texts(spark):
    """What a doc_id's rows link to is one component; no text leaves the corpus with it."""
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    near = a.replace("a7 ", "other ")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, b + "more"), (5, c), (8, c), (5, ""), (6, ""), (11, near), (12, "apart " + c[:90]), (None, a)]
    got = sorted((str(r["doc_id"]), r["n_shingles"] > 0, r["component_id"]) for r in near_dedup.linked(frame(spark, rows)).collect())
    of = {1: 1, 5: 1, 7: 1, 9: 1, 8: 1, 6: 6, 11: 1, 12: 12, None: None}
    assert got == sorted((str(d), bool(t.strip()), of[d]) for d, t in rows if d is not None) + [("None", True, None)]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_dedup.representatives(frame(spark, rows)).collect())
    assert kept == sorted((str(d), t) for d, t in [(1, a), (5, b), (5, c), (5, ""), (6, ""), (12, "apart " + c[:90]), (None, a)])


def test_pairs_within_the_radius_share_a_key():
    import pyarrow as pa

    from orrery.llm.common import binary_column

    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (1, near_dedup.SYMBOLS), dtype=np.uint32)
    for _ in range(50):
        other = sig.copy()
        other[0, rng.choice(near_dedup.SYMBOLS, near_dedup.RADIUS, replace=False)] += 1
        rows = np.concatenate([sig, other])
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), binary_column(rows.ravel(), np.arange(3) * near_dedup.SYMBOLS)], names=["id", "sig"])
        out = next(near_dedup.keys_of([batch])).to_pandas()
        assert set(out[out.id == 0].key) & set(out[out.id == 1].key)


def test_signatures_beyond_the_radius_are_no_candidates(spark):
    """Texts that share a third of their words share keys, but not a signature within the radius."""
    import pyarrow as pa

    from orrery.llm.common import binary_column

    rng = np.random.default_rng(12)
    common = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.concatenate([common, rng.integers(0, 1 << 63, 240, dtype=np.uint64)]) for _ in range(120)]
    near = [np.concatenate([s[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for s in sets[:10]]
    sig = near_dedup.signatures(sets + near)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sig))), binary_column(sig.ravel(), np.arange(len(sig) + 1) * near_dedup.SYMBOLS)], names=["id", "sig"])
    keys = next(near_dedup.keys_of([batch])).to_pandas()
    sharing = {x for _, ids in keys.groupby("key").id if len(ids) > 1 for x in ids}
    assert len(sharing) > 100  # keys alone would bring nearly all together
    distance = (sig[:, None] != sig[None]).sum(axis=2)
    root = list(range(len(sig)))
    for i, j in zip(*np.nonzero(distance <= near_dedup.RADIUS)):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    want = {i: root[i] for i in range(len(sig)) if root.count(root[i]) > 1}
    for rows in (batch.to_pylist(), batch.to_pylist()[::-1]):
        got = {r["id"]: r["cluster"] for r in near_dedup.candidates(spark.createDataFrame([(r["id"], bytearray(r["sig"])) for r in rows], "id long, sig binary")).collect()}
        assert got == want and len(got) < 40 and all(got[i] == got[120 + i] for i in range(10))


def test_groups_within_and_between_blocks():
    rng = np.random.default_rng(4)
    for n in (1, 2, 90, 400):
        links = rng.random((n, n)) < 1.2 / n
        links |= links.T
        for left, right in ((np.ones(n, bool),) * 2, (np.arange(n) % 3 == 0, np.arange(n) % 3 > 0)):
            root = list(range(n))
            for i, j in zip(*np.nonzero(links & (left[:, None] & right | right[:, None] & left))):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
            assert near_dedup.joined(left, right, lambda i, others: links[i, others]).tolist() == root


def test_keys_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 7), (1, 9), (2, 4), (3, 1), (3, 2)]
    parts = [pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]])], names=["key", "id"]) for r in rows]
    out = [(x["src"], x["dst"]) for b in near_dedup.shared_keys(parts) for x in b.to_pylist()]
    assert out == [(5, 7), (5, 9), (1, 2)]


def test_grams_and_runs_of_one_text_do_not_depend_on_others():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.integers(97, 100, n)) for n in (700, 10, 900, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(range(4)), pa.array(texts)], names=["doc_id", "text_key", "text"])
    for combine in (True, False):
        work = suffix_dedup.runs_of(400, 128, combine)
        whole = [r for b in work([batch]) for r in b.to_pylist()]
        single = [r for b in work([batch.slice(i, 1) for i in range(4)]) for r in b.to_pylist()]
        key = lambda r: (r["doc_id"], r["start"])
        assert sorted(whole, key=key) == sorted(single, key=key) and sum(r["n"] for r in whole) == 301 + 501 + 1


THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))


def test_words_made_to_collide_are_told_apart(spark):
    """The Thue-Morse word and its complement meet under any polynomial modulo 2**64."""
    other = THUE_MORSE.translate(str.maketrans("ab", "ba"))
    for a, b in ((THUE_MORSE, other), (THUE_MORSE[:1024], other[:1024])):
        docs = [(1, " ".join([a] * 3 + [f"w{i}" for i in range(47)])), (2, " ".join([b] * 3 + [f"w{i}" for i in range(47)]))]
        assert [r["n_removed"] for r in substring_dedup.cut(frame(spark, docs)).collect()] == [0, 0]
        docs = [(1, f"{a} x y z u"), (2, f"{b} x y z u")]
        assert all(r["kept"] for r in near_dedup.linked(frame(spark, docs)).collect())
    # as sequences of words, for lines
    docs = [(1, " ".join(THUE_MORSE)), (2, " ".join(other))]
    assert {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect()} == dict(docs)


def test_rows_that_share_an_id_keep_what_is_their_own(spark):
    a, b, c, fresh = (" ".join(f"{x}{i}" for i in range(120)) for x in "abcf")
    docs = [(1, a), (5, f"{a} {c}"), (5, f"{b} {fresh}"), (7, c)]
    got = {r["kept"]: r["n_removed"] for r in substring_dedup.cut(frame(spark, docs)).collect()}
    assert got == {a: 0, c: 120, f"{b} {fresh}": 0, "": 120}
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.cut(frame(spark, docs + [(1, "short"), (2, a)])).collect())
    # the blank between a and c goes with neither: no 400-byte string with it starts twice
    sizes = {x: len(x) for x in (a, b, c, fresh)}
    assert got == sorted([(sizes[a], sizes[a])] * 2 + [(sizes[a] + sizes[c] + 1, sizes[a] + sizes[c]), (sizes[b] + sizes[fresh] + 1, 0), (sizes[c], sizes[c]), (5, 0)])
    docs = [(1, "one two three four five"), (5, "one two three four five\nown"), (5, "six seven eight nine ten\nfirst"), (1, "short")]
    got = sorted(r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect())
    assert got == ["one two three four five", "own", "short", "six seven eight nine ten\nfirst"]


def test_line_columns_of_the_same_name(spark):
    docs = frame(spark, [(1, "a b c d e\nx"), (2, "a b c d e")]).selectExpr("*", "'n' AS _n_lines", "9 AS _cut_id", "8 AS _n_removed", "7 AS text_key")
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_removed"], r["text_key"]) for r in line_dedup.rewritten(docs).collect()}
    assert got == {1: ("a b c d e\nx", 2, 0, 7), 2: ("", 1, 1, 7)}


def lines_cut(docs):
    """Each line goes if a run that holds it and a fingerprint matches from the fingerprint's first place."""
    texts = {i: t for i, t in docs if t is not None}
    lines = {i: [tuple(x.encode().split()) for x in t.split("\n")] for i, t in texts.items()}
    first = {}
    for i in sorted(lines):
        for k, line in enumerate(lines[i]):
            if len(line) >= line_dedup.LINE_WORDS:
                first.setdefault(line, (i, k))
    out = {}
    for i, own in lines.items():
        gone = set()
        for k, line in enumerate(own):
            if len(line) >= line_dedup.LINE_WORDS and first[line] < (i, k):
                j, m = first[line]
                other, lo, hi = lines[j], k, k + 1
                shift = k - m
                while lo > 0 and lo > shift and own[lo - 1] == other[lo - 1 - shift]:
                    lo -= 1
                while hi < len(own) and hi - shift < len(other) and own[hi] == other[hi - shift]:
                    hi += 1
                gone |= set(range(lo, hi))
        out[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
    return out


def test_lines(spark):
    docs = brute.corpus(2)
    got = {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect()}
    want = lines_cut(docs)
    assert {i: got[i] for i in want} == want and got[500] is None


def test_short_lines_go_in_runs(spark):
    run = "a b\nc\nd e\nf"
    docs = [(1, f"x x x x x\n{run}\ny"), (2, f"{run}\nz"), (3, "c"), (4, "a b\nq\nd e")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "z", 3: "c", 4: docs[3][1]}


def test_short_lines_beside_a_common_line(spark):
    """The common line's first place has other neighbours than the repeats."""
    common = "this line is in all documents"
    docs = [(1, f"{common}\nown text")] + [(i, f"top {i}\nHome\n{common}\nTerms apply.\nSee site.\nend {i}") for i in (2, 3, 4)]
    docs += [(5, f"b\n{common}\nTerms apply.\nother"), (6, "p\nq\nr"), (7, "x\np\nq\nr\ny")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "top 2\nHome\nTerms apply.\nSee site.\nend 2", 3: "top 3\nend 3", 4: "top 4\nend 4", 5: "b\nother", 6: "p\nq\nr", 7: "x\ny"}


def test_lines_with_any_earlier_copy_go(spark):
    """Against all pairs of places: what holds a long line or GRAM short ones goes, wherever the earlier copy is."""
    rng = random.Random(31)
    pool = ["a", "b b", "c", "d", "one two three four five", "six seven eight nine ten"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"u{rng.random()}" for _ in range(8))) for i in range(25)]
    lines = {i: t.split("\n") for i, t in docs}
    places = [(i, k) for i in sorted(lines) for k in range(8)]
    gone = set()
    for i, k in places:
        for j, m in places:
            if (j, m) >= (i, k):
                break
            n = 0
            while max(k, m) + n < 8 and lines[i][k + n] == lines[j][m + n]:
                n += 1
            run = lines[i][k : k + n]
            if len(run) >= line_dedup.GRAM or any(len(x.split()) >= line_dedup.LINE_WORDS for x in run):
                gone |= {(i, k + x) for x in range(n)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, docs)).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(own) if (i, k) not in gone) for i, own in lines.items()}


def test_winnowing_guarantee():
    """Shared runs of GRAM + 1 short lines share a fingerprint wherever they stand."""
    rng = np.random.default_rng(8)
    for _ in range(100):
        shared = rng.integers(0, 1 << 62, line_dedup.GRAM + 1, dtype=np.uint64)
        found = []
        for _ in range(2):
            a, b = (rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64) for _ in range(2))
            h = np.concatenate([a, shared, b])
            fp, _, _ = line_dedup.fingerprints(h, np.ones(len(h), int), np.array([0, len(h)]))
            found.append(set(fp.tolist()))
        assert found[0] & found[1]


@pytest.mark.parametrize("op", [lambda d: substring_dedup.cut(d), lambda d: suffix_dedup.cut(d), lambda d: near_dedup.linked(d), lambda d: line_dedup.rewritten(d), lambda d: near_dedup.representatives(d)])
def test_odd_tables(spark, op):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert op(empty).count() == 0
    odd = frame(spark, [(None, "a b c d e f"), (None, None), (1, None), (2, ""), (3, "word " * 2000), (3, "word " * 2000), (4, "w" * 200_000), (5, "\n" * 500)])
    assert op(odd).count() >= 7


def test_repeated_rows_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = substring_dedup.cut(frame(spark, [(7, text), (7, text), (9, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(7, 0), (7, 0), (9, 80)]


def test_spans_are_of_bytes():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["ab c", None, "", "d\ne", " "]))
    start, end, first = word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"d", b"e"] and first.tolist() == [0, 2, 2, 2, 4, 4]
    start, end, first = line_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab c", b"", b"", b"d", b"e", b" "] and first.tolist() == [0, 1, 2, 3, 5, 6]
    whole = span_hashes(data, *word_spans(data, offsets)[:2])
    parts = [span_hashes(*(lambda d, o: (d, *word_spans(d, o)[:2]))(*text_bytes(pa.array([t])))) for t in ("ab c", "d\ne")]
    assert whole.tolist() == np.concatenate(parts).tolist()
    assert sum(s.num_rows for s in slices(pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000] * 5)], names=["text"]))) == 5


def test_merged():
    assert repeats.merged([{"lo": 5, "hi": 7}, {"lo": 1, "hi": 3}, {"lo": 3, "hi": 4}, {"lo": 6, "hi": 9}]) == [(1, 4), (5, 9)]
    assert repeats.merged(None) == []
