"""Operators 11, 12 and 13."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from orrery.llm import cross_tokens, fill_middle, language
from tests.compare import connect, difference
from tests.llm.brute import sha

SF = "/root/testdata/sf0.001"
CLASHING = ("1 AS n", "'x' AS form", "2 AS fold", "'y' AS held_out", "3 AS start", "4 AS ids", "5 AS text_key", "6 AS units", "7 AS score", "8 AS a")


def docs_of(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", *CLASHING)


def write(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- 11 ---


def test_codewords_stand_apart():
    for n in (1, 2, 4, 5, 6, 17):
        code = language.codewords(n).astype(int)
        assert code.shape[0] == n and (code == language.codewords(n)).all()
        assert all(0 < (bit > 0).sum() < n for bit in code.T)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert not apart or min(apart) >= (2 ** (n - 2) if n <= 5 else 5)


def plain_margins(texts, weights):
    """The mean log odds over grams, gram by gram."""
    out = []
    for t in texts:
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in t.encode())
        raw = b" " + b" ".join(raw.split(b" ")) + b" "
        raw = re.sub(rb" +", b" ", raw)
        total, n = np.zeros(len(weights)), 0
        for k, order in enumerate(language.ORDERS):
            for i in range(len(raw) - order + 1):
                h = int.from_bytes(raw[i : i + order], "big") * 0x9E3779B1 % (1 << 32) >> (32 - language.BITS)
                total += weights[:, k * language.BUCKETS + h]
                n += 1
        out.append(total / max(n, 1))
    return np.array(out)


def test_margins_gram_by_gram(monkeypatch):
    import pyarrow as pa

    from orrery.llm.common import text_bytes

    weights = np.random.default_rng(5).normal(size=(3, language.FEATURES)).astype(np.float32)
    texts = ["", "a", " one  Two,3 drei ", "...", "é ü", "", "x" * 50 + " y" * 40, "99"]
    for size in (7, 1 << 20):
        monkeypatch.setattr(language, "SLICE_BYTES", size)
        got = language.margins(*text_bytes(pa.array(texts)), weights)
        assert np.allclose(got, plain_margins(texts, weights), atol=1e-5)


def test_languages_held_out(spark):
    """Learned from two thirds, right on the last third; lang and source of the predicted rows change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learned(docs)
    got = {r["doc_id"]: r for r in language.predicted(docs.drop("lang", "source").withColumn("lang", F.lit("x")), model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.98 * len(held)
    # labels of the held-out third are never read
    blind = docs.withColumn("lang", F.when(language.fold_of(F.col("doc_id")) == 1, "zz").otherwise(F.col("lang")))
    again = language.learned(blind)
    assert again.languages == model.languages and np.array_equal(again.odds, model.odds) and np.array_equal(again.weight, model.weight)


def test_languages_of_odd_tables(spark, tmp_path):
    rows = [(i, "le chat et la souris " * 3 if i % 2 else "the cat and the mouse " * 3, "fr" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "fr"), (101, "", "en"), (102, "12 % \n ", "en"), (103, "la souris", None), (None, "the cat", "en"), (0, "the cat and the mouse", "en"), (0, "the cat and the mouse", "en"), (104, "Ж", "ru")]
    rows += [(105, "the mouse " * 200_000, None), (106, "٣", None)]
    out = language.op11(spark, write(docs_of(spark, rows).repartition(3), tmp_path)).collect()
    assert len(out) == len(rows)
    got = collections.defaultdict(set)
    for r in out:
        got[r["doc_id"]].add((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1
    for i in (100, 101, 102, 106):
        assert got[i] == {("und", 0.0)}
    assert {x for x, _ in got[103]} == {"fr"} and {x for x, _ in got[None]} == {"en"} and {x for x, _ in got[105]} == {"en"} and len(got[0]) == 2
    one = language.op11(spark, write(docs_of(spark, [(0, "the cat", "en"), (1, "x", "fr"), (5, "y", None)]), tmp_path)).collect()
    learned = {r["lang"] for r in docs_of(spark, [(0, "the cat", "en"), (1, "x", "fr")]).where(language.fold_of(F.col("doc_id")) != 1).collect()}
    assert {r["lang_pred"] for r in one} <= learned | {"und"}
    assert language.op11(spark, write(docs_of(spark, []), tmp_path)).collect() == []
    none = language.op11(spark, write(docs_of(spark, [(0, "a", None), (1, None, None)]), tmp_path)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


# --- 12 ---


def plain_arrangement(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc is None else doc}")
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


ODD = ["", None, "\n", "\n\n\n", "a", "a\nb", "a\r\nb\x0b c\n", "é😀\n" * 9, "x <P> y\nz", "<S>", "<M>", "<P", "a<\nP>\nb<\n\n<", "tail<\n", "line\n" * 50_000, "long " * 100_000, "q"]


def test_fill_in_middle(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(ODD * 12)] + [(None, "a\nb\nc\n", None), (3, "a\nb\nc\nd", "en"), (3, "a\nb\nc\nd", "en")]
    docs = docs_of(spark, rows)
    got = fill_middle.arranged(docs)
    back = got.select(fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *plain_arrangement(i, t)) for i, t, _ in rows), key=key)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    write(docs, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(fill_middle.op12(spark, str(tmp_path)).toPandas(), con.execute(fill_middle.OP12_SQL).df()) == ""
    assert fill_middle.arranged(docs.limit(0)).collect() == []
    assert {r["form"] for r in fill_middle.arranged(docs, rate=0).collect()} == {"plain"}


def test_fill_in_middle_sql(spark):
    assert difference(fill_middle.op12(spark, SF).toPandas(), connect(SF).execute(fill_middle.OP12_SQL).df()) == ""


# --- 13 ---

FILES = f"{cross_tokens.FOLDER}/{cross_tokens.A_FILE}", f"{cross_tokens.FOLDER}/{cross_tokens.B_FILE}"


def plain_alignment(rows):
    """Whole texts encoded at once, events met by a set of ends; rows are (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True  # their strings are plain text
    chars = cross_tokens.byte_of_char()
    a_bytes = {i: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t, i in a.get_vocab().items()}
    out, links = [], []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        parts = [a_bytes[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or any(b"".join(p) != f" {text}".encode() for p in parts):
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for side, ids in ((0, ids_a), (1, ids_b)):
            for i, e in zip(ids, ends[side]):
                groups[bisect.bisect_left(common, e)][side].append(str(i))
        links.append([(x, y) for x, e in zip(ids_a, ends[0]) for y, f in zip(ids_b, ends[1]) if e == f] if len(ids_a) < 500 else [(int(g[0][-1]), int(g[1][-1])) for g in groups])
        out.append((len(ids_a), len(ids_b), len(common), sha(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups))))
    count = collections.Counter(x for found in links for x in found)
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((d is None, d or 0), n_a, n_b, groups, len(l), sum(count[x] == most[x[1]] for x in l), sum(count[x] for x in l), digest) for (d, _), (n_a, n_b, groups, digest), l in zip(rows, out, links))


def results(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert results(cross_tokens.op13(spark, SF)) == plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])


def odd_texts(seed=9, n=250):
    rng = random.Random(seed)
    bits = ["the", "The", " ", "  ", "\n", " \n", "\t", "'s", "don't", "é", "ß", "😀", "中文", "123", "4", "...", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", " ", " ", "\x1c", "\x85", "ſ", "é", "token", "ization", "ﬁ", "\x00", "_", "-", "　"]
    texts = ["".join(rng.choice(bits) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return [*texts, "", None, " ", "▁", "a ▁ b", "x▁y", "same text", "same text"]


def test_alignment_of_odd_texts(spark, tmp_path, monkeypatch):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "another text"), (1, "one row twice"), (1, "one row twice"), (None, "no id"), (None, None), (900, "a long one " * 20_000), (901, "x" * 3000)]
    docs = docs_of(spark, rows, "doc_id long, text string").repartition(3)
    got = results(cross_tokens.op13(spark, write(docs, tmp_path)))
    want = plain_alignment(rows)
    assert got == want
    assert any(r[1] == 0 for r in want) and results(cross_tokens.op13(spark, write(docs.limit(0), tmp_path))) == []


def test_groups_span_rows_of_events():
    """A group that is still open at the end of a row goes on in the next one."""
    import zstandard

    pair = cross_tokens.loaded(*FILES)
    text = " abcdefg" * 3 + " 中文字"
    a, b = (np.frombuffer(x, pair.kind) for x in pair.encoded([text[1:]])[0])
    whole, parted = (cross_tokens.Sweep(1, 2, pair) for _ in range(2))
    pack = lambda x: zstandard.compress(x.astype(pair.kind).tobytes())
    whole.take(0, 0, pack(a))
    whole.take(0, 1, pack(b))
    events = []
    for side, ids in ((0, a), (1, b)):
        ends = np.cumsum(pair.tables[side][ids])
        events += [(int(e - pair.tables[side][i]), side, pack(np.array([i]))) for i, e in zip(ids, ends)]
    for e in sorted(events):
        parted.take(*e)
    left, right = whole.rows()[0], parted.rows()[0]
    assert left[:6] == right[:6] and all((x == y).all() for x, y in zip(left[6:], right[6:])) and left[3] > 3


def test_pairs_are_bounded(spark):
    pair = cross_tokens.loaded(*FILES)
    assert pair.may_cut and pair.pair_bound() < 500_000
    ends = cross_tokens.aligned(spark.read.parquet(f"{SF}/documents.parquet"), *FILES).select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b").distinct().collect()
    for r in ends:
        x, y = pair.a_bytes[r["a"]], pair.b_bytes[r["b"]]
        assert x.endswith(y) or y.endswith(x)


def test_stretches_equal_whole_texts(monkeypatch):
    """Cutting at single spaces changes no token."""
    pair, cuts = cross_tokens.loaded(*FILES), 0
    for t in odd_texts(4, 200):
        if t:
            whole = pair.encoded([t])[0]
            monkeypatch.setattr(cross_tokens, "SEGMENT", 5)
            parts = pair.stretches(t)
            monkeypatch.setattr(cross_tokens, "SEGMENT", 1 << 16)
            cuts += len(parts) - 1
            assert " ".join(parts) == t
            for cut in (parts, [w for own in pair.words(parts) for w in own]):
                found = pair.encoded(cut)
                assert " ".join(cut) == t and (None in found) == (whole is None)
                if whole:
                    assert all(b"".join(x[at] for x in found) == whole[at] for at in (0, 1))
    assert cuts > 200


def test_every_code_point_encodes_as_the_file_says():
    """Ranks with the stated pattern against the file's own library, each code point among letters, digits, signs and spaces."""
    from tokenizers import Tokenizer

    pair, own = cross_tokens.loaded(*FILES), Tokenizer.from_file(FILES[0])
    own.encode_special_tokens = True
    for lo in range(0, 0x110000, 1 << 14):
        probes = [f" a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)} {chr(c)}{chr(c)}" for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
        for x, want in zip(probes, own.encode_batch(probes, add_special_tokens=False)):
            assert pair.a.encode_ordinary(x) == want.ids
