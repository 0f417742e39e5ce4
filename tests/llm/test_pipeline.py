"""The pipeline against a plain one, stage by stage, on a corpus made for it."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import decontaminate, line_dedup, mixing, quality
from tests.llm import brute
from tests.llm.test_scans import kneser_ney

COMMON = "the of and to in is that for it with as was on be by at from or an are this not have but".split()


def corpus(seed: int = 4) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(documents, labels, benchmark): prose, junk, copies, near copies, shared lines, leaked items, missing values."""
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(COMMON) if rng.random() < 0.6 else rng.choice(rare) for _ in range(k))
    items = [(i, " ".join(rng.choice(rare) for _ in range(24))) for i in range(3)]
    line = say(12)
    docs: list[list] = []
    for i in range(260):
        text = say(rng.randint(30, 90))
        if i % 13 == 5:
            text = " ".join(f"#{rng.random()}|" for _ in range(60))
        elif i % 17 == 3:
            text = docs[-1][1]
        elif i % 19 == 4 and docs[-1][1]:
            words = docs[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 11 == 6:
            text = f"{say(20)}\n{line}\nshort {i}\n{say(15)}"
        elif i % 23 == 7:
            leaked = items[i % 3][1].split()
            leaked[5] = "other"
            text = f"{say(20)} {' '.join(leaked)} {say(20)}"
        docs.append([i * 2, text, "en", f"s{rng.randint(0, 4) % 4}"])
    docs += [[1001, None, "en", "s0"], [1003, "", None, None], [1005, say(40), "xx", "s1"], [1007, line, "en", "s2"]]
    rng.shuffle(docs)
    table = pd.DataFrame([(*d, len(d[1]) if d[1] is not None else None) for d in docs], columns=["doc_id", "text", "lang", "source", "n_chars"])
    labels = pd.DataFrame([(d[0], int(d[1] is None or not d[1].startswith("#")), 0) for d in docs if d[0] < 1000 and rng.random() < 0.9], columns=["doc_id", "quality", "toxic"])
    return table, labels, pd.DataFrame(items, columns=["item_id", "text"])


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def plain_quality(docs: list[tuple], labels: pd.DataFrame, fit: set) -> list[tuple]:
    """Rows (doc_id, text, lang, source): those above their language's limit go; a language without fitted text stays."""
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    score, held = {}, {}
    for lang in {d[2] for d in docs}:
        train = [words(d[1]) for d in docs if d[2] == lang and d[0] in good and d[0] in fit]
        if any(train):
            nll = kneser_ney([w for w in train if w], least=quality.LEAST)
            score |= {d[0]: (len(words(d[1])), nll(words(d[1]))) for d in docs if d[2] == lang and words(d[1])}
        held[lang] = [score[d[0]] for d in docs if d[2] == lang and d[0] in good - fit and d[0] in score]
    every = [x for h in held.values() for x in h]

    def limit(part):
        mean = sum(v for _, v in part) / sum(n for n, _ in part)
        ppl = sorted(math.exp((v + quality.PRIOR * mean) / (n + quality.PRIOR)) for n, v in part)
        return mean, ppl[math.ceil(quality.QUANTILE * len(ppl)) - 1] * quality.MARGIN

    out = []
    for d in docs:
        if d[0] in score:
            mean, most = limit(held[d[2]] if len(held[d[2]]) >= quality.LEAST_HELD else every)
            n, v = score[d[0]]
            if math.exp((v + quality.PRIOR * mean) / (n + quality.PRIOR)) > most:
                continue
        out.append(d)
    return out


def plain_lines(docs: list[tuple]) -> list[tuple]:
    """Every line goes that lies in a run with an earlier copy, if the run holds a long line or GRAM short ones; emptied texts go."""
    lines = {d[0]: d[1].split("\n") for d in docs if d[1] is not None}
    key = {i: [tuple(x.split()) for x in own] for i, own in lines.items()}
    places = sorted((i, k) for i, own in lines.items() for k in range(len(own)))
    by = {}
    for i, k in places:
        by.setdefault(key[i][k], []).append((i, k))
    gone = set()
    for i, k in places:
        for j, m in by[key[i][k]]:
            if (j, m) >= (i, k):
                break
            n = 0
            while k + n < len(key[i]) and m + n < len(key[j]) and key[i][k + n] == key[j][m + n]:
                n += 1
            run = key[i][k : k + n]
            if any(len(x) >= line_dedup.LINE_WORDS for x in run) or (sum(map(len, run)) and len(run) >= line_dedup.GRAM):
                gone |= {(i, k + x) for x in range(n)}
    out = []
    for d in docs:
        if d[1] is None or not any((d[0], k) in gone for k in range(len(lines[d[0]]))):
            out.append(d)
        elif any((d[0], k) not in gone for k in range(len(lines[d[0]]))):
            out.append((d[0], "\n".join(x for k, x in enumerate(lines[d[0]]) if (d[0], k) not in gone), *d[2:]))
    return out


def plain_near(docs: list[tuple]) -> list[tuple]:
    kept = brute.near_components([d[:2] for d in docs])
    return [d for d in docs if kept[d[0]][2]]


def plain_clean(docs: list[tuple], items: pd.DataFrame) -> list[tuple]:
    patterns = [words(t) for t in items.text]
    return [d for d in docs if not any(brute.edit_distance_within(p, words(d[1])) <= decontaminate.allowed(len(p)) for p in patterns)]


def test_stages_equal_plain_ones(spark, tmp_path):
    table, labels, items = corpus()
    for name, df in (("documents", table), ("labels", labels), ("benchmark", items)):
        df.to_parquet(tmp_path / f"{name}.parquet", index=False)
    sf = str(tmp_path)
    fit = {r["doc_id"] for r in spark.createDataFrame(table[["doc_id"]]).where(F.xxhash64("doc_id", F.lit("fit")) % 2 == 0).collect()}
    want = [(int(r.doc_id), r.text if isinstance(r.text, str) else None, r.lang if isinstance(r.lang, str) else None, r.source if isinstance(r.source, str) else None) for r in table.itertuples()]
    plain = [lambda d: plain_quality(d, labels, fit), plain_lines, plain_near, lambda d: plain_clean(d, items)]
    got = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [len(want)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, plain):
        got, want = corpus_pipeline.staged(stage(spark, got, sf)), step(want)
        assert sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got.collect()) == sorted(want), name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 100  # every stage has something to do
    out = {r["doc_id"]: (r["size"], r["source_size"], r["taken"], r["target"]) for r in corpus_pipeline.run(spark, sf).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(want, columns=["doc_id", "text", "lang", "source"]))
    last = {r[0]: r for r in con.execute(mixing.OP1_SQL).fetchall()}
    assert set(out) == set(last) and all(out[i][:3] == (r[1], r[2], r[4]) and out[i][3] == pytest.approx(r[3]) for i, r in last.items())
