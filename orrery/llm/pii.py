r"""Personal data: high-recall generators, boosted trees, calibrated thresholds, all in DataFrame functions.

The four base kinds (email, ip, card, phone) are fixed patterns with checks and
always stay.  Three further generators propose spans that may overlap them and
each other: local telephone numbers, nine-digit personal numbers and account
numbers.  Every proposal gets format features (digits, length, checksum, distinct
digits) and context features (cue words before it, what touches it); boosted trees
trained on labelled templates turn these into log odds, and a threshold for each
kind, calibrated on held-out templates to PRECISION, selects the redactions.

Patterns are written so that Java never rescans or recurses: repeated groups are
possessive, and runs are entered only at their start (or where the last match
ended), which leaves the leftmost non-overlapping matches as they are.

Null text is empty: zero counts, the digest of '', no spans.  Texts are read
whole, positions are code points, rows are independent of each other, and other
columns take no part.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm import boosting
from orrery.llm.common import columns_of, table

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9.-])",
    "national_id": r"(?<![0-9.-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9.-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
PROPOSED = ("phone_local", "national_id", "account")
#: A text without this (a literal or a pattern) has no match of the kind.
NEEDS = {"email": "@", "phone": "+"}

REACH = 24
CUES = {
    "for": r"(?i)(tel|phone|call|mobile|fax|fon|télé|ssn|social|security|id\b|iban|account|acct|konto|compte|cuenta|bank|contact)",
    "against": r"(?i)(order|version|isbn|serial|part|item|ref|invoice|page|year|no\.|#|sku|code|build)",
}
PRECISION = 0.95
TEMPLATES = 1200  #: labelled examples in all; half of them are held out for the thresholds
#: Matches of one block of running sums.
BLOCK = 256
SPAN = "array<struct<lo:bigint,hi:bigint,hit:string>>"


def found(kind: str, text: Column) -> Column:
    """Leftmost non-overlapping matches with their positions, as SPAN.

    Positions are running sums over the pieces between matches, taken in blocks of
    BLOCK: an array that grows by appending is copied at every step, so a long one
    would cost its square.
    """
    pattern, none = F.lit(PATTERNS[kind]), F.expr(f"CAST(array() AS {SPAN})")
    pieces, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.filter(F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h"))), lambda x: x["h"].isNotNull())
    size = lambda x: (F.length(x["p"]) + F.length(x["h"])).cast("long")

    def step(acc: Column, x: Column) -> Column:
        lo, hi = acc["at"] + F.length(x["p"]), acc["at"] + size(x)
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.cast("long").alias("lo"), hi.alias("hi"), x["h"].alias("hit")))).alias("out"))

    def spans_of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(pairs, i, BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + size(x)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out"))
        starts = F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    # the pairs are one value of a lambda: written out, each use would match the text again
    spans = F.flatten(F.transform(F.array(pairs), spans_of))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if kind in NEEDS else spans


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits: every second one from the right doubled, nines cast out."""
    return F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
        F.lit(0), lambda a, d: a + d,
    ) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    hit = x["hit"]
    if kind == "ip":  # leading zeros count for nothing: compare without them
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(hit)).between(16, 19) & luhn(digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


# --- the model -----------------------------------------------------------------

FEATURES = ("kind", "n_digits", "length", "checksum", "distinct", "cue_for", "cue_against", "bracket", "separators")


def features(kind: str, hit: Column, before: Column) -> dict[str, Column]:
    number = digits(hit)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "kind": F.lit(float(PROPOSED.index(kind))),
        "n_digits": F.length(number).cast("double"),
        "length": F.length(hit).cast("double"),
        "checksum": flag(luhn(number)),
        "distinct": F.size(F.array_distinct(F.split(number, ""))).cast("double"),
        "cue_for": flag(F.regexp_like(before, F.lit(CUES["for"]))),
        "cue_against": flag(F.regexp_like(before, F.lit(CUES["against"]))),
        "bracket": flag(F.substring(hit, 1, 1) == "("),
        "separators": (F.length(hit) - F.length(F.regexp_replace(hit, r"[\x20.-]", ""))).cast("double"),
    }


def features_of(kind: str, hit: str, before: str) -> dict[str, float]:
    """The same features of one labelled template."""
    import re

    number = re.sub("[^0-9]", "", hit)
    doubled = [int(d) if i % 2 == 0 else (2 * int(d) - 9 if 2 * int(d) > 9 else 2 * int(d)) for i, d in enumerate(reversed(number))]
    return {
        "kind": float(PROPOSED.index(kind)), "n_digits": float(len(number)), "length": float(len(hit)),
        "checksum": float(sum(doubled) % 10 == 0), "distinct": float(len(set(number))),
        "cue_for": float(bool(re.search(CUES["for"], before))), "cue_against": float(bool(re.search(CUES["against"], before))),
        "bracket": float(hit[:1] == "("), "separators": float(len(re.findall(r"[\x20.-]", hit))),
    }


def templates(n: int = TEMPLATES, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(kind, hit, text before, label): personal data in the ways it is written, and numbers that only look like it."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    fore = ["call ", "Tel: ", "phone ", "mobile no ", "contact: ", "fax ", "my number is ", "reach me at "]
    ident = ["SSN ", "social security ", "id: ", "ssn: ", "security number "]
    bank = ["IBAN ", "account ", "konto: ", "bank account ", "compte "]
    other = ["order ", "version ", "ISBN ", "serial ", "part ", "item ", "ref ", "invoice ", "sku ", "build "]
    plain = ["the ", "and ", "of ", "in ", "", "with "]
    out = []
    for _ in range(n):
        kind, good = rng.choice(PROPOSED), rng.random() < 0.5
        if kind == "phone_local":
            sep = rng.choice(" .-")
            hit = f"({some(3)}){sep}{some(3)}-{some(4)}" if rng.random() < (0.5 if good else 0.02) else f"{some(3)}{sep}{some(3)}{sep}{some(4)}"
            cue = fore
        elif kind == "national_id":
            sep = rng.choice("-- ")
            hit, cue = f"{some(3)}{sep}{some(2)}{sep}{some(4)}", ident
        else:
            hit, cue = rng.choice(["DE", "FR", "ES", "GB", "NL"]) + some(2) + rng.choice([" ", ""]).join(["", *[some(4) for _ in range(rng.randint(3, 5))]]), bank
            if not good and rng.random() < 0.5:
                hit = "AB" + some(2) + "".join(rng.choice("ABCDEFXYZ0123") for _ in range(12))
        before = rng.choice(cue if rng.random() < 0.8 else plain) if good else rng.choice(other if rng.random() < 0.6 else plain)
        if "(" in hit:
            good = True
        out.append((kind, hit, before, int(good)))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[list[boosting.Tree], dict[str, float]]:
    """Trees, and for each proposed kind the log odds from which a span is selected."""
    import math

    labelled = templates()
    rows, labels = [features_of(k, h, b) for k, h, b, _ in labelled], [y for *_, y in labelled]
    half = len(rows) // 2
    trees = boosting.fit(rows[:half], labels[:half])
    limits = {}
    for kind in PROPOSED:
        held = [i for i in range(half, len(rows)) if labelled[i][0] == kind]
        p = boosting.calibrated([boosting.probability(trees, rows[i]) for i in held], [labels[i] for i in held], PRECISION)
        limits[kind] = math.log(p / (1 - p)) - 1e-6 if 0 < p < 1 else 1e9
    return trees, limits


# --- the operator --------------------------------------------------------------


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["lo"].cast("string"), x["hi"].cast("string")))


def checking(kind: str):
    return lambda x: passes(kind, x)


def selecting(kind: str):
    trees, limits = model()

    def selected(x: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(F.lit(1), x["lo"] + 1 - REACH).cast("int"), F.least(F.lit(REACH), x["lo"]).cast("int"))
        return boosting.column(trees, features(kind, x["hit"], before)) >= limits[kind]

    return selected


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, one span array for each kind): base spans that pass, proposals that the model selects."""
    df = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("digits", F.regexp_like("text", F.lit("[0-9]{2}")))
    empty = F.expr(f"CAST(array() AS {SPAN})")
    for kind in PATTERNS:
        spans = found(kind, F.col("text"))
        df = df.withColumn(f"all_{kind}", spans if kind in NEEDS else F.when(F.col("digits") | F.regexp_like("text", F.lit(r"[0-9][\x20.-][0-9]")), spans).otherwise(empty))
    kept = [F.filter(f"all_{kind}", checking(kind)).alias(kind) for kind in BASE]
    kept += [F.filter(f"all_{kind}", selecting(kind)).alias(kind) for kind in PROPOSED]
    return df.select("doc_id", *kept)


def reported(docs: DataFrame) -> DataFrame:
    df = detected(docs)
    lists = [written(kind, F.col(kind)) for kind in PATTERNS]
    return df.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.concat_ws(",", F.concat(*lists[: len(BASE)])), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*lists)).alias("spans"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(table(spark, sf_dir, "documents"))
