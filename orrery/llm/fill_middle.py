"""Fill-in-middle transformation, in Spark SQL functions only.

``regexp_extract_all`` makes the array of units (lines with their ends), ``conv``
over groups of a SHA-256 gives two cuts and the choice of form, ``slice`` and
``array_join`` build the arrangement, and the text is rebuilt from the output by
its sentinels.  No row meets another: nothing is shuffled, and a lost task is
redone from its input.

Null and empty texts are plain, with no units.  A text that holds a sentinel stays
plain whatever the draw, so that every output can be read back.  The draw depends
on doc_id alone: rows that share a doc_id are cut by the same numbers, each over
its own units, and a null doc_id draws as the empty string.  Long texts are one
row, whole.  Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.common import columns_of, table

#: Lines with their line ends, the last one with or without.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Per cent of texts that are rearranged, and of those the share with the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def draw(digest: Column, group: int) -> Column:
    """The group-th (from 1) eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def arranged(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = LINES, sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text).

    ``form`` is plain, psm (prefix, suffix, middle) or spm; lengths are in code
    points, null if plain.
    """
    p, s, m = (F.lit(x) for x in sentinels)
    out = columns_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    out = out.withColumns({"units": F.regexp_extract_all("text", F.lit(unit), F.lit(0)), "digest": digest})
    out = out.withColumn("n", F.size("units").cast("long"))
    one, two = (draw(F.col("digest"), k) % (F.col("n") + 1) for k in (1, 2))
    out = out.withColumns({"lo": F.least(one, two).cast("int"), "hi": F.greatest(one, two).cast("int")})
    plain = (F.col("text") == "") | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (draw(F.col("digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda first, count: F.array_join(F.slice("units", first, count), "")
    out = out.withColumns({
        "form": form,
        "prefix": part(F.lit(1), F.col("lo")),
        "middle": part(F.col("lo") + 1, F.col("hi") - F.col("lo")),
        "suffix": part(F.col("hi") + 1, (F.col("n") - F.col("hi")).cast("int")),
    })
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    length = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return out.select("doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of: its parts stand between the sentinels, in the order of the form."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arranged(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return out.withColumns(digests).drop("output")


OP12_SQL = rf"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{LINES}') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS a, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE a || m || s END) AS restored_sha256
FROM o
"""
