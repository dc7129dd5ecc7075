"""Fill-in-middle: texts cut at two places between tokens, with one match of a counted pattern for each row.

A token is what UNIT matches: a word with the white space before it, or white space at the end. regexp_count gives their number n; two
draws from the document's hash give the counts a <= b; the row's own pattern, (unit{a})(unit{b-a})(rest) with possessive quantifiers,
captures prefix, middle and suffix in one match, whose replacement is the output. Possessive groups of a fixed count run in a loop, so
that a long text needs neither a deep stack nor backtracking. All of it are Spark's own expressions on one pass without a shuffle.

Forms: plain (the text), psm (<P>prefix<S>suffix<M>middle) and spm (<S>suffix<P>prefix<M>middle). A text that contains a marker stays
plain, so a marker in an output is one that was put there, and the text can be rebuilt.

Defined results: a null text is empty; empty texts are plain with n = 0; a text of white space is one token; a null doc_id draws like
an empty one; repeated rows give repeated rows; other columns play no part in the draws and are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
UNIT = rf"(?:{SPACE}*+{WORD}++|{SPACE}++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, percent of texts that are cut, percent of those with the suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
#: Names of the columns that fill_in_middle adds.
ADDED = ["n_tokens", "form", "output", "prefix_chars", "middle_chars"]


def draw(doc_id: Column, k: int, seed: int) -> Column:
    """The k-th draw of a document: eight hexadecimal digits of its hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text, ..) with n_tokens, form, output, prefix_chars and middle_chars; these two are null for plain texts."""
    clash = set(docs.columns) & {*ADDED, "_h", "_a", "_b"}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.drop(*clash).withColumn("text", text).withColumn("n_tokens", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h = F.array(*(draw(F.col("doc_id"), k, seed) for k in range(4)))
    df = df.withColumn("_h", h).withColumn("_a", F.col("_h")[0] % (F.col("n_tokens") + 1)).withColumn("_b", F.col("_h")[1] % (F.col("n_tokens") + 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("_h")[2] % 100 >= cut)
    df = df.withColumn("form", F.when(plain, "plain").when(F.col("_h")[3] % 100 < suffix_first, "spm").otherwise("psm"))
    first, rest = F.least("_a", "_b"), F.abs(F.col("_a") - F.col("_b"))
    counted = lambda n: F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), counted(first), counted(rest), F.lit(r"((?s:.*+))\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    df = df.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    at = {m: F.instr("output", m) for m in (PREFIX, SUFFIX, MIDDLE)}
    until = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    when_cut = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    df = df.withColumn("prefix_chars", when_cut(until - at[PREFIX] - len(PREFIX))).withColumn("middle_chars", when_cut(F.char_length("output") - at[MIDDLE] - len(MIDDLE) + 1))
    return df.select(*(c for c in docs.columns if c not in clash), *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    back = lambda a, b, c, order: F.regexp_replace(output, rf"(?s)\A{a}(.*?){b}(.*?){c}(.*)\z", order)
    return F.when(form == "psm", back(PREFIX, SUFFIX, MIDDLE, "$1$3$2")).when(form == "spm", back(SUFFIX, PREFIX, MIDDLE, "$2$3$1")).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
