"""Fill-in-middle by escaped marker injection, with Spark expressions only.

A delimiter of one control character is escaped in the text, ``regexp_replace`` appends it after
every unit, counting it gives n, and ``substring_index`` extracts the parts of given ranks, from
which the delimiters go and the escapes are undone:

    a|b|c|d|   ->   prefix = units 1..a, middle = units a+1..b, suffix = the rest

Units are code points (the contract), words with the white space before them, or lines; every
pattern covers the whole text, so nothing is lost.  Cuts and forms are drawn from the sha256 of
``seed:doc_id``, so a rerun, or another partitioning, gives the same rows.

Forms: plain (the text), psm (<P>prefix<S>suffix<M>middle), spm (<S>suffix<P>prefix<M>middle).
A text that is empty or holds a marker itself stays plain, so ``restore`` is exact.

Null texts count as empty and are plain; a null doc_id draws as the empty string does; repeated
rows give repeated rows; very long texts take some four times their size in one task and nothing
else; an empty table gives no rows; columns other than doc_id and text are ignored, whatever
their names.  doc_id may be of any type that casts to string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts those from PLAIN_FROM on stay plain; of 100 others those below SPM_BELOW start with the suffix.
PLAIN_FROM, SPM_BELOW = 90, 20
MARK, ESCAPE = "\x1f", "\x1e"
#: An escaped character is one unit; words take the white space before them, the last one that behind it.
UNITS = {
    "codepoint": f"(?s)({ESCAPE}[ed]|.)",
    "word": r"(\s*\S+(?:\s+\z)?|\s+\z)",
    "line": r"([^\n]*\n|[^\n]+)",
}


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "d"))


def _plain(c: Column) -> Column:
    """A part of the marked text as it was: without delimiters, escapes undone."""
    return F.replace(F.replace(F.replace(c, F.lit(MARK), F.lit("")), F.lit(ESCAPE + "d"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hex digits of sha256(seed:doc_id) as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, unit: str = "codepoint", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars (code points, null if plain), output for each row."""
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    holds = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("text", F.lit(m))
    # each step is a projection of its own: what costs much is worked out once
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), UNITS[unit], "$1" + MARK))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(MARK), F.lit("")))).cast("bigint"))
    rows = rows.withColumns({"x": F.pmod(h1, F.col("n") + 1), "y": F.pmod(h2, F.col("n") + 1), "h3": h3 % 100, "h4": h4 % 100})
    form = F.when((F.col("n") == 0) | holds | (F.col("h3") >= plain_from), "plain").when(F.col("h4") < spm_below, "spm").otherwise("psm")
    rows = rows.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y"), "form": form})

    def ranked(which: str) -> Column:
        # units after rank r are what stands behind the last n - r + 1 delimiters
        part = {
            "prefix": "substring_index(marked, '\x1f', int(a))",
            "middle": "substring_index(substring_index(marked, '\x1f', int(b)), '\x1f', int(a - b))",
            "suffix": "substring_index(marked, '\x1f', int(b - n - 1))",
        }[which]
        return F.when(F.col("form") != "plain", _plain(F.expr(part)))

    rows = rows.select("doc_id", "text", "n", "form", *[ranked(w).alias(w) for w in ("prefix", "middle", "suffix")])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select(
        "doc_id", "text", "n", "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form alone; no marker can straddle a limit, as each starts with < and ends with >."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    before = lambda m: F.substring(F.substring_index(head, m, 1), F.lit(len(PREFIX) + 1), F.length(output))
    after = lambda m: F.substring_index(head, m, -1)
    psm = F.concat(before(SUFFIX), middle, after(SUFFIX))
    spm = F.concat(after(PREFIX), middle, before(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """What op11 returns, from what ``transform`` gives."""
    back = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle() -> str:
    """The contract in DuckDB's SQL, cut by substring instead of delimiters."""
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, text, n, {number(0)} % (n + 1) AS x, {number(1)} % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {number(2)} % 100 >= {PLAIN_FROM} THEN 'plain'
    WHEN {number(3)} % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM x),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
