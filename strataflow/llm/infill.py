"""Fill-in-middle: texts cut at two unit ends into prefix, middle and suffix, and written in the order of a form.

A unit is a word with the white space before it, or white space at the end of the text.  One Arrow-batched pandas UDF walks a
text once with ``finditer`` and keeps the units' ends in an array of integers; two lookups in it give the slices, so units are
never copied.  Cuts and form come from a SHA-256 of the seed and the id alone, whatever the partitions are.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part behind its
mark.  A text that holds a mark stays plain, so the first mark in an output is always the operator's own, and
:func:`restored` gets the exact text back.

Edge cases: a null text is empty; an empty text is plain and has 0 units; blank texts are one unit; very long texts are walked
in one pass with 8 bytes a unit; a null id is seeded with the empty text; rows that repeat an id are cut by the same numbers;
an empty table gives no rows; other columns are passed on, a column of the result's name is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def _sha256(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def _numbers(seed: int, name: str) -> list[int]:
    """The first four groups of eight hex digits of the digest."""
    digest = _sha256(f"{seed}:{name}")
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _cut(text: str, name: str, pattern, seed: int, rate: int, spm_rate: int) -> tuple:
    from array import array

    ends = array("q", (m.end() for m in pattern.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = _numbers(seed, name)
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text, _sha256(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, stop = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if h4 % 100 < spm_rate:
        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, start, stop - start, out, _sha256(out)


def infill(doc_id: Column, text: Column, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> Column:
    """Struct of n, form, prefix_chars, middle_chars, output and output_sha256.

    ``rate`` of a hundred texts are cut, and ``spm_rate`` of a hundred of those are written suffix first.
    """

    @F.pandas_udf(SHAPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(UNIT)
        names = [c.split()[0] for c in SHAPE.split(", ")]
        for ids, texts in batches:
            rows = [_cut(t, i, pattern, seed, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))


def _rebuilt(out: str, form: str) -> str:
    if form == "plain":
        return out
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    # Parts hold no mark and marks don't overlap, so the first find is the operator's own.
    one, rest = out.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def restored(output: Column, form: Column) -> Column:
    """Struct of the text that an output was made of, and its SHA-256."""

    @F.pandas_udf("text string, sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [_rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"text": texts, "sha256": [_sha256(t) for t in texts]}, dtype=object)

    return run(output, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """All columns of ``docs`` and those of :func:`infill`."""
    names = [c.split()[0] for c in SHAPE.split(", ")]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns of the result's names: {sorted(clash)}")
    cut = docs.withColumn("_infill", infill(F.col(id_col), F.col(text_col), seed, rate, spm_rate))
    return cut.select(*docs.columns, *[F.col(f"_infill.{n}").alias(n) for n in names])


def infilled_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    cut = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    cut = cut.withColumn("back", restored(F.col("output"), F.col("form")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.sha256").alias("restored_sha256"))


#: The same rows in DuckDB's SQL, which cuts lists of units instead of offsets.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
    CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
