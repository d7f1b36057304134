"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, and set anew.

An Arrow-batched pandas UDF runs over the texts.  A finditer of the regex library
collects the ends of a text's units (lines) in a compact array; two look-ups there
give the cuts, and the text is sliced at them.  A sha256 of the seed and the row's id
gives the numbers that choose the cuts and the form, so a row comes out alike in
every run, whatever its neighbours are.

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

Markers never occur in a text that is cut, and none overlaps another, so the first
of each in an output is the one that was set, and ``restore`` gives the exact text.

Defined results: a null text counts as empty; empty texts, and texts that hold a
marker, stay plain; a null id counts as an id without digits; rows that repeat an id
and a text come out alike, one by one; texts of any length are cut whole; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm.common import ARROW_BATCH_BYTES, ARROW_BATCH_ROWS, give_back, quoted, read

# Markers, forms and the unit of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNIT = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM_SHARE = 7, 100, 50

_CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Offsets, in code points, at which the units of a text end."""
    return array("q", (m.end() for m in unit.finditer(text)))


def numbers(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a row."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def arrange(text: str, key: str, unit: regex.Pattern, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and output of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    one, two, chance, order = numbers(seed, key)
    if not text or chance % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_share:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output of a form was made of."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, _, middle = output.removeprefix(first).partition(MIDDLE)
    one, _, two = head.partition(second)
    return one + middle + two if form == PSM else two + middle + one


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _each(keys: pd.Series, texts: pd.Series, unit: regex.Pattern, settings: tuple[int, int, int]) -> Iterator[tuple]:
    for key, text in zip(keys, texts, strict=True):
        yield arrange(text or "", key or "", unit, *settings)


def _bounded(spark: SparkSession) -> None:
    """Batches of bounded bytes; a longer text is a batch of its own."""
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return quoted(id_col).cast("string"), quoted(text_col).cast("string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, unit: str = UNIT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row; ``rate`` percent of texts are cut, ``spm_share`` percent of those suffix first."""
    _bounded(docs.sparkSession)

    @F.pandas_udf(_CUT)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        try:
            for keys, texts in parts:
                made = pd.DataFrame(_each(keys, texts, pattern, (seed, rate, spm_share)), columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        finally:
            give_back()

    return docs.select(quoted(id_col).alias("doc_id"), cut(*_columns(docs, id_col, text_col)).alias("cut")).select("doc_id", "cut.*")


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, unit: str = UNIT) -> DataFrame:
    """As fill_in_middle, with the sha256 of the output and of the text rebuilt from it instead of the output."""
    _bounded(docs.sparkSession)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def digests(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        try:
            for keys, texts in parts:
                made = ((n, form, a, b, _hex(output), _hex(restore(output, form))) for n, form, a, b, output in _each(keys, texts, pattern, (seed, rate, spm_share)))
                frame = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
                yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        finally:
            give_back()

    return docs.select(quoted(id_col).alias("doc_id"), digests(*_columns(docs, id_col, text_col)).alias("cut")).select("doc_id", "cut.*")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT doc_id, text, n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM f
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
