"""Fill-in-the-middle: texts cut at two hashed places and put together with marks, so that a model learns to fill the gap.

A text's UTF-8 bytes are seen as one big integer per class of bytes: bytes.translate gives a digit per byte, and the digits
are read as a number whose bit i belongs to byte i. Shifted boolean operations on these numbers mark the last byte of
each unit, bit_count tells how many units there are, and the place of the k-th unit is found by halving: the lower half's
bit count says in which half the bit lies. No step loops over characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_digits = lambda has: bytes(48 + has(b) for b in range(256))
#: Digits of the classes: bytes inside a code point, bytes of words, line feeds.
_INSIDE, _WORD, _LINE = _digits(lambda b: b & 0xC0 == 0x80), _digits(lambda b: b != 32 and not 9 <= b <= 13), _digits(lambda b: b == 10)


def mask(raw: bytes, digits: bytes) -> int:
    """The number whose bit i says whether byte i is of a class."""
    return int(raw.translate(digits)[::-1] or b"0", 2)


def unit_ends(raw: bytes, unit: str = "char") -> int:
    """The number whose bit i says whether byte i is the last of a unit.

    char: a code point; word: a word with the blanks after it (blanks before the first word are a unit); line: up to and with
    its line feed. Each byte belongs to one unit, so the units put together are the text.
    """
    if not raw:
        return 0
    last = 1 << (len(raw) - 1)
    if unit == "char":
        return ((last << 1) - 1) & ~(mask(raw, _INSIDE) >> 1)
    if unit == "word":
        words = mask(raw, _WORD)
        return (words & ~(words << 1)) >> 1 | last
    if unit == "line":
        return mask(raw, _LINE) | last
    raise ValueError(f"no unit {unit}")


def nth_bit(bits: int, k: int, width: int) -> int:
    """The place of the set bit with k set bits below it; bits has at most `width` bits, and more than k set ones."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - below, at + half
    return at


def hashed(key: str, n: int = 4) -> list[int]:
    """The first n 8-digit groups of the hex SHA-256 of key, as numbers."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(n)]


def rearrange(raw: bytes, key: str, *, unit: str = "char", fim_share: int = 90, spm_share: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, units of the prefix and of the middle, and the output of one text; key decides on cuts and form."""
    ends = unit_ends(raw, unit)
    n = ends.bit_count()
    h1, h2, h3, h4 = hashed(key)
    if not raw or any(m in raw for m in _MARKS) or h3 % 100 >= fim_share:
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, q = (nth_bit(ends, k - 1, len(raw)) + 1 if k else 0 for k in (a, b))
    prefix, middle, suffix = raw[:p], raw[p:q], raw[q:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, b"".join((_MARKS[1], suffix, _MARKS[0], prefix, _MARKS[2], middle))
    return n, "psm", a, b - a, b"".join((_MARKS[0], prefix, _MARKS[1], suffix, _MARKS[2], middle))


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, fim_share: int = 90, spm_share: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output; one row per input row.

    The cuts and the form follow from the hash of `seed:doc_id`, so a run on other partitions gives the same. A null text
    is empty; an empty text, one that holds a mark, and 100 - fim_share of 100 others stay plain (null numbers of units). Of the rest
    spm_share of 100 are spm, the others psm. A null id counts as an empty one in the hash and stays null. Rows do not affect each other, so
    repeats do not matter and there are no ties; the work on a text is in proportion to its bytes. An empty table gives no
    rows. Other columns are not read, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            rows = [rearrange(t or b"", f"{seed}:{k or ''}", unit=unit, fim_share=fim_share, spm_share=spm_share) for k, t in zip(keys, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *schema.names])

    key = F.col(f"`{id_col}`")
    source = docs.select(key.alias("doc_id"), key.cast("string").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return source.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text with a mark in it is rearranged, so each mark stands once."""
    left, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(mark: str) -> tuple[Column, Column]:
        head = F.substring_index(left, mark, 1)
        return F.substring(head, F.lit(4), F.length(head)), F.substring_index(left, mark, -1)

    prefix, suffix = parts(SUFFIX)
    late_suffix, late_prefix = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Per document: n, form, code points of prefix and middle, and hashes of the output and of the text restored from it."""
    hashed_text = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), hashed_text(F.col("output")).alias("output_sha256"), hashed_text(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The rows of digest() over documents with the default parameters, in SQL.
SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""
