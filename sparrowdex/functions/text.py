"""Expressions over document text: titles, tokens, quality, blocks. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_BYTES = 160
LINKED = 0.5
_LINK = r"\[([^\]]*)\]\([^)]*\)?"
_BLOCKS = r"\n(?:[ \t\r]*\n)+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters or decimal digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def capped(text: Column, most: int = TITLE_BYTES) -> Column:
    """The longest prefix of whole characters of at most so many bytes."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(cut, F.lit("\ufffd")))


def title(body: Column) -> Column:
    """The first line that isn't empty without its heading and emphasis marks. One search finds where it begins, whatever the text's length."""
    return capped(F.rtrim(F.regexp_extract(F.coalesce(body, F.lit("")), r"[^\s#*_`\[\]<>|][^\n]*", 0), F.lit("*_`[]<>| \t\r")))


def alnum(text: Column) -> Column:
    """Number of letters and numbers."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def content_quality(body: Column) -> Column:
    """100 x letters and numbers over bytes; 0 for an empty text."""
    return F.when(F.octet_length(body) > 0, F.lit(100.0) * alnum(body) / F.octet_length(body)).otherwise(0.0)


def blocks(body: Column) -> Column:
    """Runs of lines that aren't blank."""
    return F.filter(F.split(body, _BLOCKS), lambda x: F.regexp_replace(x, r"[ \t\r\n]", "") != "")


def block_density(block: Column) -> Column:
    """Visible letters and numbers of a block, and those in link labels."""
    labels = F.array_join(F.regexp_extract_all(block, F.lit(_LINK), F.lit(1)), "")
    return F.struct(alnum(F.regexp_replace(block, _LINK, "$1")).cast("long").alias("visible"), alnum(labels).cast("long").alias("anchor"))


def boilerplate(body: Column) -> Column:
    """Share of the visible characters that stand in blocks mostly made of links."""
    each = F.transform(blocks(F.coalesce(body, F.lit(""))), block_density)
    total = lambda keep: F.aggregate(F.filter(each, keep), F.lit(0).cast("long"), lambda a, x: a + x["visible"])
    whole = total(lambda x: F.lit(True))
    return F.when(whole > 0, total(lambda x: (x["visible"] > 0) & (x["anchor"] >= LINKED * x["visible"])) / whole).otherwise(0.0)


def prior(n_tokens: Column, depth: Column) -> Column:
    """Static prior of a document: long texts up, deep paths down."""
    return F.greatest(F.lit(0.0), F.least(n_tokens, F.lit(4000)) / 40.0 - 3.0 * depth)


def trigrams(text: Column) -> Column:
    """Letter trigrams of words padded with a space on either side."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))
