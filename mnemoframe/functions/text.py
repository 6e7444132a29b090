"""Text as column expressions: checksums, identifiers, cleaning, tokens, labels."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Name space of deterministic point ids.
POINTS = uuid.NAMESPACE_DNS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def checksum(c: str | Column) -> Column:
    """SHA-256 of bytes or of the UTF-8 form of a text; null stays null."""
    return F.sha2(_col(c), 256)


def with_checksum(df: DataFrame, text: str, name: str = "checksum") -> DataFrame:
    return df.withColumn(name, checksum(text))


def point_id(c: str | Column) -> Column:
    """Name-based identifier (version 5) of a string: SHA-1 of name space and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINTS.hex)), _col(c).cast("binary")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalise(c: str | Column) -> Column:
    """Composed form; no byte-order marks or zero-width characters; line feeds; plain single spaces; at most one blank line.

    The steps keep their order: blank lines are collapsed before spaces are, so blank lines that hold spaces stay.
    """
    t = F.pandas_udf(_nfc, "string")(_col(c))
    t = F.regexp_replace(t, "[​‌‍⁠﻿]", "")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, "[  -   　]", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")


def sanitise(c: str | Column, max_length: int = 10_000, html: bool = True, control: bool = True, null_bytes: bool = True, traversal: bool = True) -> Column:
    """Drops NUL, control characters, scripts, styles, comments, event handlers and parent-directory steps; cuts and trims."""
    t = F.coalesce(_col(c), F.lit(""))
    if null_bytes:
        t = F.regexp_replace(t, r"\x00", "")
    if control:
        t = F.regexp_replace(t, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if html:
        for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?i)\bon\w+\s*=\s*[\"'][^\"']*[\"']"):
            t = F.regexp_replace(t, pattern, "")
    if traversal:
        for step in ("../", "..\\", "%2e%2e%2f", "%2e%2e/"):
            t = F.replace(t, F.lit(step), F.lit(""))
    return F.regexp_replace(F.left(t, F.lit(max_length)), r"(?U)\A\s+|\s+\z", "")


def clean_filename(c: str | Column) -> Column:
    """The last path part without NUL, ``..`` and shell signs; other unusual characters become ``_``; never empty."""
    t = F.regexp_extract(F.replace(_col(c), F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1)
    t = F.regexp_replace(F.replace(F.regexp_replace(t, r"\x00", ""), F.lit(".."), F.lit("")), "[;&|`$]", "")
    t = F.trim(F.regexp_replace(t, r"(?U)[^\w.\-\s]", "_"))
    return F.when(t == "", "unnamed").otherwise(t)


def clean_path(c: str | Column) -> Column:
    """Forward slashes, no NUL, no parent steps (also those that removing others makes), single slashes.

    Every removal takes a slash, so as many rounds as the path has slashes undo any nesting.
    """
    t = F.replace(F.regexp_replace(_col(c), r"\x00", ""), F.lit("\\"), F.lit("/"))
    rounds = F.when(t.contains("../"), F.sequence(F.lit(1), F.regexp_count(t, F.lit("/")))).otherwise(F.array().cast("array<int>"))
    return F.regexp_replace(F.aggregate(rounds, t, lambda now, _: F.replace(now, F.lit("../"), F.lit(""))), "/{2,}", "/")


def tokens_ws(c: str | Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda x: x != "")


def tokens_word(c: str | Column, least: int = 2) -> Column:
    """Lower-case runs of letters, digits and underscores of at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= least)


def validate_queries(queries: DataFrame, text: str = "text", longest: int = 4000) -> DataFrame:
    """Adds ``query`` (trimmed, cut) and ``error`` (``empty query`` for null or blank texts, else null)."""
    t = F.left(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\A\s+|\s+\z", ""), F.lit(longest))
    return queries.withColumn("query", F.when(t != "", t)).withColumn("error", F.when(t == "", F.lit("empty query")))


def snippet(c: str | Column, n: int = 500, dots: bool = False) -> Column:
    cut = F.left(_col(c), F.lit(n))
    return F.when(F.length(_col(c)) > n, F.concat(cut, F.lit("..."))).otherwise(_col(c)) if dots else cut


def citation_label(c: str | Column, longest: int = 30) -> Column:
    """The last path part, cut at ``longest`` characters."""
    return F.left(F.element_at(F.split(_col(c), "/"), -1), F.lit(longest))
