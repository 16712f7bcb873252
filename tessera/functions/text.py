"""Column expressions on texts and bytes: clean-up, escaping, decoding, searching, slicing.

All are built-in expressions inside whole-stage code; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS, BASE64_MARK, BASE64_LENGTH = "...", "[TRUNCATED_BASE64]", 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def remove_empty_lines(text: Column) -> Column:
    """Runs of blank lines collapse into one line end; white space is Unicode's."""
    return F.regexp_replace(text, r"(?U)\n\s*\n", "\n")


def truncate_base64(text: Column, length: int = BASE64_LENGTH) -> Column:
    return F.regexp_replace(text, rf"[A-Za-z0-9+/=]{{{length},}}", BASE64_MARK.replace("[", r"\[").replace("]", r"\]"))


def strip_block_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)/\*.*?\*/|<!--.*?-->", "")


def strip_line_comments(text: Column) -> Column:
    """From // or # to the line end; one without a line end after it stays. Only \\n ends a line."""
    return F.regexp_replace(text, r"(?d)(//|#).*\n", "\n")


def strip_comments(text: Column) -> Column:
    return strip_line_comments(strip_block_comments(text))


def cdata(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """Text of the bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """Bytes [offset, offset + length) of a binary column."""
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def folded(text: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(text, _UPPER, _LOWER)


def name_contains(name: Column, query: str) -> Column:
    """LIKE '%query%' without regard to the case of ASCII letters; % and _ in the query stay wildcards."""
    pattern = "%" + query.translate(str.maketrans(_UPPER, _LOWER)) + "%"
    escape = next(c for c in "\x01\x02\x03\x04\x05\x06\x07\x0e\x0f" if c not in pattern)
    return F.like(folded(name), F.lit(pattern), F.lit(escape))
