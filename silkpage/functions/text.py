"""Text functions as Column expressions. White space includes the non-breaking space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space of the capture rules.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clamp(text: Column, size: int) -> Column:
    """White space collapsed, trimmed, cut; null gives ''."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")), 1, size)


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def readable_md(title: Column, url: Column, text: Column) -> Column:
    head = F.when(F.coalesce(title, F.lit("")) == "", url).otherwise(title)
    return F.format_string("# %s\n\n<%s>\n\n%s\n", head, url, text)


def round_half_up(x: Column) -> Column:
    """Halves toward positive infinity."""
    return F.floor(x + 0.5)
