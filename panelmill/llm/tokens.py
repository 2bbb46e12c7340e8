"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of the public WordPunct pattern ``\w+|[^\w\s]+`` over Unicode, spelled out because regular
#: expression engines differ in what they mean by \w and \s. Word characters are letters, numbers and the underscore.
WORD = r"\p{L}\p{N}_"
BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = f"[{WORD}]+|[^{WORD}{BLANK}]+"


def token_count(text: str | Column) -> Column:
    """Number of tokens; 0 for empty and null texts."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))
