"""Visually identical text with different characters, brought to one form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.session import attach, pinned

# Single letters of Latin, Greek and Cyrillic and the letter of the same shape and case they are replaced by, after
# the public list of confusable characters.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "ӕ": "æ", "ә": "ə", "ө": "ɵ", "ѳ": "ɵ", "ӡ": "ʒ", "ԑ": "ɛ", "ԍ": "ɢ",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q",
    "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӕ": "Æ", "Ә": "Ə", "Ө": "Ɵ", "Ѳ": "Ɵ", "Ӡ": "Ʒ", "Ԑ": "Ɛ",
    # Greek, small
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ρ": "p", "α": "ɑ", "ε": "ɛ", "ι": "ɩ", "υ": "ʋ", "ͻ": "ɔ",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ϝ": "F", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ϻ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "Ϳ": "J", "Θ": "Ɵ", "ϴ": "Ɵ", "Ͻ": "Ɔ",
    # Latin letters of the shape of another one
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ɡ": "g", "ǝ": "ə", "ᴐ": "ɔ", "Ð": "Đ", "Ɖ": "Đ", "Ꭓ": "X", "µ": "μ",
    # Latin letters of the shape of a Greek or Cyrillic one
    "ʙ": "в", "ʜ": "н", "ᴍ": "м", "ᴛ": "т", "ᴦ": "г", "ᴨ": "п", "ᴎ": "и", "ᴙ": "я", "ᴫ": "л", "Ʌ": "Λ", "Ʃ": "Σ", "ꞵ": "β", "ꭓ": "χ", "ɸ": "φ", "ꞷ": "ω",
    # Greek, Cyrillic and Latin without a plain letter of that shape
    "Γ": "Г", "Π": "П", "Φ": "Ф", "Ͷ": "И", "ͷ": "и", "Ѱ": "Ψ", "ѱ": "ψ", "κ": "к", "ĸ": "к", "ᴋ": "к", "ᴩ": "ᴘ",
}
# Left out on purpose, as readers can tell them apart in common fonts: α and a, υ and u, ι and i, γ, ү and y, η and n, ω and w, τ and т, β and ß,
# г and r, п and n, и and u; letters that differ in size or case (Ь and b, Һ and h, ӏ and l, I and l) or have a hook or stroke more
# (Ҫ and Ç, ґ and г); and, by the rule that digits make a difference, З and 3, О and 0, б and 6.

# Characters that show nothing although they are not of the class of format characters (inclusive ranges).
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Format characters that do show.
VISIBLE_FORMAT = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]



class Prototypes(dict):
    """Code point to what it is replaced by; None removes it. Rules and the lists above, looked up once a character."""

    def __missing__(self, cp: int) -> str | int | None:
        char = chr(cp)
        kind = unicodedata.category(char)
        to: str | int | None = cp
        if char in LOOK_ALIKES:
            to = LOOK_ALIKES[char]
        elif any(low <= cp <= high for low, high in INVISIBLE):
            to = None
        elif kind == "Cf" and not any(low <= cp <= high for low, high in VISIBLE_FORMAT):
            to = None
        elif kind == "Zs":
            to = " "
        elif 0xFF01 <= cp <= 0xFFEF:  # the block of full-width and half-width forms
            to = unicodedata.normalize("NFKD", char)
        self[cp] = to
        return to


PROTOTYPES = Prototypes()
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 16)
def _run(run: str) -> str:
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", run).translate(PROTOTYPES))


def skeleton_of(text: str) -> str:
    """Decompose, replace each character by its prototype, decompose again.

    ASCII characters stay as they are and no decomposition reaches across one, so only the runs between them are treated.
    """
    return NOT_ASCII.sub(lambda m: _run(m[0]), text)


@F.pandas_udf(T.StringType())
def _skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(skeleton_of, na_action="ignore")


def skeleton(text: Column) -> Column:
    """The one form of all texts that look like ``text``.

    ASCII texts are their own form and are not sent to Python. Null stays null, the empty text stays empty, and a text of
    invisible characters alone becomes empty. Case, digits, accents, line breaks, tabs and the number of blanks are kept.
    """
    return F.when(text.rlike(r"[^\x00-\x7f]"), _skeletons(F.when(text.rlike(r"[^\x00-\x7f]"), text))).otherwise(text)


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, form): digests of the skeleton and of the text itself, SHA-256. Rows without a text are left out.

    Rows of equal ``look`` look the same; if their ``form`` differs too, they differ in characters.
    """
    seen = df.filter(F.col(text).isNotNull())
    return seen.select(key, F.unhex(F.sha2(skeleton(F.col(text)), 256)).alias("look"), F.unhex(F.sha2(F.col(text), 256)).alias("form"))


def look_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, form, class_id, members, copies, links) for each row that has a text.

    ``class_id`` is the least key of the rows that look like this one, ``members`` their number, ``copies`` how many of them have
    this very text, and ``links`` how many differ from it in characters: 0 for most rows.

    Forms are counted with map-side combine and only classes of more than one row are joined back, by broadcast if they are
    few, so neither a text that a third of all rows have nor a large class is ever collected or paired.
    """
    rows = pinned(look_classes(df, key, text))
    forms = rows.groupBy("look", "form").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("_first"))
    classes = forms.groupBy("look").agg(F.sum("copies").alias("members"), F.min("_first").alias("_first")).filter("members > 1")
    several = forms.drop("_first").join(classes, "look")
    out = attach(rows, several, ["look", "form"])
    members, copies = (F.coalesce(c, F.lit(1)) for c in ("members", "copies"))
    return out.select(key, "look", "form", F.coalesce("_first", key).alias("class_id"), members.alias("members"), copies.alias("copies"), (members - copies).alias("links"))
