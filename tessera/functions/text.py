"""Column expressions on text: tokens, symbols, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, split again where a small letter meets a capital.

    Lower case comes last: characters outside ASCII that fold to ASCII letters stay separators.
    """
    parts = F.split(F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " "), r"[^A-Za-z0-9]+")
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def normalise_symbol(symbol: Column) -> Column:
    """ASCII lower case without ``_``, ``-`` and space; other characters stay."""
    return F.translate(symbol, UPPER + "_- ", LOWER)


def trigrams(normalised: Column) -> Column:
    """Distinct byte trigrams, as hexadecimal, of a normalised symbol between two ``#`` on each side."""
    data = F.encode(F.concat(F.lit("##"), normalised, F.lit("##")), "UTF-8")
    grams = F.transform(F.sequence(F.lit(1), F.octet_length(data) - 2), lambda i: F.hex(F.substring(data, i, F.lit(3))))
    return F.array_distinct(F.when(F.octet_length(normalised) > 0, grams).otherwise(F.array().cast("array<string>")))


def looks_symbol_like(text: Column) -> Column:
    """Holds ``::``, ``.`` or ``_``, or is one word of ASCII letters and digits with a small letter before a capital."""
    return text.contains("::") | text.contains(".") | text.contains("_") | (text.rlike(r"^[A-Za-z0-9]+\z") & text.rlike("[a-z][A-Z]"))


def is_symbol_like(text: str) -> bool:
    """:func:`looks_symbol_like` for a Python string."""
    if "::" in text or "." in text or "_" in text:
        return True
    return text.isascii() and text.isalnum() and any(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))


def camel(words: Column) -> Column:
    """``blue anvil`` to ``blueAnvil``."""
    joined = F.replace(F.initcap(words), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))
