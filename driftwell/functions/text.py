"""Text helpers: accent stripping, characters of words, HTML breaks."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "\ue000"  # stands for a character that becomes several
GONE, SEVERAL = 1, 2


def _plain(text: str) -> str:
    """Compatibility decomposition without the combining marks."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


@functools.cache
def accent_table() -> tuple[str, str]:
    """The characters that change, by rule from the character database, and what they become: those with one character
    first, then those that become several, then those that go."""
    one: list[tuple[str, str]] = []
    several, gone = [MARK], []
    for code in range(0x80, 0x110000):
        ch = chr(code)
        if not unicodedata.decomposition(ch) and not unicodedata.combining(ch) and not 0xAC00 <= code < 0xD7A4:
            continue
        plain = _plain(ch)
        if plain == ch:
            continue
        if not plain:
            gone.append(ch)
        elif len(plain) == 1:
            one.append((ch, plain))
        else:
            several.append(ch)
    return "".join(a for a, _ in one) + "".join(several) + "".join(gone), "".join(b for _, b in one) + MARK * len(several)


@F.pandas_udf(StringType())
def _expanded(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else _plain(value))


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without the combining marks.

    ASCII texts pass untouched, others character by character in the JVM; only texts with a character that becomes
    several (ligatures, fractions, Hangul) go through Python.
    """
    known, plain = accent_table()
    ascii_only = F.octet_length(text) == F.char_length(text)
    mapped = F.translate(text, known, plain)
    odd = F.contains(mapped, F.lit(MARK))
    return F.when(ascii_only, text).when(odd, _expanded(F.when(~ascii_only & odd, text))).otherwise(mapped)


@functools.cache
def word_table() -> np.ndarray:
    """By code point: the lower-case letter, digit or underscore it stands for once accents are stripped; 0 for what
    parts words, GONE for a combining mark, SEVERAL for what becomes several characters."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if ch == "_" or ch.isalnum():
            lower = ch.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    known, plain = accent_table()
    for ch, to in zip(known, plain, strict=False):
        table[ord(ch)] = SEVERAL if to == MARK else table[ord(to)]
    table[[ord(ch) for ch in known[len(plain):]]] = GONE
    return table


def strip_breaks(html: Column) -> Column:
    """`<br />` and `<br/>` become a space."""
    return F.regexp_replace(html, r"<br ?/>", " ")


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value (as `%.nf` does in C and Python)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))
