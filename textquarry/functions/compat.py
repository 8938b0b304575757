"""TXT1: compatibility composition (NFKC) in the JVM wherever no marks have to be put in order.

Three sets of characters, all taken from the character database by rule. Plain ones stay as they are whatever stands beside
them: their own NFKC is themselves, they don't combine, and nothing composes with them as a second character. Folded ones turn
into plain ones, one (full-width letters, superscripts, the no-break space) or several (ligatures, the ellipsis). A text of
plain characters is its own NFKC; of plain and folded ones it is what a character map makes of it. Only texts with others,
combining marks first of all, go to Python, in Arrow batches.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every run of plain characters of Latin letters and of general punctuation counts, elsewhere those of so many at least: a class of few ranges is fast.
EVERY, RUN = (range(0x250), range(0x2010, 0x2070)), 40
#: Folded characters are looked for below this, and among ligatures and full-width forms.
FOLDED = (range(0x80, 0x2150), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


@lru_cache
def plain_runs() -> list[tuple[int, int]]:
    """First and last of the runs of plain characters."""
    seconds = set()
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    seconds |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # the vowels and finals of Hangul compose by arithmetic
    runs, begin = [], None
    for c in range(sys.maxunicode + 2):
        own = chr(c) if c <= sys.maxunicode else ""
        plain = own and not 0xD800 <= c < 0xE000 and unicodedata.category(own) != "Cn" and not unicodedata.combining(own) and c not in seconds and unicodedata.normalize("NFKC", own) == own
        if plain and begin is None:
            begin = c
        elif not plain and begin is not None:
            if any(begin in own for own in EVERY) or c - begin >= RUN:
                runs.append((begin, c - 1))
            begin = None
    return runs


def is_plain(text: str) -> bool:
    return all(any(a <= ord(c) <= b for a, b in plain_runs()) for c in text)


@lru_cache
def folded() -> dict[str, str]:
    """Characters whose NFKC is plain characters."""
    found = {chr(c): unicodedata.normalize("NFKC", chr(c)) for own in FOLDED for c in own if not unicodedata.combining(chr(c))}
    return {c: to for c, to in found.items() if c != to and is_plain(to)}


def _class(runs) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a < b else f"\\x{{{a:x}}}" for a, b in runs)


def _outside(runs) -> str:
    """A character of none of the runs. ASCII is plain, and is passed by one comparison instead of one with every run."""
    return rf"(?=[^\x00-\x7F])[^{_class(runs)}]"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def fold(text: Column) -> Column:
    """Folded characters replaced; right for texts of plain and folded ones."""
    single = {c: to for c, to in folded().items() if len(to) == 1}
    several = {c: to for c, to in folded().items() if len(to) != 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    many = out
    for c, to in several.items():
        many = F.replace(many, F.lit(c), F.lit(to))
    return F.when(out.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in several) + "]"), many).otherwise(out)


def nfkc(text: Column) -> Column:
    """The NFKC of a text; null stays null."""
    latin = [r for r in plain_runs() if r[0] < 0x250]
    known = plain_runs() + [(ord(c), ord(c)) for c in folded()]
    beyond = text.rlike(_outside(latin))  # most texts are done here
    others = text.rlike(_outside(plain_runs()))
    python = text.rlike(_outside(known))
    way = F.when(~beyond, F.lit(0)).when(~others, F.lit(0)).when(~python, F.lit(1)).otherwise(F.lit(2))
    return F.when(way == 0, text).when(way == 1, fold(text)).otherwise(_composed(F.when(way == 2, text)))
