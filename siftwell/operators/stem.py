"""Porter's stemmer, from the published algorithm, for the distinct words of a corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# The suffix tables of steps 2 to 4 (fixed values of the published algorithm).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VC = re.compile("v+c+")


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VC.findall(_shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _suffix(word: str, table) -> tuple[str, str] | None:
    """(stem, replacement) of the longest suffix in a table."""
    fits = [(s, r) for s, r in table if word.endswith(s)]
    if not fits:
        return None
    s, r = max(fits, key=lambda x: len(x[0]))
    return word[: len(word) - len(s)], r


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            word = cut + "e"
        else:
            word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        found = _suffix(word, table)
        if found and _measure(found[0]) > 0:
            word = found[0] + found[1]
    found = _suffix(word, [(s, "") for s in STEP4])
    if found and _measure(found[0]) > 1 and (not word.endswith("ion") or found[0].endswith(("s", "t"))):
        word = found[0]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def stems(rows: DataFrame, word: str = "term") -> DataFrame:
    """rows with stem, of the word without accents; only distinct words go through Python."""
    ship(rows.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=[porter(folded(w)) for w in b[word]])

    return rows.join(rows.select(word).distinct().mapInPandas(each, f"{word} string, stem string"), word)


def stemmed(postings: DataFrame) -> DataFrame:
    """(stem, key, tf ...) of postings with a column term."""
    return stems(postings, "term")
