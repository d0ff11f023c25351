"""Suffix stripping after Porter (1980): words of one stem are one term of a full-text index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published rules: suffix and what takes its place, the longest suffix that fits being tried alone. Fixed values.
_PLURAL = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
_DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_DERIVED = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_LAST = tuple((s, "") for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())


def _consonants(word: str) -> str:
    """The word as c and v: y is a vowel after a consonant."""
    out: list[str] = []
    for ch in word:
        out.append("v" if ch in "aeiou" or (ch == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return _consonants(word).count("vc")


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel and a consonant other than w, x and y."""
    return _consonants(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: tuple, least: int) -> str:
    """The word with its longest suffix of a table replaced, if what stands before it measures more than ``least``."""
    for suffix, other in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if _measure(head) > least and (suffix != "ion" or head[-1:] in ("s", "t")):
                return head + other
            return word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other scripts, short ones and those with digits are their own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for suffix, other in _PLURAL:
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + other
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            head = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _consonants(head):
                if head.endswith(("at", "bl", "iz")):
                    head += "e"
                elif len(head) > 1 and head[-1] == head[-2] and _consonants(head)[-1] == "c" and head[-1] not in "lsz":
                    head = head[:-1]
                elif _measure(head) == 1 and _short(head):
                    head += "e"
                word = head
                break
    if word.endswith("y") and "v" in _consonants(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _DOUBLE, 0), _DERIVED, 0)
    word = _replace(word, _LAST, 1)
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stems(word: Column) -> Column:
    """Stems of a column of distinct words: each is worked out once, not once an occurrence."""
    return _stems(word)
