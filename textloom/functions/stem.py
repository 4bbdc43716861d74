"""A Porter-style stemmer in which y is never a vowel: as Column steps, and for single words.

The steps are data: suffix rules tried in order, of which the first that fits decides. The Column
form builds one projection a step over distinct words, so that expressions stay small; the word
form serves literal queries.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and their replacements by step, in the order they are tried.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
VOWEL_RUN = "[aeiou]+[^aeiou]+"
CVC = "[^aeiou][aeiou][^aeiouwxy]$"
DOUBLE = r"([^aeiou])\1$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _measure(w: Column) -> Column:
    return F.regexp_count(w, F.lit(VOWEL_RUN))


def _first_rule(w: Column, rules: tuple[tuple[str, str], ...], least: int | None) -> Column:
    """Replace the first suffix that fits, if what is left has a measure over ``least``."""
    out = None
    for suffix, new in rules:
        left = _cut(w, len(suffix))
        made = F.concat(left, F.lit(new))
        value = made if least is None else F.when(_measure(left) > least, made).otherwise(w)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(w)


def with_stem(words: DataFrame, word: str = "word", out: str = "term") -> DataFrame:
    """words with the stem of each; words of one or two letters are left as they are."""
    w = F.col(out)
    steps = words.withColumn(out, _first_rule(F.lower(word), STEP_1A, None))
    vowel = lambda c: c.rlike("[aeiou]")
    cut_1b = F.when(w.endswith("eed"), F.lit(0)).when(w.endswith("ed") & vowel(_cut(w, 2)), F.lit(2)).when(~w.endswith("ed") & w.endswith("ing") & vowel(_cut(w, 3)), F.lit(3)).otherwise(F.lit(0))
    steps = steps.withColumn("__cut", cut_1b)
    steps = steps.withColumn(out, F.when(w.endswith("eed") & (_measure(_cut(w, 3)) > 0), _cut(w, 1)).otherwise(F.substring(w, F.lit(1), F.length(w) - F.col("__cut"))))
    again = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE) & ~w.rlike("[lsz]$"), _cut(w, 1)).when((_measure(w) == 1) & w.rlike(CVC), F.concat(w, F.lit("e"))).otherwise(w)
    steps = steps.withColumn(out, F.when(F.col("__cut") > 0, again).otherwise(w)).drop("__cut")
    steps = steps.withColumn(out, F.when(w.endswith("y") & vowel(_cut(w, 1)), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    steps = steps.withColumn(out, _first_rule(w, STEP_2, 0))
    steps = steps.withColumn(out, _first_rule(w, STEP_3, 0))
    fourth = None
    for s in STEP_4:
        left = _cut(w, len(s))
        fits = _measure(left) > 1
        value = F.when(fits & left.rlike("[st]$") if s == "ion" else fits, left).otherwise(w)
        fourth = F.when(w.endswith(s), value) if fourth is None else fourth.when(w.endswith(s), value)
    steps = steps.withColumn(out, fourth.otherwise(w))
    left = _cut(w, 1)
    steps = steps.withColumn(out, F.when(w.endswith("e") & ((_measure(left) > 1) | ((_measure(left) == 1) & ~left.rlike(CVC))), left).otherwise(w))
    steps = steps.withColumn(out, F.when((_measure(w) > 1) & w.endswith("ll"), left).otherwise(w))
    return steps.withColumn(out, F.when(F.col(word).isNull(), F.lit("")).when(F.length(word) <= 2, F.col(word)).otherwise(w))


_VOWEL, _RUNS = re.compile("[aeiou]").search, re.compile(VOWEL_RUN).findall
_CVC, _DOUBLE, _SHORT = re.compile(CVC).search, re.compile(DOUBLE).search, ("at", "bl", "iz")
# each step's suffixes together: most words have none of them, which one test tells
_STEPS = tuple((tuple(a for a, _ in rules), rules, least) for rules, least in ((STEP_2, 0), (STEP_3, 0), (tuple((a, "") for a in STEP_4), 1)))


def measure(word: str) -> int:
    return len(_RUNS(word))


def stem_once(word: str | None) -> str:
    """The stem of one word, which is not remembered."""
    if not word or len(word) <= 2:
        return word or ""
    w = word.lower()
    if w[-1] == "s":
        w = next(w[: len(w) - len(a)] + b for a, b in STEP_1A if w.endswith(a))
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        ending = next((s for s in ("ed", "ing") if w.endswith(s)), None)
        if ending and _VOWEL(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(_SHORT) or not _DOUBLE(w) and measure(w) == 1 and _CVC(w):
                w += "e"
            elif _DOUBLE(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _DOUBLE(w) and measure(w) == 1 and _CVC(w):
                w += "e"
    if w.endswith("y") and _VOWEL(w[:-1]):
        w = w[:-1] + "i"
    for suffixes, rules, least in _STEPS:
        if w.endswith(suffixes):
            suffix, new = next(r for r in rules if w.endswith(r[0]))
            left = w[: len(w) - len(suffix)]
            if measure(left) > least and (suffix != "ion" or left[-1:] in ("s", "t")):
                w = left + new
    if w.endswith("e") and ((m := measure(w[:-1])) > 1 or m == 1 and not _CVC(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@lru_cache(100_000)
def stem_word(word: str | None) -> str:
    """The stem of one word."""
    return stem_once(word)
