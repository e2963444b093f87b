"""Column functions for Arabic and Latin form text. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmend.functions import constants as K


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs and trim, as a split-and-join would."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def blank_to_null(c: Column) -> Column:
    t = strip(c)
    return F.when(t.isin("", "null", "None"), F.lit(None)).otherwise(t)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def digits_ascii(c: Column) -> Column:
    return F.translate(c, K.DIGITS_FROM, K.DIGITS_TO)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(digits_ascii(c), "[^0-9]", "")


def alef(c: Column) -> Column:
    return F.translate(c, K.ALEF_FROM, K.ALEF_TO)


_PROFILES = {}


def _profile(name):
    def register(fn):
        _PROFILES[name] = fn
        return fn
    return register


@_profile("alef")
def _fold_alef(c):
    return squeeze(alef(F.regexp_replace(c, K.DIACRITICS, "")))


@_profile("letter")
def _fold_letter(c):
    """Diacritics out, alef unified, trimmed; inner spacing kept."""
    return strip(alef(F.regexp_replace(c, K.DIACRITICS, "")))


@_profile("full")
def _fold_full(c):
    t = F.regexp_replace(c, K.DIACRITICS, "")
    return strip(F.translate(t, K.ALEF_FROM + K.YEH_FROM + "ة", K.ALEF_TO + K.YEH_TO + "ه"))


@_profile("place")
def _fold_place(c):
    t = F.regexp_replace(c, K.DIACRITICS, "")
    t = F.translate(t, K.ALEF_FROM + K.YEH_FROM + "ةؤ", K.ALEF_TO + K.YEH_TO + "هو")
    return squeeze(F.regexp_replace(t, "(?U)[^\\w\\s؀-ۿ]", " "))


@_profile("choice")
def _fold_choice(c):
    t = F.regexp_replace(c, K.VALUE_DIACRITICS, "")
    return F.lower(squeeze(F.translate(t, K.ALEF_FROM + K.YEH_FROM + "ة", K.ALEF_TO + K.YEH_TO + "ه")))


@_profile("match")
def _fold_match(c):
    t = F.regexp_replace(c, K.WIDE_DIACRITICS, "")
    return strip(F.translate(t, K.ALEF_FROM + "ة", K.ALEF_TO + "ه"))


@_profile("eval")
def _fold_eval(c):
    t = F.regexp_replace(c, K.EVAL_DIACRITICS, "")
    return squeeze(F.translate(t, K.ALEF_FROM + "ىة", K.ALEF_TO + "يه"))


@_profile("skeleton")
def _fold_skeleton(c):
    t = F.translate(c, K.ALEF_FROM + "ىة", K.ALEF_TO + "يه")
    return F.regexp_replace(F.regexp_replace(t, K.DIACRITICS, ""), "(?U)[\\s‌‍ ]", "")


@_profile("confusion")
def _fold_confusion(c):
    return F.translate(c, K.CONFUSION_FROM, K.CONFUSION_TO)


@_profile("header")
def _fold_header(c):
    t = F.regexp_replace(c, K.HEADER_DIACRITICS, "")
    return F.translate(t, K.ALEF_FROM + K.YEH_FROM + "ة", K.ALEF_TO + K.YEH_TO + "ه")


@_profile("header_match")
def _fold_header_match(c):
    return F.lower(strip(alef(F.regexp_replace(c, K.HEADER_DIACRITICS, ""))))


@_profile("word")
def _fold_word(c):
    return F.lower(strip(F.translate(c, K.ALEF_FROM + "ى", K.ALEF_TO + "ي")))


PROFILES = tuple(_PROFILES)


def fold(c: Column | str, profile: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return _PROFILES[profile](col)


def tokens(c: Column) -> Column:
    """Whitespace tokens; a blank text gives an empty array."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def count_matches(c: Column, negated_class: str) -> Column:
    """Number of characters left after deleting the negated class."""
    return F.length(F.regexp_replace(c, negated_class, ""))


def arabic_chars(c: Column) -> Column:
    return count_matches(c, K.NOT_ARABIC)


def letter_count(c: Column) -> Column:
    return count_matches(c, K.NOT_LETTERS)


def arabic_share(c: Column) -> Column:
    """Arabic characters over all characters except spaces; 0 for blank text."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(F.length(bare) > 0, arabic_chars(bare) / F.length(bare)).otherwise(F.lit(0.0))


def mostly_arabic(c: Column) -> Column:
    return F.coalesce(arabic_share(c) > 0.5, F.lit(False))


def lines(c: Column) -> Column:
    """Lines with their ends normalised."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), "\n")


def any_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])
