"""Text functions that agree with Python's str methods (ST6 to ST13), all in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it.
WHITE = r"[\s\x1c-\x1f]"
#: Letters of Uzbek Cyrillic that Russian lacks, and frequent words of both languages.
UZBEK_LETTERS = "ўқғҳЎҚҒҲ"
RUSSIAN_WORDS = ("и", "в", "не", "на", "я", "что", "он", "она", "но", "это", "все", "как", "с", "из", "мне", "мы", "так", "они", "вы", "у", "от", "за", "по", "для", "бы", "до", "вот", "уже", "если", "при", "есть", "был", "было", "были", "быть", "очень", "или", "ни", "тоже", "ещё", "еще", "нет", "да", "же", "может")
UZBEK_WORDS = ("жуда", "яхши", "зўр", "маззали", "ёмон", "нарх", "йўқ", "бор", "учун", "менга", "билан", "ҳам", "лекин", "аммо", "сиз", "мен", "бу", "шу", "ўша", "қилиш", "бериш")
#: The four classes.
LATIN, RUSSIAN, UZBEK, MIXED = "Primarily Uzbek (Latin)", "Primarily Russian (Cyrillic)", "Primarily Uzbek (Cyrillic)", "Highly Mixed"


def strip(c: Column) -> Column:
    """Only texts that begin or end with white space go through the pattern, which looks at every run of it."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(f"(?U){WHITE}"), F.regexp_replace(c, f"(?U)^{WHITE}+|{WHITE}+$", "")).otherwise(c)


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c) with c, which of may name many times, worked out once for a row: Spark shares nothing between branches or within a lambda."""
    return F.element_at(F.transform(F.array(c), of), 1)


def words(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"(?U){WHITE}+"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def count_of(c: Column, letters: str) -> Column:
    """How many characters of a text are in a class of characters; runs of others go in one match each."""
    return F.length(F.regexp_replace(c, f"[^{letters}]+", ""))


def cyrillic_count(c: Column) -> Column:
    return count_of(c, r"Ѐ-ӿ")


def latin_count(c: Column) -> Column:
    """A to z in either case, the two apostrophe letters, the Kelvin sign, which lower-cases to k, and İ, whose lower case begins with i."""
    others = F.lit(0)
    for x in "ʻʼKİ":  # replaced one by one, for a class with them is no table of ASCII any more, and slow
        others = others + F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return count_of(c, "A-Za-z") + others


def script_shares(c: Column) -> Column:
    """struct(cyrillic, latin, letters): shares of both scripts' letters, 0 if there are none."""
    cyrillic, latin = cyrillic_count(c), latin_count(c)
    total = cyrillic + latin
    share = lambda n: F.when(total > 0, n / total).otherwise(0.0)
    return F.struct(share(cyrillic).alias("cyrillic"), share(latin).alias("latin"), total.alias("letters"))


def has_uzbek_letters(c: Column) -> Column:
    """By searches for each letter's bytes in place of a pattern."""
    return reduce(Column.__or__, (c.contains(x) for x in UZBEK_LETTERS))


def lexicon_share(c: Column, lexicon: tuple[str, ...]) -> Column:
    """The share of Cyrillic words that are in a lexicon."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[а-яёўқғҳ]+"), F.lit(0))
    return once(found, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.isin(*lexicon))) / F.size(ws)).otherwise(0.0))


def letter_counts(c: Column) -> Column:
    return F.struct(cyrillic_count(c).alias("cyrillic"), latin_count(c).alias("latin"))


def class_of(c: Column, n: Column) -> Column:
    """One of the four classes of a text, by its letter_counts n; a text without a letter counts as Latin."""
    total = n["cyrillic"] + n["latin"]
    uzbek = has_uzbek_letters(c) | (lexicon_share(c, UZBEK_WORDS) > 0.05)
    return F.when((total == 0) | (n["latin"] / F.nullif(total, F.lit(0)) > 0.7), LATIN).when(n["cyrillic"] / F.nullif(total, F.lit(0)) > 0.7, F.when(uzbek, UZBEK).otherwise(RUSSIAN)).otherwise(MIXED)


def script_class(c: Column) -> Column:
    """class_of with the text made and its letters counted once, for all branches."""
    of = lambda t: F.when(t.isNotNull(), once(letter_counts(t), lambda n: class_of(t, n))).otherwise(MIXED)
    return once(c, of)


def snippet(c: Column, size: int) -> Column:
    return F.translate(F.substring(c, 1, size), "\n", " ")
