"""Text measures: language markers, word counts, length and title scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens.functions.clean import strip
from hostlens.settings import (
    ARABIC_RANGE, DEFAULTS, ENGLISH_WORDS, FRENCH_WORDS, Settings,
)

# whitespace, ordered so that the common characters are decided by one table lookup
_ASCII_BLANK = r"[\t-\r\x1c-\x20]"
_BLANK = (
    r"[\t-\r\x1c-\x20\x85\xa0]"
    r"|(?=[ -　])[  -     　]"
)
_WORD = r"[\p{L}\p{N}_]"
# letters with a third spelling under Unicode case folding
_FOLDED = {"s": "sSſ", "k": "kKK"}
LANGUAGES = ("arabic", "french", "english")


def _letters(letter: str) -> str:
    return _FOLDED.get(letter, letter + letter.upper())


def _any_word(words: tuple[str, ...]) -> str:
    """Whole words in any case.

    Spelled with character classes and explicit boundaries: `\b` differs between
    Java versions, and a first-letter test keeps most positions cheap.
    """
    first = "".join(sorted({_letters(word[0]) for word in words}))
    spelled = "|".join("".join(f"[{_letters(c)}]" for c in word) for word in words)
    return rf"(?=[{first}])(?<!{_WORD})(?:{spelled})(?!{_WORD})"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def has_arabic(c: Column) -> Column:
    return ~is_ascii(c) & c.rlike(f"[{ARABIC_RANGE[0]}-{ARABIC_RANGE[1]}]")


def has_french(c: Column) -> Column:
    return c.rlike(_any_word(FRENCH_WORDS))


def has_english(c: Column) -> Column:
    return c.rlike(_any_word(ENGLISH_WORDS))


def word_count(c: Column) -> Column:
    """Number of pieces between Unicode blanks."""
    def pieces(blank: str) -> Column:
        return F.size(F.array_remove(F.split(c, blank), ""))

    return F.when(is_ascii(c), pieces(_ASCII_BLANK)).otherwise(pieces(_BLANK))


def has_content(c: Column) -> Column:
    return strip(c) != ""


def length_score(words: Column, s: Settings = DEFAULTS) -> Column:
    return (
        F.when(words < s.min_description_words, 30.0)
        .when(words < s.good_description_words, 60.0)
        .when(words < s.excellent_description_words, 85.0)
        .otherwise(95.0)
    )


def title_score(title_length: Column, s: Settings = DEFAULTS) -> Column:
    return (
        F.when(title_length == 0, 0.0)
        .when(title_length < s.min_title_length, 40.0)
        .otherwise(100.0)
    )
