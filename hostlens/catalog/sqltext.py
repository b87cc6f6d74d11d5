"""SQL spellings shared by the counterparts of several queries."""

from __future__ import annotations

from hostlens.functions.clean import MISSING_WORDS, WHITESPACE
from hostlens.settings import (
    AMENITY_ALIASES, ENGLISH_WORDS, EXPECTED_ROOMS, FRENCH_WORDS, ISSUE_MARKS,
    POSITIVE_MARKS, ROOM_KEYWORDS, TEXT_ISSUE_MARKS,
)

BLANK = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def quoted(*words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


MISSING = quoted(*MISSING_WORDS)


def strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def words(c: str) -> str:
    return (
        f"len(list_filter(regexp_split_to_array({c}, '{BLANK}+'), lambda x: x <> ''))"
    )


def any_word(c: str, choices) -> str:
    body = "|".join(choices)
    return (
        rf"regexp_matches({c}, '(?i)(^|[^\p{{L}}\p{{N}}_])({body})([^\p{{L}}\p{{N}}_]|$)')"
    )


def french(c: str) -> str:
    return any_word(c, FRENCH_WORDS)


def english(c: str) -> str:
    return any_word(c, ENGLISH_WORDS)


def arabic(c: str) -> str:
    return rf"regexp_matches({c}, '[\x{{600}}-\x{{6ff}}]')"


def half_even(c: str, digits: int) -> str:
    """Round the exact binary value, ties to even; c is a column name."""
    s = f"{10**digits}e0"
    k = f"floor({c} * {s})"
    high = f"({c} * 134217729e0 - ({c} * 134217729e0 - {c}))"
    gap = f"(({high} * (2 * {s}) - (2 * {k} + 1)) + ({c} - {high}) * (2 * {s}))"
    return (
        f"(CASE WHEN {gap} > 0 THEN {k} + 1 WHEN {gap} < 0 THEN {k} "
        f"ELSE {k} + ({k} % 2) END / {s})"
    )


def percent(c: str) -> str:
    return f"(CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


def normal(c: str, low, high) -> str:
    return f"(least(greatest(({c} - {low}) / ({high} - {low}), 0e0), 1e0) * 100)"


def clamp(c: str) -> str:
    return f"least(greatest({c}, 0e0), 100e0)"


def digits(c: str) -> str:
    return rf"regexp_extract({c}, '(\p{{Nd}}+)$', 1)"


def exposure(b: str) -> str:
    return (
        f"CASE WHEN {b} < 60 THEN {normal(b, '0e0', '60e0')} "
        f"WHEN {b} > 200 THEN {normal(f'(255 - {b})', '0e0', '55e0')} ELSE 100e0 END"
    )


def resolution(w: str, h: str) -> str:
    return normal(f"(CAST({w} AS DOUBLE) * CAST({h} AS DOUBLE) / 1e6)", "0.3e0", "2e0")


def aesthetic(valid: str = "valid") -> str:
    blend = (
        "(0.35e0 * least(colorfulness / 40e0, 1e0) + 0.35e0 * least(contrast / 60e0, 1e0) "
        "+ 0.3e0 * least(sharpness / 150e0, 1e0)) * 100"
    )
    return f"CASE WHEN {valid} THEN {clamp(blend)} ELSE 0e0 END"


def file_words(path: str) -> str:
    return f"replace(replace(lower(split_part({path}, '/', -1)), '_', ' '), '-', ' ')"


def room_case(path: str, value: int) -> str:
    """value 0: the room, 1: its confidence."""
    name = file_words(path)
    arms = " ".join(
        f"WHEN contains({name}, '{word}') THEN " + (f"'{room}'" if value == 0 else "0.5e0")
        for word, room in ROOM_KEYWORDS
    )
    cover, other = ("'exterior'", "'other'") if value == 0 else ("0.4e0", "0.2e0")
    return f"CASE {arms} WHEN contains({name}, 'cover') THEN {cover} ELSE {other} END"


def amenity_case(word: str) -> str:
    arms = []
    for key, aliases in AMENITY_ALIASES.items():
        tests = " OR ".join(
            f"contains({word}, '{a}') OR contains('{a}', {word})" for a in aliases
        )
        arms.append(f"WHEN {tests} THEN '{key}'")
    return f"CASE {' '.join(arms)} END"


def mentions(c: str, marks) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in marks) + ")"


def positive_reason(c: str) -> str:
    return mentions(c, POSITIVE_MARKS)


def issue_reason(c: str) -> str:
    return f"(NOT {mentions(c, POSITIVE_MARKS)} AND {mentions(c, ISSUE_MARKS)})"


def text_issue(c: str) -> str:
    return mentions(c, TEXT_ISSUE_MARKS)


def room_phrase(room: str, sure: str) -> str:
    shown = f"CASE WHEN {room} = 'living' THEN 'living room' ELSE replace({room}, '_', ' ') END"
    return (
        f"CASE WHEN {room} IS NULL THEN 'room guess unavailable' "
        f"WHEN {sure} >= 0.25 AND {room} IN ({quoted(*EXPECTED_ROOMS)}) "
        f"THEN 'room guess: ' || {shown} || ' (' || {percent(sure)} "
        f"|| ' classifier confidence)' "
        f"ELSE 'room guess: unknown room (top guess ' || {shown} || ', ' || {percent(sure)} "
        f"|| ' classifier confidence)' END"
    )


def present(*items: str) -> str:
    """A list of texts without its null entries."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def joined(c: str) -> str:
    return f"array_to_string({c}, ' | ')"
