"""Cleaning of raw text cells into typed, default-filled values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: spellings of a missing cell, accepted booleans, whitespace ---
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_WORDS = ("true", "1", "yes", "y", "on", "1.0")
FALSE_WORDS = ("false", "0", "no", "n", "off", "", "0.0")
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# --- end of fixed values ---

# one flat list item: a quoted string, a number or a bare constant
_ITEM = (
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[-+]?[0-9][0-9.eE+-]*"""
    r"""|True|False|None"""
)
_FLAT_LIST = rf"(?s)^\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?\]$"
_NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only the space."""
    return F.btrim(c, F.lit(WHITESPACE))


def missing_to_null(c: Column) -> Column:
    """Map the spellings of a missing cell to null."""
    return F.when(~c.isin(*MISSING_WORDS), c)


def as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def number(c: Column) -> Column:
    """A decimal number, infinity or NaN as double; null for any other text.

    Plain casts would also take type suffixes and hexadecimal floats.
    """
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _number(c: Column, kind: str, strict: bool) -> Column:
    blank = c.isNull() | (strip(c) == "")
    value = number(c)
    usable = value.isNotNull()
    if kind == "bigint":
        usable = usable & ~F.isnan(value) & (F.abs(value) < F.lit(9.2e18))
        value = F.when(usable, value).cast("bigint")
    junk = (
        F.raise_error(F.concat(F.lit("not a number: "), c)).cast(kind)
        if strict
        else F.lit(None).cast(kind)
    )
    return F.when(blank, F.lit(0).cast(kind)).when(usable, value).otherwise(junk)


def as_int(c: Column, strict: bool = True) -> Column:
    """Blank is 0, fractions are cut toward zero, junk is an error."""
    return _number(c, "bigint", strict)


def as_float(c: Column, strict: bool = True) -> Column:
    return _number(c, "double", strict)


def as_bool(c: Column, strict: bool = True) -> Column:
    """A closed list of words; anything else is an error."""
    word = F.lower(strip(F.coalesce(c, F.lit(""))))
    junk = (
        F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")
        if strict
        else F.lit(None).cast("boolean")
    )
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(junk)
    )


def _json_items(text: Column) -> Column:
    """Items of a JSON array as text; null when the text is not one array."""
    wrapped = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit(',"end":1}')),
        "v array<string>, `end` int, bad string",
        {"columnNameOfCorruptRecord": "bad", **_STRICT},
    )
    one_value = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    items = F.when(one_value & wrapped["bad"].isNull() & (wrapped["end"] == 1), wrapped["v"])
    # bare constants are spelled the way Python prints them; a quoted "true" stays
    tokens = F.regexp_extract_all(
        text, F.lit(r"""("(?:[^"\\]|\\.)*"|[^\s,\[\]"]+)"""), F.lit(1)
    )
    spelled = F.zip_with(items, tokens, lambda v, t: (
        F.when(t == "true", F.lit("True"))
        .when(t == "false", F.lit("False"))
        .when(v.isNull(), F.lit("None"))
        .otherwise(v)
    ))
    plain = F.transform(items, lambda v: F.coalesce(v, F.lit("None")))
    return F.when(F.size(items) == F.size(tokens), spelled).otherwise(plain)


def _literal_items(text: Column) -> Column:
    """Items of a flat Python list literal; null when the text is not one."""
    def unquote(t: Column) -> Column:
        inner = t.substr(F.lit(2), F.length(t) - 2)
        return F.when(
            t.startswith("'") | t.startswith('"'),
            F.regexp_replace(inner, r"""\\(['"\\])""", "$1"),
        ).otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit(f"({_ITEM})"), F.lit(1))
    return F.when(text.rlike(_FLAT_LIST), F.transform(tokens, unquote))


def parse_list(c: Column) -> Column:
    """A list cell: JSON array, flat Python list, or pipe-separated text."""
    text = strip(F.coalesce(c, F.lit("")))
    bracketed = F.coalesce(_json_items(text), _literal_items(text), F.array(text))
    pieces = F.filter(
        F.transform(F.split(text, "[|]"), strip), lambda piece: piece != ""
    )
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.startswith("["), bracketed)
        .otherwise(pieces)
    )


CONVERTERS = {
    "text": lambda c, strict: as_text(c),
    "int": as_int,
    "float": as_float,
    "bool": as_bool,
    "list": lambda c, strict: parse_list(c),
}
# the type of each kind after conversion, for columns that are absent
TYPES = {
    "text": "string", "int": "bigint", "float": "double", "bool": "boolean",
    "list": "array<string>",
}
