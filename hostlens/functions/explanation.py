"""The explanation cell: JSON writing, reading and checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens.schemas import EXPLANATION
from hostlens.settings import ISSUE_MARKS, POSITIVE_MARKS, TEXT_ISSUE_MARKS

_SECTIONS = ("positive", "issues", "suggestions")


def _mentions(c: Column, marks: tuple[str, ...]) -> Column:
    lowered = F.lower(c)
    found = lowered.contains(marks[0])
    for mark in marks[1:]:
        found = found | lowered.contains(mark)
    return found


def is_positive_reason(c: Column) -> Column:
    return _mentions(c, POSITIVE_MARKS)


def is_issue_reason(c: Column) -> Column:
    """Checked after the positive marks: a reason is listed once or not at all."""
    return ~_mentions(c, POSITIVE_MARKS) & _mentions(c, ISSUE_MARKS)


def is_text_issue(c: Column) -> Column:
    return _mentions(c, TEXT_ISSUE_MARKS)


def to_json_cell(explanation: Column) -> Column:
    return F.to_json(explanation, {"ignoreNullFields": "false"})


def from_json_cell(cell: Column) -> Column:
    return F.from_json(cell, EXPLANATION)


def is_valid_cell(cell: Column) -> Column:
    """True for exactly one JSON object whose three sections are lists.

    The text is parsed inside an object and inside an array: trailing text can
    close one of the two early but never both. NaN and Infinity are refused.
    """
    fields = ",".join(f"{name}:array<string>" for name in _SECTIONS)
    wrapped = F.from_json(
        F.concat(F.lit('{"v":'), cell, F.lit(',"end":1}')),
        f"v struct<{fields}>, `end` int, bad string",
        {
            "columnNameOfCorruptRecord": "bad",
            "allowSingleQuotes": "false",
            "allowNonNumericNumbers": "false",
        },
    )
    alone = F.json_array_length(F.concat(F.lit("["), cell, F.lit("]"))) == 1
    ok = alone & wrapped["bad"].isNull() & (wrapped["end"] == 1)
    for name in _SECTIONS:
        ok = ok & wrapped["v"][name].isNotNull()
    return F.coalesce(ok, F.lit(False))
