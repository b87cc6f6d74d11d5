"""Small tables and brute-force counterparts for the pipeline operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, low string, key string, n_lines string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, s, "x", "y", "z") for i, t, s in rows], SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def edge_rows():
    """Nulls, empties, ties, repeated rows, odd white space, a very long text."""
    rng = random.Random(5)
    long = prose(rng, 30_000, 5_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", "b"), (4, "Same Text here", None),
        (5, "same text HERE", "b"), (5, "same text HERE", "b"), (6, "ÄÖ straße\x0bb\x1cc", "b"),
        (7, long, "a"), (8, long + " end", "c"), (None, "same text here", "a"),
        (None, None, None), (9, "one", "c"), (10, "a\n\nb\nb", "c"),
    ]


def corpus(seed=3, n=60):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and rows:
            text = rng.choice(rows)[1]
            parts = text.split(" ")
            for _ in range(rng.randint(0, max(1, len(parts) // 40))):
                parts[rng.randrange(len(parts))] = f"edit{rng.randint(0, 9)}"
            text = " ".join(parts)
        else:
            text = prose(rng, rng.choice([1, 3, 4, 5, 8, 40, 120, 300]))
        if kind > 0.8:
            at = rng.randint(0, 20)
            parts = text.split(" ")
            text = " ".join(parts[:at] + [passage] + parts[at:])
        rows.append((i, text, rng.choice("aaabc")))
    return rows
