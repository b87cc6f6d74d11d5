"""Toxicity of texts after undoing leetspeak, spacing and repetition with a character model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hostlens.llm.common import pieces
from hostlens.llm.partenum import shingle_sets
from hostlens.session import cut

TRAIN_ROWS = 20_000  # bound of the labelled sample that the classifier is fitted on
LEAST_SUPPORT, LEAST_PRECISION = 4, 0.9
# a feature that so many unrelated toxic rows have, at this precision, needs no other reason
SURE_SUPPORT, SURE_PRECISION = 8, 0.9
MOST_FEATURES = 2_000  # of one word or stem each; what they weigh is a few hundred kB
STEMS = (4, 5, 6)
SYMBOLS = 64  # 0: no letter, 1-26: a-z, the rest: other letters by code point
CACHE = 250_000
MASK_RUN, MASK_LETTERS = 3, 3
MOST_RUN = 3  # longer runs of one character are read as so many
PART, STEP = 200, 100  # long spans are read in parts of PART characters that start STEP apart

# what a sign may stand for
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
JOINERS = " \t\n.-_*~'`,"
# costs in nats: a sign read as a letter, a masked letter, a dropped repetition in a run of
# three or more or of two, a dropped joiner, a joiner or sign read as the end of a word
SIGN, MASK, LONG_RUN, SHORT_RUN, DROP, STOP = 1.0, 3.5, 0.3, 2.0, 0.2, 2.0

_DOUBLE = re.compile(r"([^\W\d_])\1")
_RUN = re.compile(r"(.)\1{%d,}" % MOST_RUN, re.DOTALL)
_SIGNS = re.compile("[" + re.escape("".join(LEET)) + r"*]")
_STARS = re.compile(r"\*{%d,}" % MASK_RUN)
_TRIPLE = re.compile(r"(.)\1\1")
_WORDS = re.compile(r"[^\W\d_]+")
# single letters or signs with joiners between them
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(€£])(?:[\s.\-_*~'`,]{1,4}(?:[^\W_]|[@$!|+(€£])){2,}"
                     r"(?![^\W_])")
_JOINED = re.compile(r"[^\W\d_][.\-_*~'`,]+[^\W\d_]")
_EDGES = " \t\n\r\x0b\x0c.,;:!?%&$#*|()[]{}<>\"'`~-_=+/\\…«»“”‘’"

# edges that stand for no letter; a last `!` ends a sentence
_OUTER = "".join(c for c in _EDGES if c not in LEET and c != "*")
_ENDS = _OUTER + "!"
# a token without letters may be a word if it has two of these
_HARD_SIGNS = re.compile(r"[@$€£].*[@$€£]")


def _symbol_table() -> np.ndarray:
    table = np.array([27 + c % 37 if chr(c).isalpha() else 0 for c in range(0x250)], dtype=np.int64)
    table[97:123] = np.arange(1, 27)
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbol of each character of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)],
                    27 + points % 37)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all symbol trigrams of all texts: a table of fixed size (SYMBOLS cubed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in pieces(batches):
            text = "\n\n".join(t for t in batch.column(0).to_pylist() if t)
            s = symbols(f"\n\n{text}\n\n".lower())
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:],
                                 minlength=SYMBOLS ** 3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram bigint, n bigint")
    counts = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for row in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Minus log probability of a symbol after two others, backed off to shorter histories."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


_SYMBOL: dict[str, int] = {}


def word_symbols(word: str) -> list[int]:
    """`symbols` of a short text, character by character."""
    found = list(map(_SYMBOL.get, word))
    if None in found:
        if len(_SYMBOL) > CACHE:
            _SYMBOL.clear()
        _SYMBOL.update(zip(word, symbols(word).tolist(), strict=True))
        found = list(map(_SYMBOL.get, word))
    return found


class Costs:
    """The table of `character_costs` in the two forms that the search reads."""

    def __init__(self, costs: np.ndarray) -> None:
        self.table = costs.astype(np.float64)
        self.flat = self.table.ravel().tolist()


def moves_of(span: str, ends: bool = True) -> list[list[tuple[str, int, float]]]:
    """The lattice of a lower-case span: for each character its (output, symbol, price).

    A letter reads as itself, or as nothing where it repeats the one before; a sign as a
    letter it stands for, as nothing (joiners) or, with `ends`, as the end of a word; a star
    as any letter. MASK_RUN stars or more are no letters beside MASK_LETTERS letters or more:
    they decorate a word.
    """
    own = word_symbols(span)
    lattice = []
    masks = [True] * len(span)
    if "*" in span and sum(map(str.isalpha, span)) >= MASK_LETTERS:
        for run in _STARS.finditer(span):
            masks[run.start(): run.end()] = [False] * len(run.group())
    for at, char in enumerate(span):
        moves: list[tuple[str, int, float]] = []
        if char.isalpha():
            moves.append((char, own[at], 0.0))
            if at and span[at - 1] == char:
                longer = at > 1 and span[at - 2] == char or span[at + 1: at + 2] == char
                moves.append(("", -1, LONG_RUN if longer else SHORT_RUN))
        else:
            moves += [(letter, ord(letter) - 96, SIGN) for letter in LEET.get(char, "")]
            if char == "*" and masks[at]:
                moves += [(chr(96 + k), k, MASK) for k in range(1, 27)]
            if char in JOINERS:
                moves.append(("", -1, DROP))
            if ends or not moves:
                moves.append((" ", 0, STOP))
        lattice.append(moves)
    return lattice


State = tuple[int, int]


def _masked_letters(states: dict[State, tuple[float, str]], table: np.ndarray,
                    fresh: dict[State, tuple[float, str]]) -> None:
    """Any letter after each state, all at once: what `decode` does for each single move."""
    keys = sorted(states, key=lambda key: (key[1], states[key][1]))
    a, b = np.array(keys).T
    total = np.array([states[key][0] for key in keys])[:, None] + (MASK + table[a, b, 1:27])
    edges = np.append(np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))), len(b))
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        best = total[first:last].argmin(axis=0)  # of equal ones the first by text
        least = total[first + best, np.arange(26)].tolist()
        for k, at in enumerate(best.tolist()):
            fresh[int(b[first]), k + 1] = (least[k], states[keys[first + at]][1] + chr(97 + k))


def decode(span: str, costs: Costs, ends: bool = True) -> str:
    """The best reading of a lower-case span by the character model, exactly.

    Viterbi search over the lattice: a state is the last two symbols put out, and keeps its
    cheapest reading, of equal ones the first by text. A word ends once: after an end, or
    before the first letter, another end adds nothing.
    """
    flat = costs.flat
    states: dict[State, tuple[float, str]] = {(0, 0): (0.0, "")}
    for moves in moves_of(span, ends):
        fresh: dict[State, tuple[float, str]] = {}
        if len(moves) > 26:  # a star; its letters come first
            _masked_letters(states, costs.table, fresh)
            moves = moves[26:]
        for (a, b), (cost, text) in states.items():
            row = (a * SYMBOLS + b) * SYMBOLS
            for out, s, price in moves:
                if s < 0 or s == 0 and b == 0:
                    key, new = (a, b), (cost + price, text)
                else:
                    key, new = (b, s), (cost + (price + flat[row + s]), text + out)
                old = fresh.get(key)
                if old is None or new < old:
                    fresh[key] = new
        states = fresh
    return min((cost + flat[(a * SYMBOLS + b) * SYMBOLS], text)
               for (a, b), (cost, text) in states.items())[1]


def decode_doubles(word: str, costs: Costs) -> str:
    """`decode` of letters in which none stands more than twice in a row.

    After the letter behind a pair, the last two symbols are the same whether one of the
    pair was dropped or not. So each pair is decided by itself, by the costs of its second
    letter and of the one behind it.
    """
    flat, s, out, kept = costs.flat, word_symbols(word), [], 0
    for pair in _DOUBLE.finditer(word):
        at = pair.start()
        before = s[at - 1] if at else 0
        p, after = s[at], s[at + 2] if at + 2 < len(s) else 0
        both = flat[(before * SYMBOLS + p) * SYMBOLS + p] + flat[(p * SYMBOLS + p) * SYMBOLS + after]
        one = SHORT_RUN + flat[(before * SYMBOLS + p) * SYMBOLS + after]
        if one < both:
            out.append(word[kept: at + 1])
            kept = at + 2
    return "".join([*out, word[kept:]])


class Reader:
    """Words of texts, with obfuscated spans restored; remembers tokens seen before."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = Costs(costs)
        self.seen: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            known = self.seen[token] = self._read(token)
        return known

    def span(self, span: str) -> list[str]:
        """The words that a span of any length is read as; without letters, signs are letters."""
        ends = _WORDS.search(span) is not None
        span = _RUN.sub(lambda run: run.group(1) * MOST_RUN, span)
        if len(span) <= PART:
            return decode(span, self.costs, ends).split()
        # every stretch of up to PART - STEP characters lies in one of the parts
        return [word for at in range(0, len(span) - PART + STEP, STEP)
                for word in decode(span[at: at + PART], self.costs, ends).split()]

    def _read(self, token: str) -> tuple[str, ...]:
        plain = token if token.isalpha() else token.strip(_OUTER).rstrip(_ENDS)
        double = _DOUBLE.search(plain)
        if plain.isalpha():
            if not double:
                return (plain,)
            if not _TRIPLE.search(plain):
                once = decode_doubles(plain, self.costs)
                return (plain,) if once == plain else (plain, once)
        words = _WORDS.findall(token)
        if (words or _HARD_SIGNS.search(token)) and (
                double or _SIGNS.search(plain) or _JOINED.search(plain)):
            # signs at the edges may be letters or not: both are read
            core = plain.strip(_EDGES)
            for span in dict.fromkeys((plain, core)):
                if span:
                    words += self.span(span)
        return tuple(dict.fromkeys(words))

    def words(self, text: str) -> set[str]:
        text = text.lower()
        found: set[str] = set()
        for token in set(text.split()):
            found.update(self.token(token))
        for match in _SPACED.finditer(text):
            span = match.group()
            if _WORDS.search(span) or _HARD_SIGNS.search(span):
                found.update(self.span(span))
        return found


def features(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


@dataclass
class ToxicModel:
    """The character model, and what each word or stem says of a text that has it."""

    costs: np.ndarray
    weights: dict[str, float]
    base: float

    def __post_init__(self) -> None:
        self.stems = [(n, {f for f in self.weights if f.endswith("-") and len(f) == n + 1})
                      for n in STEMS]

    def score(self, words: set[str]) -> float:
        """One minus the chance that none of the found features marks the text."""
        hits, clean = words & self.weights.keys(), 1 - self.base
        for n, stems in self.stems:
            if stems:
                hits.update({f"{w[:n]}-" for w in words if len(w) > n} & stems)
        for hit in sorted(hits):
            clean *= 1 - self.weights[hit]
        return 1 - clean


def choose_features(rows: list[tuple[bool, int, list[str]]]) -> tuple[dict[str, float], float]:
    """(weights, base) from labelled rows (toxic, family, features): a decision list.

    Rows of a family are copies or near copies, and count once in a feature's support. All
    features with SURE_SUPPORT and SURE_PRECISION are taken. Then, in turn, the one that
    marks most toxic rows not marked yet, if its precision is at least LEAST_PRECISION and
    its support LEAST_SUPPORT. So words that merely come along with a better one are not
    taken. Ties go to the higher precision, then the shorter, then the first by text.
    """
    toxic: dict[str, set[int]] = {}
    clean: dict[str, set[int]] = {}
    where: dict[str, list[int]] = {}
    for at, (label, family, found) in enumerate(rows):
        for f in found:
            (toxic if label else clean).setdefault(f, set()).add(family)
            if label:
                where.setdefault(f, []).append(at)

    def precision(f):
        return len(toxic[f]) / (len(toxic[f]) + len(clean.get(f, ())))

    good = [f for f, n in toxic.items()
            if len(n) >= LEAST_SUPPORT and precision(f) >= LEAST_PRECISION]
    sure = [f for f in good if len(toxic[f]) >= SURE_SUPPORT and precision(f) >= SURE_PRECISION]
    sure = sorted(sure, key=lambda f: (-len(toxic[f]), len(f), f))[:MOST_FEATURES]
    marked = {at for f in sure for at in where[f]}
    left = {f: len({rows[at][1] for at in where[f] if at not in marked}) for f in good}
    chosen = list(sure)
    while left and len(chosen) < MOST_FEATURES:
        best = min(left, key=lambda f: (-left[f], -precision(f), len(f), f))
        if left[best] < LEAST_SUPPORT:
            break
        chosen.append(best)
        fresh = [at for at in where[best] if at not in marked]
        marked.update(fresh)
        for f in {f for at in fresh for f in rows[at][2] if f in left}:
            left[f] = len({rows[at][1] for at in where[f] if at not in marked})
    weights = {f: (len(toxic[f]) + 0.5) / (len(toxic[f]) + len(clean.get(f, ())) + 1)
               for f in chosen}
    quiet = [label for label, _, found in rows if not any(f in weights for f in found)]
    return weights, (sum(quiet) + 0.5) / (len(quiet) + 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Learn the character model from all texts and the classifier from labelled ones.

    `labels` has doc_id and toxic; rows without either are left out, of repeated ids the
    larger label counts. At most `train_rows` labelled rows are used, those with the
    smallest hashes of their id; that sample is broadcast and only its texts reach the
    driver, as lists of words and stems that two or more toxic rows have.
    """
    costs = character_costs(trigram_counts(docs, text_col))
    sample = (
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in pieces(batches):
            words = [reader.words(t or "") for t in batch.column(1).to_pylist()]
            # near copies mostly share the shingle with the smallest hash
            hashes, sizes = shingle_sets(batch.column(1))
            family = np.zeros(len(sizes), dtype=np.uint64)
            family[sizes > 0] = hashes[(np.cumsum(sizes) - sizes)[sizes > 0]]
            out = [sorted({f for w in found for f in features(w)}) for found in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(family.view(np.int64)),
                 pa.array(out, pa.list_(pa.string()))], ["toxic", "family", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    read = cut(rows.mapInArrow(
        run, "toxic int, family bigint, found array<string>").withColumn(
        "row", F.monotonically_increasing_id()), "toxic-words")
    counts = read.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum(F.col("toxic")).alias("t"), F.count(F.lit(1)).alias("n"))
    useful = counts.filter((F.col("t") >= LEAST_SUPPORT) & (
        F.col("t") >= LEAST_PRECISION * F.col("n"))).select("f")
    kept = read.select("row", F.explode("found").alias("f")).join(useful, "f").groupBy("row").agg(
        F.collect_list("f").alias("found"))
    whole = read.select("row", "toxic", "family").join(kept, "row", "left").select(
        "toxic", "family", "found").collect()
    weights, base = choose_features(
        [(r["toxic"] == 1, r["family"], sorted(r["found"] or [])) for r in whole])
    return ToxicModel(costs, weights, base)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text",
                   out_col: str = "toxicity") -> DataFrame:
    """The rows with the score of their whole texts, 0 to 1; null texts score as empty ones.

    Only the text is read; no row depends on another. A column of the new name is replaced.
    Tokens with signs, joiners or doubled letters are read both as they stand and decoded;
    tokens and spaced runs of any length are read to their end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != out_col]
    schema = StructType([*kept, StructField(out_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        reader = Reader(scorer.costs)
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            scores = [scorer.score(reader.words(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                + [pa.array(scores, pa.float64())], names=[f.name for f in kept] + [out_col])

    return docs.mapInArrow(run, schema)
