"""Exact encoding with a merge-type piece vocabulary by backtracking, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from hostlens.llm.common import pieces

SPACE = "▁"
_RUNS = re.compile(f"({SPACE}*)([^{SPACE}]*)")
# words and token pairs that a worker remembers; they only save time
CACHE_WORDS, CACHE_PAIRS = 250_000, 250_000


class Vocabulary:
    """Pieces, scores and kinds of a model file; small (a few MB), so it is sent to all workers."""

    def __init__(self, pieces: list[str], scores: list[float], control: set[int],
                 unknown: int, byte_ids: list[int]) -> None:
        self.pieces, self.scores, self.control = pieces, scores, control
        self.unknown, self.byte_ids = unknown, byte_ids

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file on the driver with the public library."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        found = cls(
            [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids],
            {i for i in ids if model.is_control(i) or model.is_unused(i)}, model.unk_id(),
            [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if found.unknown in found.byte_ids:
            raise ValueError("the model needs a piece for each byte")
        return found


class Encoder:
    """Byte-pair merging of one model, found without merging.

    Longest matches come from an Aho-Corasick automaton. A sequence of tokens is the result
    of merging exactly if each pair of neighbours is: if merging the text of the two gives
    the two again. So the encoder takes the longest token that is compatible with its left
    neighbour, tries shorter ones, and steps back where none is left; a bitfield of failed
    positions keeps it from trying an end twice.

    Pieces hold the space sign at the front only, so merging never crosses it and words are
    encoded one by one. Pieces of several space signs have the lowest score of all; runs of
    spaces merge among themselves after everything else, leftmost first.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        special = vocabulary.control | {vocabulary.unknown} | set(vocabulary.byte_ids)
        self.byte_ids = vocabulary.byte_ids
        self.rank: dict[str, float] = {}
        self.spaces: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, (piece, score) in enumerate(zip(vocabulary.pieces, vocabulary.scores, strict=True)):
            if i in special:
                continue
            if SPACE in piece.lstrip(SPACE) or (piece.startswith(SPACE * 2) and piece.strip(SPACE)):
                raise ValueError(f"piece {piece!r} holds a space sign behind its front")
            self.ids[piece] = i
            (self.spaces if piece.startswith(SPACE * 2) else self.rank)[piece] = score
        lowest = min((s for p, s in self.rank.items() if len(p) > 1), default=0.0)
        if self.spaces and max(self.spaces.values()) >= lowest:
            raise ValueError("runs of spaces must merge last")
        self.text = {i: piece for piece, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.chars = {piece for piece in self.rank if len(piece) == 1}
        # a piece that merging its own text does not give, or that holds other characters,
        # is never a token
        usable = {piece for piece in self.rank if len(piece) == 1 or (
            self.chars.issuperset(piece) and self.merge(piece, self.rank) == [piece])}
        self.automaton = ahocorasick.Automaton()
        self.length = [len(piece) for piece in vocabulary.pieces]
        self.shorter = [-1] * len(vocabulary.pieces)  # the longest token that begins a token
        for piece in usable:
            self.automaton.add_word(piece, self.ids[piece])
            prefix = piece[:-1]
            while prefix and prefix not in usable:
                prefix = prefix[:-1]
            if prefix:
                self.shorter[self.ids[piece]] = self.ids[prefix]
        self.automaton.make_automaton()
        self.words = _Words(self)

    @staticmethod
    def merge(text: str, rank: dict[str, float]) -> list[str]:
        """Merging as defined: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the texts of two neighbours gives the two again."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            known = self.pairs[key] = self.merge(a + b, self.rank) == [a, b]
        return known

    def _known(self, text: str) -> list[int]:
        """Tokens of a text whose characters are all pieces."""
        size, length, shorter = len(text), self.length, self.shorter
        longest = [0] * size
        for end, token in self.automaton.iter(text):  # of one start, the last is the longest
            longest[end - length[token] + 1] = token
        failed = bytearray(size + 1)
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + length[token]
            if not failed[end] and (last < 0 or self.compatible(last, token)):
                tokens.append(token)
                if end == size:
                    return tokens
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                failed[at] = 1
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
                token = shorter[token]

    def word(self, text: str) -> list[int]:
        """Tokens of a text without runs of space signs; other characters become bytes."""
        if self.chars.issuperset(text):
            return self._known(text)
        tokens: list[int] = []
        start = 0
        for k, char in enumerate(text):
            if char not in self.chars:
                if k > start:
                    tokens += self._known(text[start:k])
                tokens += [self.byte_ids[b] for b in char.encode()]
                start = k + 1
        return tokens + self._known(text[start:]) if start < len(text) else tokens

    def run(self, length: int) -> list[int]:
        """Tokens of so many space signs, as merging gives them."""
        if len(set(self.spaces.values())) > 1:
            sizes = self._merged_run(length)
        else:
            sizes = self._leftmost_run(length)
        return [self.ids[SPACE * size] for size in sizes]

    def _leftmost_run(self, length: int) -> list[int]:
        """Piece sizes of a run if all its pairs score alike: what lies left merges first.

        What is done so far can't merge; of what follows, all single, the leftmost pair is
        the last piece with one more, else the next two.
        """
        done: list[int] = []
        for _ in range(length):
            if done and SPACE * (done[-1] + 1) in self.spaces:
                done[-1] += 1
            else:
                done.append(1)
            while len(done) > 1 and SPACE * (done[-2] + done[-1]) in self.spaces:
                done[-2:] = [done[-2] + done[-1]]
        return done

    def _merged_run(self, length: int) -> list[int]:
        """Piece sizes of a run: the best pair first, of equal ones the leftmost, by a heap."""
        size, after = [1] * length, list(range(1, length + 1))
        before = list(range(-1, length))
        pairs: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < length:
                both = size[at] + size[after[at]]
                score = self.spaces.get(SPACE * both)
                if score is not None:
                    heapq.heappush(pairs, (-score, at, both))

        for at in range(length - 1):
            offer(at)
        while pairs:
            _, at, both = heapq.heappop(pairs)
            if not size[at] or after[at] >= length or size[at] + size[after[at]] != both:
                continue
            gone = after[at]
            size[at], size[gone] = both, 0
            after[at] = after[gone]
            if after[gone] < length:
                before[after[gone]] = at
            offer(at)
            offer(before[at])
        return [n for n in size if n]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers in native order."""
        if not text:
            return b""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if text[0] != " " and SPACE not in text and "  " not in text:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        out = []
        for spaces, word in _RUNS.findall(SPACE + text.replace(" ", SPACE)):
            if len(spaces) < 2:
                if spaces or word:
                    out.append(self.words[word])
                continue
            tokens = self.word(SPACE + word)
            if self.text.get(tokens[0]) == SPACE:
                tokens = self.run(len(spaces)) + tokens[1:]
            else:
                tokens = self.run(len(spaces) - 1) + tokens
            out.append(np.array(tokens, dtype=np.int32).tobytes())
        return b"".join(out)


class _Words(dict):
    """Encoded words, each with the space sign before it."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.encoder.word(SPACE + word), dtype=np.int32).tobytes()
        if len(word) < 64:
            self[word] = found
        return found


class Decoder:
    """Texts of token ids: a gather of piece bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        surface = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for i in vocabulary.control:
            surface[i] = b""
        surface[vocabulary.unknown] = " ⁇ ".encode()  # as the library writes it
        for b, i in enumerate(vocabulary.byte_ids):
            surface[i] = bytes([b])
        self.surface, self.bytes_of = surface, set(vocabulary.byte_ids)
        self.fronted = np.array([p.startswith(SPACE) for p in vocabulary.pieces])
        self.shown = np.array([len(s) > 0 for s in surface])
        self.length = np.array([len(s) for s in surface], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(surface), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of one text; the space of the dummy prefix goes."""
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = np.cumsum(length)
        where = np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1])
        out = self.data[where].tobytes()
        first = int(np.argmax(self.shown[ids]))
        if self.fronted[ids[first]]:
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            return self._repaired(ids)
        # a piece without text still ends a run of byte pieces
        return out if self.shown[ids].all() else self._repaired(ids)

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Byte pieces that form no character: one replacement character for each byte."""
        out, run = [], b""

        def flush(run: bytes) -> str:
            text, at = "", 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        text += run[at: at + n].decode()
                        at += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or at + n >= len(run):
                            text += "�"
                            at += 1
                            break
            return text

        for i in ids.tolist():
            if i in self.bytes_of:
                run += self.surface[i]
            else:
                out += [flush(run), self.surface[i].decode()]
                run = b""
        text = "".join([*out, flush(run)])
        first = ids[int(np.argmax(self.shown[ids]))]
        return (text[1:] if self.fronted[first] else text).encode()


_MADE: dict[tuple, Encoder | Decoder] = {}


def _tool(kind, shared) -> Encoder | Decoder:
    """Built once in each worker."""
    if (kind, shared.id) not in _MADE:
        _MADE.clear()
        _MADE[kind, shared.id] = kind(shared.value)
    return _MADE[kind, shared.id]


class _Shared:
    def __init__(self, df: DataFrame, vocabulary: Vocabulary) -> None:
        self.broadcast = df.sparkSession.sparkContext.broadcast(vocabulary)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
                     out_col: str = "ids") -> DataFrame:
    """The rows with the token ids of their whole texts; a null text has no ids.

    Works on about a megabyte of text at a time; rows, and only they, are independent.
    A column that is named like the new one is replaced.
    """
    shared = _Shared(docs, vocabulary)
    kept = [f for f in docs.schema.fields if f.name != out_col]
    schema = StructType([*kept, StructField(out_col, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tool(Encoder, shared)
        for batch in pieces(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            coded = [encoder.encode(t or "") for t in batch.column(at).to_pylist()]
            offsets = np.zeros(len(coded) + 1, dtype=np.int32)
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [ids],
                names=[f.name for f in kept] + [out_col])

    return docs.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids",
                     out_col: str = "decoded") -> DataFrame:
    """The rows with the texts of their token ids."""
    shared = _Shared(rows, vocabulary)
    kept = [f for f in rows.schema.fields if f.name != out_col]
    schema = StructType([*kept, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tool(Decoder, shared)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(part.schema.get_field_index(ids_col))
                bounds = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                texts = pa.array(
                    [decoder.decode(values[a:b]).decode()
                     for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(f.name)) for f in kept] + [texts],
                    names=[f.name for f in kept] + [out_col])

    return rows.mapInArrow(run, schema)
