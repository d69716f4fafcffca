"""Encoding with a public byte-pair vocabulary, in time linear in the text.

Inside a pre-token the exact merges are found without merging: an Aho-Corasick automaton gives the
longest vocabulary entry starting at each byte; the encoder walks left to right, keeps an entry
only if it is compatible with the one before it (a pair is compatible if merging by rank would
leave exactly that boundary), falls back to shorter entries, and steps back where none fits,
marking the position dead so that none is visited twice. Compatibility is kept in a table.

Around it, texts are cut at single spaces, which the pre-token pattern always respects, and the
encodings of the distinct cuts are remembered as packed integers, so that a text is encoded by
joining them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct cuts remembered per task; beyond it the memory starts afresh.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in order of rank."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def split_table(vocabulary: list[bytes]) -> np.ndarray:
    """For each entry the two entries whose merge made it; single bytes are their own halves.

    An entry's halves are what merging by rank leaves of its bytes just before the last merge.
    """
    rank = {t: i for i, t in enumerate(vocabulary)}
    halves = np.empty((len(vocabulary), 2), np.int32)
    for i, token in enumerate(vocabulary):
        if len(token) == 1:
            halves[i] = i
            continue
        parts = [token[j : j + 1] for j in range(len(token))]
        while len(parts) > 2:
            best, at = None, -1
            for j in range(len(parts) - 1):
                r = rank.get(parts[j] + parts[j + 1])
                if r is not None and r < i and (best is None or r < best):
                    best, at = r, j
            if best is None:
                raise ValueError(f"entry {i} is not reachable by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        halves[i] = rank[parts[0]], rank[parts[1]]
    return halves


class Vocabulary:
    """Tables of the encoder, made once per process from the vocabulary and its split table."""

    def __init__(self, tokens: list[bytes], halves: np.ndarray) -> None:
        import ahocorasick

        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.left, self.right = halves[:, 0].tolist(), halves[:, 1].tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if self.sizes[i] > 1}
        by_bytes = {t: i for i, t in enumerate(tokens)}
        self.by_text = {t.decode("latin-1"): i for t, i in by_bytes.items()}
        self.shorter = [-1] * len(tokens)  # longest entry that is a proper prefix
        for i, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                if (j := by_bytes.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can end with ``a`` directly before ``b``."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # undo merges on either side of the boundary, latest first; a merge across it that would have come earlier breaks it
        bound = len(self.tokens)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            whole_a, whole_b = self.sizes[a] == 1, self.sizes[b] == 1
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                bound, a = a, self.right[a]
            else:
                # equal ranks merge left to right, so a merge across counts up to and including this one
                bound, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = piece.decode("latin-1")
        whole = self.by_text.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(text):
            start = end - size + 1
            if longest[start] < 0 or self.sizes[longest[start]] < size:
                longest[start] = token
        out: list[int] = []
        alive, at, token = [True] * (n + 1), 0, longest[0]
        sizes, shorter = self.sizes, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (alive[at + sizes[token]] and (last < 0 or self.compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = False
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return out


class Encoder:
    """Texts to ids packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import re

        import regex

        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        #: a space before white space, or white space before a space at the end: cuts at spaces would not be pre-token bounds
        self.uneven = re.compile(r" (?=\s)|\s $").search
        self.words: dict[str, bytes] = {}
        encoder = self

        class Cuts(dict):
            """Cut to packed ids; ``lead`` is the space it was cut at."""

            lead = ""

            def __missing__(self, cut: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                ids = self[cut] = encoder._packed(self.lead + cut)
                return ids

        self.first, self.rest = Cuts(), Cuts()
        self.rest.lead = " "

    def _packed(self, text: str) -> bytes:
        words, out = self.words, []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= REMEMBERED:
                    words.clear()
                ids = words[word] = np.array(self.v.encode_piece(word.encode()), "<i4").tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.uneven(text):
            return self._packed(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


@cache
def load(path: str) -> tuple[list[bytes], np.ndarray]:
    tokens = read_ranks(path)
    return tokens, split_table(tokens)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, tables: tuple[list[bytes], np.ndarray]) -> Encoder:
    """The process's encoder of a vocabulary; kept between tasks of one worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(*tables))
    return _ENCODERS[path]


class Decoder:
    """Ids back to text: one byte buffer of all entries and a table of offsets into it."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def __call__(self, ids: list[int] | np.ndarray) -> str:
        """All bytes of a text are gathered at once; an id outside the vocabulary is an error."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.offsets) - 1:
            raise ValueError("id outside the vocabulary")
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.buffer[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)].tobytes().decode("utf-8", errors="replace")


def _shared_tables(spark: SparkSession, name: str, folder: str):  # noqa: ANN202
    """Path and broadcast of the tables: a fixed vocabulary file, under 1 MB whatever the corpus."""
    path = f"{folder}/{name}.tiktoken"
    return path, spark.sparkContext.broadcast(load(path))


def encoded(documents: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids``: every row's text as ids, without special tokens; strings of special tokens are ordinary text.

    Null and empty texts give an empty list, blank texts are encoded; repeated rows are encoded
    each; other columns are ignored. Row-wise, so nothing is shuffled.
    """
    path, tables = _shared_tables(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path, tables.value)
        for batch in batches:
            packed = [encode(t.as_py()) for t in batch.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(p) >> 2 for p in packed]))).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def counted(documents: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens``: the number of ids of every row's text."""
    path, tables = _shared_tables(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path, tables.value)
        for batch in batches:
            counts = [len(encode(t.as_py())) >> 2 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long")


def decoded(rows: DataFrame, id_col: str, ids_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, text``: every row's ids as text; an empty list gives an empty text, null stays null.

    Bytes that are no whole character, as in a list cut within one, become replacement characters.
    """
    _, tables = _shared_tables(rows.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(tables.value[0])
        for batch in batches:
            texts = [decode(ids.values.to_numpy()) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
