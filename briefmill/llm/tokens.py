"""Encoding of a corpus with a public byte-level BPE tokenizer, in linear time.

The text is split by the tokenizer's pattern. A piece's bytes are mapped to Latin-1, so that pyahocorasick, which works
on text, finds all vocabulary entries in them in one pass. From the longest match at each place the encoder goes on,
takes a token only if it is compatible with the one before (the merges of the two tokens' joined bytes end in just these
two; memoised), else tries the next shorter token, else steps back and never tries that place again. An encoding of
which all neighbours are compatible is the one that the merges give, so the ids are exactly the tokenizer's, while each
place of a piece is left at most once. Pieces recur, so a bounded table keeps what they gave.

Defined cases: a null and an empty text have an empty list of ids; strings of special tokens are ordinary text; text of
any length is encoded whole; the vocabulary's path is a parameter and its file must be readable on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import spread

#: Where the public vocabularies lie, unless another path is given.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: white space of the tokenizer's pattern (the Unicode property White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the tokenizer's pattern, with white space written out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces kept with their ids, and neighbours with their compatibility, at most.
KEPT = 300_000
#: Longer pieces are not kept.
KEPT_BYTES = 64


class Encoder:
    """Byte-level BPE by the ranks of a tiktoken file."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.finder = ahocorasick.Automaton()
        for token in self.rank:
            self.finder.add_word(token, len(token))
        self.finder.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves, quadratic; for the few bytes of two neighbouring tokens."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            fit = self.fits[a, b] = self.merged(a + b) == [a, b]
        return fit

    def shorter(self, token: str) -> str:
        """The next shorter vocabulary entry that ``token`` begins with; empty if it is a single byte."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.rank:
                return token[:n]
        return ""

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece, given as Latin-1 text of its bytes."""
        if (whole := self.rank.get(text)) is not None:
            return (whole,)
        longest = [1] * len(text)
        for end, n in self.finder.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        taken: list[str] = []
        dead = bytearray(len(text) + 1)
        at, token = 0, text[: longest[0]]
        while True:
            while token and (dead[at + len(token)] or (taken and not self.compatible(taken[-1], token))):
                token = self.shorter(token)
            if token:
                taken.append(token)
                at += len(token)
                if at == len(text):
                    return tuple(self.rank[t] for t in taken)
                token = text[at : at + longest[at]]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= len(token)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces
        for word in self.split(text):
            made = pieces.get(word)
            if made is None:
                made = self.piece(word.encode("utf-8").decode("latin-1"))
                if len(word) <= KEPT_BYTES:
                    if len(pieces) >= KEPT:
                        pieces.clear()
                    pieces[word] = made
            ids.extend(made)
        return ids

    def count(self, text: str) -> int:
        pieces, n = self.pieces, 0
        for word in self.split(text):
            made = pieces.get(word)
            n += len(made) if made is not None else len(self.encode(word))
        return n


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the ids of each row's text, one row for each row of ``df``."""
    slim = spread(df.select(F.col(key).alias("__key"), F.col(text).alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # few texts at once, however long they are
                part = batch.slice(start, 500)
                ids = pa.array([encode(t) if t else [] for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["__key", "ids"])

    return slim.mapInArrow(run, f"__key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("__key", key)


def token_counts(df: DataFrame, keep: list[str], text: str, name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``, 0 for null and empty texts."""
    slim = spread(df.select(*keep, F.col(text).alias("__text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).count
        for batch in batches:
            n = pa.array([count(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], name])

    return slim.mapInArrow(run, f"{kinds}, `{name}` bigint")
