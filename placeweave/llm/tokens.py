"""Encoding a corpus with a public byte-level BPE, by dynamic programming over prefixes.

For each byte prefix of a pretoken exactly one token can come last in its encoding: the one
whose pair with the last token of the prefix before it survives merging unchanged. Storing that
token for each prefix gives the encoding by walking back from the end, makes an append touch
only the new bytes and an edit only the bytes until the stored tokens agree with the old ones.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: how this family of vocabularies splits a text before merging.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens whose ids are kept by a worker at once.
MEMORY = 1 << 18


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merging its lowest-ranked neighbours first, one at a time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Vocabulary:
    """Tokens by bytes, with what the prefix tables need: a trie of reversed tokens and the pairs that survive merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.trie: dict = {}
        for t, i in ranks.items():
            node = self.trie
            for b in reversed(t):
                node = node.setdefault(b, {})
            node[-1] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def stands(self, last: int, new: int) -> bool:
        """Whether ``new`` may follow ``last``; -1 is the start of a pretoken."""
        if last < 0:
            known = self.alone.get(new)
            if known is None:
                known = self.alone[new] = merge_pairs(self.token[new], self.ranks) == [new]
            return known
        known = self.pairs.get((last, new))
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.stands(-1, new) and merge_pairs(self.token[last] + self.token[new], self.ranks) == [last, new]
            self.pairs[last, new] = known
        return known


class PrefixTable:
    """The unique valid last token of each byte prefix of one pretoken."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _fill(self, end: int) -> int:
        v, piece, last, node = self.vocabulary, self.piece, self.last, self.vocabulary.trie
        options = []
        for start in range(end - 1, -1, -1):
            node = node.get(piece[start])
            if node is None:
                break
            if -1 in node:
                options.append((start, node[-1]))
        for start, token in reversed(options):
            if v.stands(last[start], token):
                return token
        raise ValueError("a byte has no token")

    def append(self, more: bytes) -> None:
        """Extend the piece; earlier entries stay as they are."""
        begin = len(self.piece)
        self.piece += more
        for end in range(begin + 1, len(self.piece) + 1):
            self.last.append(self._fill(end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start..stop; gives the number of entries computed anew.

        Entries depend on those of the longest token's length before them, so once that many in a row equal the old ones behind the edit, the rest are old.
        """
        old, tail, shift = self.last, len(self.piece) - stop, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, same, done = old[: start + 1], 0, 0
        for end in range(start + 1, len(self.piece) + 1):
            if same >= self.vocabulary.longest:
                self.last.extend(old[end - shift :])
                break
            self.last.append(self._fill(end))
            done += 1
            behind = end - (len(self.piece) - tail)
            same = same + 1 if behind > 0 and old[end - shift] == self.last[end] else 0
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.token[self.last[end]])
        return out[::-1]


class Encoder:
    """Whole texts: pretokens by pattern, then the prefix table of each pretoken that isn't known yet."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PRETOKEN):
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def _ids(self, piece: str) -> list[int]:
        ids = PrefixTable(self.vocabulary, piece.encode("utf-8", "replace")).ids()
        if len(piece) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            ids = known.get(piece)
            out += ids if ids is not None else self._ids(piece)
        return out

    def extend(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more, given those of text: all but the last two pretokens stay."""
        pieces = self.split(text)
        tail = "".join(pieces[-2:])
        drop = len(self.encode(tail)) if tail else 0
        return ids[: len(ids) - drop] + self.encode(tail + more)


@functools.lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Encoder:
    """The encoder of a vocabulary of ranks in ``folder`` (or of the installed public files), once per process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path) and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    return Encoder(Vocabulary(ranks))


def encode_column(df: DataFrame, text: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with ``out``, the token ids of ``text`` as array<int>; empty and null texts give an empty list.

    Special tokens aren't recognised: their strings are ordinary text. Blank texts are encoded like others.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(name, folder).encode
        for batch in batches:
            yield pd.Series([encode(t) for t in batch], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def count_column(df: DataFrame, text: str, out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with ``out``, the number of tokens of ``text``: 0 for empty and null texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(name, folder).encode
        for batch in batches:
            yield pd.Series([len(encode(t)) for t in batch], dtype="int32")

    return df.withColumn(out, count(F.col(text)))


def corpus_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every row of documents."""
    return encode_column(spread(documents.select("doc_id", "text"), "doc_id"), "text", name=name, folder=folder).select("doc_id", "ids")
