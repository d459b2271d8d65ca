"""Exact byte-level BPE encoding with a public vocabulary, at corpus scale.

A text is split by the tokenizer's pattern into pretokens, whose encodings are
independent. A pretoken's bytes, mapped one to one to Latin-1 characters, run once
through an Aho-Corasick automaton of the vocabulary, which gives the tokens that
start at each byte. The encoder takes the longest token and steps back to a shorter one
wherever a token can't stand beside the one before it: two adjacent tokens are
compatible if merging their joined bytes gives just these two, and a sequence of which
all neighbours are compatible is the one that merging by rank gives. Compatibility and
encodings are memoised per worker, of pretokens and of what stands between two spaces.

Per-partition work, no shuffle; every text is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function here.
VOCABULARIES = os.environ.get("STRANDLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pretokens whose encoding a worker remembers; beyond, it forgets all and starts anew.
MEMO = 300_000
_SPACES = re.compile(r" \s").search

#: Longer ones, in characters, aren't remembered.
MEMO_CHARS = 64


class Encoder:
    """encode(pretoken) and tokens(text) of one vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.bytes_of = {rank: token for token, rank in self.rank.items()}
        self.split = regex.compile(PATTERN).findall
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.tokens = self.mapper(self.encode)

    def made_of(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens of which merging by rank makes a token of more than one byte at last."""
        known = self.halves.get(token)
        if known is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self.halves[token] = tuple(parts)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        Merges are undone backwards, the highest rank first (of equal ranks the right
        one, which was made later). A merge across the border that comes before the one
        just undone would have been made instead.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        rank, a, b, before = self.rank, self.bytes_of[left], self.bytes_of[right], 1 << 60
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                known = False
                break
            ra, rb = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if ra > rb:
                before, a = ra, self.made_of(a)[1]
            elif rb >= 0:
                before, b = rb + 1, self.made_of(b)[0]
            else:
                known = True
                break
        self.fits[left, right] = known
        return known

    def encode(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pretoken, by backtracking from longest matches."""
        raw = pretoken.encode()
        whole = self.rank.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, rank) in self.automaton.iter(raw.decode("latin-1")):
            starts[end - length + 1].append((length, rank))
        # Matches come by end, so each list is in rising length. dead: byte positions from which no rest fits.
        dead = bytearray(n + 1)
        at, choice, path = 0, [len(starts[0]) - 1], []
        while True:
            found = False
            i = choice[-1]
            while i >= 0:
                length, rank = starts[at][i]
                i -= 1
                if not dead[at + length] and (not path or self.compatible(path[-1][1], rank)):
                    found = True
                    break
            choice[-1] = i
            if found:
                path.append((length, rank))
                at += length
                if at == n:
                    return tuple(rank for _, rank in path)
                choice.append(len(starts[at]) - 1)
            else:
                # The valid encoding of a prefix is unique, so a position that failed with its prefix's last token fails for good.
                dead[at] = 1
                choice.pop()
                length, _ = path.pop()
                at -= length

    def mapper(self, make: Callable[[str], tuple]) -> Callable[[str], Iterator]:
        """A function that gives a text's pretokens' make(pretoken), one after the other.

        Where no space is followed by white space, what stands between two spaces splits
        into pretokens by itself, with the space before it; so that is remembered too.
        """
        of_word = _Memo(make)
        of_chunk = _Memo(lambda chunk: tuple(chain.from_iterable(map(of_word.__getitem__, self.split(" " + chunk)))))

        def each(text: str) -> Iterator:
            if _SPACES(text):
                return chain.from_iterable(map(of_word.__getitem__, self.split(text)))
            first, *rest = text.split(" ")
            return chain(chain.from_iterable(map(of_word.__getitem__, self.split(first))), chain.from_iterable(map(of_chunk.__getitem__, rest)))

        return each


class _Memo(dict):
    """Remembers what ``make`` gives for a pretoken."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=2)
def encoder(folder: str = VOCABULARIES, name: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary, built once per Python process."""
    return Encoder(os.path.join(folder, name))


def encode_column(df: DataFrame, *, key: str, text: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    Null and empty texts both give an empty array; strings that look like special
    tokens are ordinary text; repeated rows give repeated rows; a null key is kept;
    an empty table gives no rows; other columns are ignored.
    """
    kind = df.schema[key].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for part in parts:
            ids, ends = array("i"), [0]
            for value in part.column(1).to_pylist():
                if value:
                    ids.extend(own.tokens(value))
                ends.append(len(ids))
            flat = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)
