"""Splitting oversized texts at natural boundaries, sizes in tokens of a public tokenizer.

Each boundary between pretokens has a strength (paragraph, line, sentence, clause,
space, none). A sparse table over the strengths answers in constant time where the
strongest boundary of a window lies; of equal ones the rightmost counts. Each piece is
cut at the strongest boundary of its permissible lengths, and the next one begins at
the strongest boundary near ``overlap`` tokens before that cut.

Texts that can't be oversized (no more bytes than the limit) never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import VOCABULARIES, VOCABULARY, encoder

LIMIT = 1_024
OVERLAP = 64
#: No less, so that a piece can always be cut within it: a character has four tokens at most.
LEAST_LIMIT = 16
#: A piece is cut at no less than this share of the limit, and the overlap kept within these shares of its size.
LEAST_PIECE = 0.5
OVERLAP_RANGE = (0.75, 1.25)

# Strengths of boundaries.
INSIDE, NONE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3, 4, 5

# Classes of pretokens, in the low bits of what is remembered of each.
_WORD, _SENTENCE_END, _CLAUSE_END, _BLANK, _BREAK, _BREAKS = range(6)
_SPACED = 8
_ENDS_SENTENCE = regex.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_ENDS_CLAUSE = regex.compile(r"[,;:–—、，；：][\"'”’»)\]]*$")


class SparseTable:
    """Position of the maximum in any range in constant time; the rightmost of equal ones."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # One key for value and position, so that a plain maximum breaks ties rightward.
        self.levels = [values.astype(np.int64) * (n + 1) + np.arange(n)]
        self.base = n + 1
        width = 1
        while 2 * width <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: n - 2 * width + 1], last[width : n - width + 1]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Rightmost position of the largest value in [lo, hi]."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi - (1 << level) + 1]) % self.base)


class Splitter:
    def __init__(self, folder: str, name: str, limit: int, overlap: int):
        if not 0 <= overlap < limit // 2 or limit < LEAST_LIMIT:
            raise ValueError(f"the limit is {LEAST_LIMIT} tokens at least, and the overlap less than half of it")
        self.encoder, self.limit, self.overlap = encoder(folder, name), limit, overlap
        self.packed = self.encoder.mapper(self.features)

    def features(self, word: str) -> tuple[int]:
        """Tokens, characters and class of a pretoken in one integer."""
        if word.isspace():
            breaks = word.count("\n") + word.count("\r") - word.count("\r\n")
            kind = _BLANK if not breaks else _BREAK if breaks == 1 else _BREAKS
        else:
            kind = _SENTENCE_END if _ENDS_SENTENCE.search(word) else _CLAUSE_END if _ENDS_CLAUSE.search(word) else _WORD
            kind |= _SPACED * (word[0] == " ")
        return (len(self.encoder.encode(word)) << 40 | len(word) << 8 | kind,)

    def items(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens and characters of each item, and the strength of the boundary after it."""
        packed = np.fromiter(self.packed(text), np.int64)
        tokens, chars, kind = packed >> 40, packed >> 8 & 0xFFFFFFFF, packed & 0xFF
        strength = np.zeros(len(packed), np.int64)
        if len(packed) > 1:
            a, b = kind[:-1], kind[1:]
            what, spaced, blank = a & 7, b >= _SPACED, (b >= _BLANK) & (b < _SPACED)
            s = np.where(spaced, SPACE, NONE)
            s = np.where((what == _CLAUSE_END) & spaced, CLAUSE, s)
            s = np.where((what == _SENTENCE_END) & spaced, SENTENCE, s)
            s = np.where((a == _BLANK) & ~blank, SPACE, s)
            s = np.where((a == _BREAK) & ~blank, LINE, s)
            again = np.concatenate([[False], ((a == _BREAK) | (a == _BREAKS))[:-1]])
            s = np.where(((a == _BREAKS) | ((a == _BREAK) & again)) & ~blank, PARAGRAPH, s)
            strength[:-1] = np.where(blank, NONE, s)
        most = max(1, min(self.overlap or self.limit, self.limit) // 4)
        if (tokens > most).any():
            tokens, chars, strength = self.broken(self.encoder.split(text), tokens, chars, strength, most)
        return tokens, chars, strength

    def broken(self, words, tokens, chars, strength, most):
        """Items with pretokens of more than ``most`` tokens broken up, where tokens end with a character."""
        out: tuple[list, list, list] = ([], [], [])
        for word, t, c, s in zip(words, tokens.tolist(), chars.tolist(), strength.tolist()):
            if t <= most:
                parts = [(t, c, s)]
            else:
                parts, n, raw, done = [], 0, b"", 0
                for rank in self.encoder.encode(word):
                    n, raw = n + 1, raw + self.encoder.bytes_of[rank]
                    try:
                        length = len(raw.decode())
                    except UnicodeDecodeError:
                        continue
                    if n >= most // 2 or done + length == c:
                        parts.append((n, length, INSIDE))
                        n, raw, done = 0, b"", done + length
                parts[-1] = (*parts[-1][:2], s)
            for column, value in zip(out, zip(*parts)):
                column.extend(value)
        return tuple(np.array(x, np.int64) for x in out)

    def size(self, text: str, begin: int, end: int, counted: int) -> int:
        """Tokens of text[begin:end]: as counted, but for white space at its end, which the pattern takes as one there."""
        piece_end = text[max(begin, end - 64) : end]
        run = len(piece_end) - len(piece_end.rstrip())
        if run < 2 or end == len(text):
            return counted
        return sum(1 for _ in self.encoder.tokens(text[begin:end]))

    def pieces(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, tokens) of each piece, in characters; one piece if the text is within the limit."""
        tokens, chars, strength = self.items(text)
        t, c = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(chars)])
        total, n = int(t[-1]), len(tokens)
        if total <= self.limit:
            return [(0, len(text), total)]
        table, out, i = SparseTable(strength), [], 0
        while True:
            if total - t[i] <= self.limit:
                out.append((int(c[i]), len(text), int(total - t[i])))
                return out
            limit = self.limit
            while True:
                # The last item of a piece is one of lo..hi; the first piece length is at least one item.
                hi = int(np.searchsorted(t, t[i] + limit, "right")) - 2
                lo = max(i, int(np.searchsorted(t, t[i] + int(limit * LEAST_PIECE), "left")) - 1)
                j = table.argmax(max(i, min(lo, hi)), hi) if hi > i else i
                size = self.size(text, int(c[i]), int(c[j + 1]), int(t[j + 1] - t[i]))
                if size <= self.limit:
                    break
                if j == i:
                    raise ValueError("a piece of one item is over the limit")
                limit = max(1, limit - (size - self.limit))
            out.append((int(c[i]), int(c[j + 1]), size))
            back = i + 1
            if self.overlap:
                first = int(np.searchsorted(t, t[j + 1] - int(self.overlap * OVERLAP_RANGE[1]), "left"))
                last = int(np.searchsorted(t, t[j + 1] - int(self.overlap * OVERLAP_RANGE[0]), "right")) - 1
                first = max(first, i + 1)
                # Item k begins where the boundary after item k - 1 is.
                back = table.argmax(first - 1, last - 1) + 1 if last >= first else min(first, j + 1)
            else:
                back = j + 1
            i = max(back, i + 1)


@lru_cache(maxsize=2)
def splitter(folder: str, name: str, limit: int, overlap: int) -> Splitter:
    """The worker's splitter, built once per Python process."""
    return Splitter(folder, name, limit, overlap)


def split_oversized(
    df: DataFrame, *, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, folder: str = VOCABULARIES, name: str = VOCABULARY
) -> DataFrame:
    """(key, piece_no, begin, end, n_tokens[, piece]) of every text of more than ``limit`` tokens.

    piece_no counts from 1; begin and end are character offsets; piece is text[begin:end],
    at most ``limit`` tokens; the pieces cover the text, and each after the first repeats about ``overlap``
    tokens. Texts within the limit, null and empty ones give no row. A stretch without
    any boundary is cut between characters. A repeated row gives its pieces again;
    other columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = ["key", "piece_no", "begin", "end", "n_tokens"] + ["piece"] * with_text

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(folder, name, limit, overlap)
        for part in parts:
            taken, rows, texts = [], [], []
            for row, value in enumerate(part.column(1).to_pylist()):
                found = own.pieces(value)
                if len(found) > 1:
                    taken.extend([row] * len(found))
                    rows.extend((k, *x) for k, x in enumerate(found, 1))
                    if with_text:
                        texts.extend(value[a:b] for a, b, _ in found)
            numbers = np.array(rows, np.int32).reshape(-1, 4)
            arrays = [part.column(0).take(pa.array(taken, pa.int64())), *[pa.array(numbers[:, i]) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=columns)

    rows = df.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, piece_no int, begin int, end int, n_tokens int" + ", piece string" * with_text
    return rows.mapInArrow(batches, schema).withColumnRenamed("key", key)
