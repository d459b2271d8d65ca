"""Evaluation texts leaking into training text, by pigeonhole edit matching.

A leak is a window of ``min_words`` consecutive words of an item that a document
contains with at most ``max_errors`` word edits. Each item is cut into blocks so short
that any such window holds error-budget-plus-one whole blocks; with that many errors
at most, one of them must be intact. An Aho-Corasick automaton of all blocks finds the
intact ones in each document, and Myers' bit-parallel distance, words as symbols, verifies
the windows around each hit.

The items are a stated query set. Up to ``MOST_IN_MEMORY`` of them, which is checked, are broadcast in blocks of
``items_per_block``, with one pass over the documents for each; documents are never shuffled, and a worker
process builds each block's automaton once. Beyond that, nothing is collected: pieces of items and all windows of that many
document words meet by their hashes in a join, and the same distance verifies what met.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 15
#: Items that one automaton holds, some hundred bytes each, and items that are broadcast at most.
ITEMS_PER_BLOCK, MOST_IN_MEMORY = 20_000, 100_000

_WORDS = re.compile(r"[^\W_]+").findall


def _format_characters() -> re.Pattern:
    """A class of all characters of category Cf."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


_CF: re.Pattern | None = None


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, case aside; format characters count as absent."""
    global _CF
    if not text:
        return []
    if not text.isascii():
        _CF = _CF or _format_characters()
        text = _CF.sub("", text)
    return _WORDS(text.casefold())


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """The least edit distance of the whole pattern to a stretch of text ending at each position, bit-parallel."""
    peq: dict[str, int] = {}
    for i, word in enumerate(pattern):
        peq[word] = peq.get(word, 0) | 1 << i
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, out = mask, 0, m, []
    for word in text:
        eq = peq.get(word, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & mask, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~((eq | minus) | up) & mask, up & (eq | minus)
        out.append(score)
    return out


class Matcher:
    """The pieces of a block of items in an automaton."""

    def __init__(self, block: list[tuple], min_words: int, max_errors: int):
        self.block, self.min_words, self.max_errors = block, min_words, max_errors
        self.piece = piece_words(min_words, max_errors)
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(block):
            for a in pieces(words, self.piece):
                where.setdefault(" " + " ".join(words[a : a + self.piece]) + " ", []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for key, places in where.items():
            self.automaton.add_word(key, (len(key), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def leaks(self, text: str) -> list[tuple]:
        """(item, errors, at_word) of each item that leaked into a text."""
        words = words_of(text)
        if self.empty or len(words) < self.min_words - self.max_errors:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        begins: list[int] = []
        for end, (length, places) in self.automaton.iter(" " + " ".join(words) + " "):
            begins = begins or list(accumulate((len(w) + 1 for w in words), initial=0))
            at = bisect_left(begins, end - length + 1)
            for n, a in places:
                hits.setdefault(n, []).append((a, at))
        found = ((n, verified(words, self.block[n][1], at, self.min_words, self.max_errors)) for n, at in hits.items())
        return [(self.block[n][0], *best) for n, best in found if best]


def piece_words(min_words: int, max_errors: int) -> int:
    """Words of a piece: any window of min_words holds max_errors + 1 whole ones."""
    piece = (min_words + 1) // (max_errors + 2)
    if piece < 1:
        raise ValueError("the error budget is too large for the window")
    return piece


def pieces(words: list[str], piece: int) -> range:
    """Where an item's pieces begin."""
    return range(0, len(words) - piece + 1, piece)


def verified(words: list[str], item: list[str], hits: list[tuple[int, int]], min_words: int, max_errors: int) -> tuple[int, int] | None:
    """(errors, last word) of the best window of an item around its pieces' hits (place in the item, place in the document)."""
    best, piece = None, piece_words(min_words, max_errors)
    tried: set[tuple[int, int]] = set()
    for a, at in hits:
        # Every window of the item that holds the intact piece, against the stretch of the document where it would stand.
        for s in range(max(0, a + piece - min_words), min(a, len(item) - min_words) + 1):
            begin = at - (a - s) - max_errors
            if (s, begin) in tried:
                continue
            tried.add((s, begin))
            stretch = words[max(0, begin) : begin + min_words + 2 * max_errors]
            for k, d in enumerate(myers(item[s : s + min_words], stretch)):
                if d <= max_errors and (best is None or (d, max(0, begin) + k) < best):
                    best = d, max(0, begin) + k
    return best


_MATCHERS: dict[tuple, Matcher] = {}


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    min_words: int = MIN_WORDS,
    max_errors: int = 0,
    items_per_block: int = ITEMS_PER_BLOCK,
    most_in_memory: int = MOST_IN_MEMORY,
) -> DataFrame:
    """(doc_id, item_id, errors, at_word): each document with each item that leaked into it.

    errors is the least number of word edits of a leaked window, at_word the document
    word (from 0) at which such a window first ends. Null and empty texts, and items of fewer than
    ``min_words`` words, match nothing; items repeated under other ids are all reported; a
    repeated document row gives its rows again; empty tables give no rows; other columns are
    ignored.
    """
    piece_words(min_words, max_errors)
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = documents.where(F.octet_length(doc_text) > 0).select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    some = wanted.limit(most_in_memory + 1).collect()
    if len(some) > most_in_memory:
        out = _joined(source, wanted, kinds, min_words, max_errors)
    else:
        rows = sorted(((r[0], w) for r in some if len(w := words_of(r[1])) >= min_words), key=lambda x: (x[0], x[1]))
        blocks = [rows[i : i + items_per_block] for i in range(0, len(rows), items_per_block)] or [[]]
        out = reduce(DataFrame.unionAll, [_matched(source, b, kinds, min_words, max_errors) for b in blocks])
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "errors", "at_word")


def _matched(source: DataFrame, block: list[tuple], kinds: tuple[str, str], min_words: int, max_errors: int) -> DataFrame:
    """Leaks of a block of items, by one pass over the documents."""
    sent = source.sparkSession.sparkContext.broadcast(block)
    name = (uuid.uuid4().hex, min_words, max_errors)
    item_type = pa.int64() if kinds[1] == "bigint" else None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MATCHERS:
            _MATCHERS.clear()  # one block is held at a time
            _MATCHERS[name] = Matcher(sent.value, min_words, max_errors)
        matcher = _MATCHERS[name]
        for part in parts:
            taken, found = [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                for leak in matcher.leaks(text):
                    taken.append(row)
                    found.append(leak)
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(taken, pa.int64())), pa.array(columns[0], item_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                names=["doc", "item", "errors", "at_word"],
            )

    return source.mapInArrow(batches, f"doc {kinds[0]}, item {kinds[1]}, errors int, at_word int")


def _joined(source: DataFrame, wanted: DataFrame, kinds: tuple[str, str], min_words: int, max_errors: int) -> DataFrame:
    """Leaks of any number of items: windows of documents meet pieces of items by hash, in a join."""
    piece = piece_words(min_words, max_errors)

    def hashes(step: int, least: int):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                taken, places, keys = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    words = words_of(text)
                    if len(words) >= least:
                        at = range(0, len(words) - piece + 1, step)
                        taken += [row] * len(at)
                        places += at
                        keys += [xxhash.xxh3_64_intdigest(" ".join(words[a : a + piece]).encode("utf-8", "surrogatepass")) for a in at]
                rows = pa.array(taken, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(places, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["row", "place", "hash"])

        return batches

    rows = source.withColumn("row", F.xxhash64("doc", "text"))
    once = rows.groupBy("row", "doc", "text").agg(F.count(F.lit(1)).alias("n"))
    left = once.select("row", "text").mapInArrow(hashes(1, min_words - max_errors), "row long, place int, hash long")
    # Two texts under one id are two items.
    wanted = wanted.withColumn("own", F.xxhash64("item", "text"))
    right = wanted.select("own", "text").mapInArrow(hashes(piece, min_words), "row long, place int, hash long").select(F.col("row").alias("own"), F.col("place").alias("a"), "hash")
    hits = left.join(right, "hash").groupBy("row", "own").agg(F.collect_set(F.struct("a", "place")).alias("hits"))  # bounded by the lengths of the two texts
    pairs = hits.join(once, "row").join(wanted.withColumnRenamed("text", "wanted"), "own").select("doc", "item", "text", "wanted", "hits", "n")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, found = [], []
            texts, wanted_texts, all_hits, many = (part.column(i).to_pylist() for i in (2, 3, 4, 5))
            for row, (text, own, hits, n) in enumerate(zip(texts, wanted_texts, all_hits, many)):
                best = verified(words_of(text), words_of(own), sorted((h["a"], h["place"]) for h in hits), min_words, max_errors)
                if best:
                    taken += [row] * n
                    found += [best] * n
            rows = pa.array(taken, pa.int64())
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *[pa.array(c, pa.int32()) for c in columns]], names=["doc", "item", "errors", "at_word"])

    return pairs.mapInArrow(verify, f"doc {kinds[0]}, item {kinds[1]}, errors int, at_word int")
