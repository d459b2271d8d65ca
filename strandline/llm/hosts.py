"""Boilerplate of a host: long token strings that stand on several of its pages, by a distributed suffix array.

The token streams of all pages of a host are one text. Its suffixes are brought together by a hash of their first
``least`` tokens, since all that counts of their order is whether neighbours share so many; the sort is the shuffle, and of
each prefix only the least and the greatest page are kept, so a string on a third of all pages is combined before it
moves. Suffixes that can't be repeated are left out before: of every stretch of ``least`` tokens at least one
gram of half that length is sampled, the same one wherever the stretch stands, and only suffixes around grams on
several pages take part. Nothing is compared in pairs, and no host is held in one place.

What a repeated string covers is removed, on every page that has it; the unique runs are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.spans import gram_hashes
from strandline.operators.lineage import durable

#: Tokens that a repeated string has at least.
LEAST = 30

_TOKEN = re.compile(r"\w+|[^\w\s]")


def stream(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(where each token stands, its hash)."""
    at = [m.span() for m in _TOKEN.finditer(text)]
    return at, np.fromiter((xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in at), np.uint64, len(at))


def sampled(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost minimum of every ``width`` neighbours."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(values, width).argmin(1)
    return np.unique(least + np.arange(len(least)))


def unique_runs(df: DataFrame, *, key: str, text: str, page: str, host: Column | None = None, least: int = LEAST) -> DataFrame:
    """(key, kept, removed, removed_chars): each text without the strings of ``least`` tokens or more that another page of its host has, too.

    removed: array of (begin, end), the stretches of the text that such strings cover, in order. Revisions of one page
    aren't compared, nor are pages of different hosts (all are one where host is left out). Texts with fewer tokens are kept whole;
    rows with a null key, page, host or text give no row; a repeated row is returned as often; an empty table gives no rows.
    """
    if least < 2:
        raise ValueError("a repeated string has two tokens at least")
    gram = least // 2
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, page)}
    rows = df.select(F.col(key).alias("k"), F.col(page).alias("p"), (F.lit("") if host is None else host).cast("string").alias("h"), F.col(text).alias("t")).where("k IS NOT NULL AND p IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL")
    rows = rows.withColumn("row", F.xxhash64("k", "p", "h", "t"))
    once = rows.groupBy("row").agg(F.min(F.struct("h", "p", "t")).alias("r")).select("row", "r.*")
    identified = f"row long, h string, p {kinds[page]}, place int, hash long"

    def placed(part: pa.RecordBatch, taken: list[int], places: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        t = pa.array(taken, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[part.column(i).take(t) for i in range(3)], pa.array(np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64))],
            names=["row", "h", "p", "place", "hash"],
        )

    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, places, hashes = [], [], []
            for row, value in enumerate(part.column(3).to_pylist()):
                tokens = stream(value)[1]
                if len(tokens) >= least:
                    values = gram_hashes(tokens, gram)
                    where = sampled(values, least - gram + 1)
                    taken += [row] * len(where)
                    places.append(where)
                    hashes.append(values[where])
            yield placed(part, taken, places, hashes)

    def suffixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, places, hashes = [], [], []
            for row, (value, seeds) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                values = gram_hashes(stream(value)[1], least)
                around = np.unique(np.add.outer(np.array(seeds), np.arange(gram - least, 1)))
                around = around[(around >= 0) & (around < len(values))]
                taken += [row] * len(around)
                places.append(around)
                hashes.append(values[around])
            yield placed(part, taken, places, hashes)

    def repeated(found: DataFrame) -> DataFrame:
        """(row, places) of what stands on several pages of a host. It is read twice, so it is written once: narrow rows, no texts."""
        found = durable(found)
        several = found.groupBy("h", "hash").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("h", "hash")
        return found.join(several, ["h", "hash"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("places"))  # bounded by the text's length

    seeded = once.join(repeated(once.select("row", "h", "p", "t").mapInArrow(grams, identified)), "row").select("row", "h", "p", "t", "places")
    covered = repeated(seeded.mapInArrow(suffixes, identified))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for part in parts:
            kept, removed, sizes = [], [], []
            for value, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                spans = covered_spans(value, places or [], least)
                at, out = 0, []
                for a, b in spans:
                    out.append(value[at:a])
                    at = b
                kept.append("".join(out) + value[at:])
                removed.append([{"begin": a, "end": b} for a, b in spans])
                sizes.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(removed, stretches), pa.array(sizes, pa.int32())], names=["k", "kept", "removed", "removed_chars"])

    out = rows.select("row", "k", "t").join(covered, "row", "left").select("k", "t", "places")
    return out.mapInArrow(cut, f"k {kinds[key]}, kept string, removed array<struct<begin int, end int>>, removed_chars int").withColumnRenamed("k", key)


def covered_spans(text: str, places: list[int], least: int) -> list[tuple[int, int]]:
    """The stretches of a text that strings of ``least`` tokens from the given tokens on cover."""
    if not places:
        return []
    at, out = stream(text)[0], []
    for p in sorted(places):
        a, b = at[p][0], at[p + least - 1][1]
        # Strings that overlap or follow one another with nothing but white space between are one.
        if out and (a <= out[-1][1] or not text[out[-1][1] : a].strip()):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
