"""Long exact spans shared between records, by compact windows.

Tokens are the overlapping character grams of a text. The Cartesian tree over the
tokens' hashes, followed down while its ranges hold at least ``T`` tokens, gives the
compact windows (lo, c, hi): every stretch of T tokens lies in exactly one window such that
its least hash is at c. Two texts that share a span of T tokens have, for each
hash function, windows of one signature at one shift whose intervals overlap in the
span. So windows are joined by signature, the intervals of each pair and shift are met for
every hash function, and only pairs that meet for all of them are verified
character by character. A text of n tokens has about 2n/T windows.

With grams of half the span's length, equal signatures mean that at least that half
is shared, so set phrases make no large groups. Exact copies are one class with one
representative; links are found between representatives, and membership is a
table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.rows import once

MIN_CHARS = 160
HASHES = 2

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_BASE = np.uint64(0x100000001B3 * 2 + 1)


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``gram`` code points, by doubling: log(gram) passes."""
    have, width = None, 0
    single, power = points.astype(np.uint64) + np.uint64(1), _BASE
    done_power = np.uint64(1)
    bits, rest = single, gram
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if have is None:
                    have, width, done_power = bits, 1 << (gram.bit_length() - rest.bit_length()), power
                else:
                    step = 1 << (gram.bit_length() - rest.bit_length())
                    n = len(have) - step
                    have = have[:n] * power + bits[width : width + n]
                    width += step
            rest >>= 1
            if rest:
                step = 1 << (gram.bit_length() - rest.bit_length() - 1)
                bits = bits[:-step] * power + bits[step:]
                power = power * power
    return have


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """One of a family of bijections of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (values ^ np.uint64(_MIX[seed % 4] * (seed + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def window_runs(values: np.ndarray, least: int, gram: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(lo, c, hi, step, count), hi exclusive: the windows (lo + k step, c + k step, hi), k < count, of every node of the Cartesian tree whose range holds ``least`` tokens or more; leftmost of equal minima.

    Equal tokens at most half a gram apart lie in a periodic stretch of the text, and their distance is the
    least period of the gram: the same in every text. Their windows are one row with a count, so a text
    of one repeated sign doesn't give as many as it has signs, and none is left out. Single windows have step 0.
    """
    out, todo = [], [(0, len(values))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        part = values[lo:hi]
        places = (lo + np.flatnonzero(part == part.min())).tolist()
        begin, before = lo, 0
        for k, c in enumerate(places):
            gap = c - places[k - 1] if k else 0
            if hi - begin < least:
                break
            if gap == before and 0 < gap <= gram // 2:
                first = out[-1]
                out[-1] = (*first[:3], gap, first[4] + 1)
            else:
                out.append((begin, c, hi, 0, 1))
            if c - begin >= least:
                todo.append((begin, c))
            begin, before = c + 1, gap
        if hi - begin >= least:
            todo.append((begin, hi))
    return out


def compact_windows(values: np.ndarray, least: int, gram: int = 1) -> list[tuple[int, int, int]]:
    """(lo, c, hi), hi exclusive: the first window of each of ``window_runs``; with grams of one token, every window."""
    return [run[:3] for run in window_runs(values, least, gram)]


def common_runs(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """(begin in a, length) of each maximal run of a[i] == b[i + shift] of at least ``least``."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo < least:
        return []
    edges = np.flatnonzero(np.concatenate([[True], a[lo:hi] != b[lo + shift : hi + shift], [True]]))
    lengths = np.diff(edges) - 1
    return [(lo + int(edges[k]), int(lengths[k])) for k in np.flatnonzero(lengths >= least)]


def text_classes(df: DataFrame, *, key: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rep, text) of each different text of at least min_chars, and (id, rep) of every record that has it; rep is the least id.

    Texts move once, to where their record is; classes are made of digests alone.
    """
    rows = once(df.where(F.col(text).isNotNull()), key, {"text": F.col(text)}).where(F.char_length("text") >= min_chars).select(F.col(key).alias("id"), "text")
    keyed = rows.select("id", F.sha2("text", 256).alias("digest"))
    members = keyed.join(keyed.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")
    reps = rows.join(members.where("id = rep").select("id"), "id").select(F.col("id").alias("rep"), "text")
    return reps, members


def shared_spans(reps: DataFrame, *, min_chars: int = MIN_CHARS, hashes: int = HASHES) -> DataFrame:
    """(rep_a, rep_b, begin_a, begin_b, n_chars), rep_a < rep_b: spans of at least min_chars that two different texts share.

    reps: (rep string, text), all texts different. One row per maximal common run of each
    pair and shift. Texts shorter than min_chars give nothing; an empty table gives no rows.
    """
    gram = max(1, min_chars // 2)
    least = min_chars - gram + 1

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, rows, keys = [], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                points = codes(text)
                if len(points) < min_chars:
                    continue
                base = gram_hashes(points, gram)
                for h in range(hashes):
                    values = mixed(base, h)
                    for run in window_runs(values, least, gram):
                        taken.append(row)
                        rows.append((h, *run))
                        keys.append(values[run[1]])
            table = np.array(rows, np.int32).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(taken, pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64)), *[pa.array(table[:, i]) for i in range(6)]],
                names=["rep", "signature", "h", "lo", "c", "hi", "step", "count"],
            )

    w = reps.select("rep", "text").mapInArrow(windows, "rep string, signature long, h int, lo int, c int, hi int, step int, count int")
    a, b = w.alias("a"), w.alias("b")
    shift = F.col("b.c") - F.col("a.c")
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.rep") < F.col("b.rep"))).select(
        F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"), shift.alias("shift"), F.col("a.h").alias("h"), F.greatest("a.step", "b.step", F.lit(1)).alias("step"),
        (F.col("a.count") - 1).alias("more_a"), (F.col("b.count") - 1).alias("more_b"),
        (F.col("a.hi") - F.greatest(F.col("a.lo"), F.col("b.lo") - shift) - least).alias("spare_a"), (F.col("b.hi") - shift - F.greatest(F.col("a.lo"), F.col("b.lo") - shift) - least).alias("spare_b"),
    )
    # Window k of a run with window l of another has shift + (l - k) steps; of those of one shift, the ones with k or l 0 meet longest, and leave spare_a - k steps and spare_b - l steps over.
    met = met.where((F.col("spare_a") >= 0) & (F.col("spare_b") >= 0))
    steps = F.sequence(-F.least("more_a", F.floor(F.col("spare_a") / F.col("step")).cast("int")), F.least("more_b", F.floor(F.col("spare_b") / F.col("step")).cast("int")))
    met = met.select("rep_a", "rep_b", "h", "shift", "step", F.explode(steps).alias("k")).select("rep_a", "rep_b", "h", (F.col("shift") + F.col("k") * F.col("step")).alias("shift"))
    # A periodic stretch meets at many shifts: they are one row, and the texts come to each pair once.
    candidates = met.groupBy("rep_a", "rep_b").agg(*[F.collect_set(F.when(F.col("h") == h, F.col("shift"))).alias(f"h{h}") for h in range(hashes)])
    candidates = candidates.select("rep_a", "rep_b", reduce(F.array_intersect, [F.col(f"h{h}") for h in range(hashes)]).alias("shifts")).where(F.size("shifts") > 0)
    with_texts = candidates.join(reps.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(
        reps.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b"
    ).select("rep_a", "rep_b", "shifts", "text_a", "text_b")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shifts, texts_a, texts_b = (part.column(i).to_pylist() for i in (2, 3, 4))
            kept = []
            for row, (several, x, y) in enumerate(zip(shifts, texts_a, texts_b)):
                x, y = codes(x), codes(y)
                for s in several:
                    kept.extend((row, begin, begin + s, length) for begin, length in common_runs(x, y, s, min_chars))
            table = np.array(kept, np.int64).reshape(-1, 4)
            rows = pa.array(table[:, 0])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), *[pa.array(table[:, i].astype(np.int32)) for i in (1, 2, 3)]],
                names=["rep_a", "rep_b", "begin_a", "begin_b", "n_chars"],
            )

    return with_texts.mapInArrow(verify, "rep_a string, rep_b string, begin_a int, begin_b int, n_chars int")


def linked_records(spans: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records that share a span, copies of one text included."""
    links = spans.select("rep_a", "rep_b").distinct()
    across = links.join(members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a").join(
        members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b"
    ).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    same = members.alias("m").join(members.alias("n"), (F.col("m.rep") == F.col("n.rep")) & (F.col("m.id") < F.col("n.id"))).select(
        F.col("m.id").alias("id_a"), F.col("n.id").alias("id_b")
    )
    return across.unionByName(same)


def shared_share(reps: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links, shared_chars, shared_share): one row per record of at least the span's length.

    class_id is the representative of the record's text, n_copies how many records have it,
    n_links how many different other texts it shares a span with, shared_chars how many of its
    characters lie in spans shared with another record (all, if there is a copy).
    """
    each = spans.select(F.explode(F.array(
        F.struct(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other"), F.col("begin_a").alias("lo"), (F.col("begin_a") + F.col("n_chars")).alias("hi")),
        F.struct(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other"), F.col("begin_b").alias("lo"), (F.col("begin_b") + F.col("n_chars")).alias("hi")),
    )).alias("s")).select("s.*")
    # Union of intervals by a fold over them in order, after equal ones are one; their number is bounded by the text's length squared, not by the links.
    merged = each.select("rep", "lo", "hi").distinct().groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")).select(
        "rep",
        F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["hi"]).alias("to")),
        )["n"].alias("n"),
    )
    linked = each.select("rep", "other").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    per_text = (
        reps.select("rep", F.char_length("text").alias("n_chars")).join(copies, "rep").join(merged, "rep", "left").join(linked, "rep", "left")
        .select("rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_chars", F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0))).alias("shared_chars"))
    )
    return members.join(per_text, "rep").select("id", F.col("rep").alias("class_id"), "n_copies", "n_links", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_share"))
