"""Repeated strings of a host against brute force, and edge cases."""

import random

import numpy as np

from strandline.llm.hosts import covered_spans, sampled, stream, unique_runs


def test_sampled():
    r = np.random.default_rng(1)
    for n in (1, 5, 9, 60):
        values = r.integers(0, 9, n).astype(np.uint64)
        want = {i + int(values[i : i + 5].argmin()) for i in range(n - 4)}
        assert set(sampled(values, 5).tolist()) == want


def test_against_brute_force(spark):
    r = random.Random(4)
    least = 8
    shared = [" ".join(r.choices("abcdef", k=n)) for n in (8, 9, 20, 40)]
    rows = []
    for k in range(90):
        text = " ".join(x for _ in range(r.randint(0, 3)) for x in (" ".join(r.choices("abcdefghijklm", k=r.randint(0, 12))), r.choice(shared)))
        rows.append((k, f"p{r.randrange(30)}", r.choice(["x", "y"]), text))
    pages: dict = {}
    for _, p, h, t in rows:
        words = t.split()
        for i in range(len(words) - least + 1):
            pages.setdefault((h, tuple(words[i : i + least])), set()).add(p)
    want = {}
    for k, p, h, t in rows:
        words = t.split()
        want[k] = covered_spans(t, [i for i in range(len(words) - least + 1) if len(pages[h, tuple(words[i : i + least])]) > 1], least)
    df = spark.createDataFrame(rows, "k int, page string, host string, t string")
    got = {x.k: [tuple(s) for s in x.removed] for x in unique_runs(df, key="k", text="t", page="page", host=df["host"], least=least).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_edges(spark):
    """Nulls, empty texts, repeated rows, one page only, ties, clashing names, very long texts, empty tables."""
    line = " ".join(f"w{i}" for i in range(30))
    rows = [("a", "p", f"x {line} y", 1), ("b", "q", f"{line}\nz", 2), ("b", "q", f"{line}\nz", 2), ("c", "r", None, 3), ("d", "r", "", 4), (None, "r", line, 5), ("e", None, line, 6), ("f", "s", "n " * 50_000, 7), ("g", "t", "other", 8), ("h", "u", "m " * 40, 9), ("i", "u", "m " * 40, 9)]
    df = spark.createDataFrame(rows, "row string, p string, t string, places int")
    got = sorted((x.row, x.kept, x.removed_chars) for x in unique_runs(df, key="row", text="t", page="p").collect())
    assert got == [("a", "x  y", len(line)), ("b", "\nz", len(line)), ("b", "\nz", len(line)), ("d", "", 0), ("f", "n " * 50_000, 0), ("g", "other", 0), ("h", "m " * 40, 0), ("i", "m " * 40, 0)]
    assert unique_runs(df.limit(0), key="row", text="t", page="p").count() == 0
    assert stream("a-b  c")[0] == [(0, 1), (1, 2), (2, 3), (5, 6)]
