import random
import time

import numpy as np
import pytest

from strandline.llm import spans as sp
from strandline.llm.leaks import Matcher, find_leaks, myers, words_of


def test_myers_against_dynamic_programming():
    def plain(p, t):
        prev, out = list(range(len(p) + 1)), []
        for w in t:
            cur = [0]
            for i in range(1, len(p) + 1):
                cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (p[i - 1] != w)))
            prev = cur
            out.append(cur[-1])
        return out

    r = random.Random(1)
    for _ in range(800):
        p, t = r.choices("abc", k=r.randint(1, 20)), r.choices("abc", k=r.randint(0, 30))
        assert myers(p, t) == plain(p, t)


def test_words():
    assert words_of("It\u200b’s  A_b\u00ad9 STRASSE") == ["it", "s", "a", "b9", "strasse"]
    assert words_of(None) == words_of("") == []


@pytest.mark.parametrize("errors", [0, 1])
def test_leaks_against_brute_force(spark, errors):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([14, 15, 16, 30, 40, 40])]
    docs = []
    for i in range(60):
        kind, text = r.random(), r.choices(words, k=r.randint(0, 60))
        if kind < 0.7:
            item = items[r.randrange(len(items))][1].split()
            a = r.randrange(max(1, len(item) - 13))
            cut = item[a : a + r.randint(13, 20)]
            if r.random() < 0.5 and len(cut) > 3:
                k = r.randrange(len(cut))
                cut = cut[:k] + r.choice([[], ["other"], [cut[k], "more"]]) + cut[k + 1 :]
            text[len(text) // 2 : len(text) // 2] = cut
        docs.append((i, " ".join(text).upper() if i % 3 else "\u00ad ,".join(text)))
    want = set()
    for d, text in docs:
        ws = words_of(text)
        for i, item in items:
            it = item.split()
            for s in range(len(it) - 14):
                if ws and min(myers(it[s : s + 15], ws)) <= errors:
                    want.add((d, i))
    d = spark.createDataFrame(docs, "doc int, text string").withColumnRenamed("doc", "doc_id")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(d, e, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", max_errors=errors, items_per_block=4).collect()}
    assert got == want
    joined = find_leaks(d, e, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", max_errors=errors, most_in_memory=2)
    memory = find_leaks(d, e, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", max_errors=errors)
    assert sorted(joined.collect()) == sorted(memory.collect())


def test_long_documents_take_linear_time():
    """A hit costs no walk over the document before it."""
    item = [f"t{i}" for i in range(20)]
    matcher = Matcher([(1, item)], 15, 0)
    began = time.time()
    found = matcher.leaks(("word " * 10 + " ".join(item) + " ") * 8_000)
    assert [x[:2] for x in found] == [(1, 0)] and time.time() - began < 30


def test_leaks_edges(spark):
    """Nulls, empty tables and texts, items under the length, repeated items, clashing names."""
    long = " ".join(f"t{i}" for i in range(20))
    d = spark.createDataFrame([(1, long, "a"), (2, None, "b"), (3, "", "c"), (1, long, "a")], "doc long, text string, item string")
    e = spark.createDataFrame([(7, long), (8, long), (9, "short one"), (None, long), (10, None)], "item long, text string")
    kw = dict(doc_id="doc", doc_text="text", item_id="item", item_text="text")
    assert sorted((r.doc, r.item) for r in find_leaks(d, e, **kw).collect()) == [(1, 7), (1, 7), (1, 8), (1, 8)]
    assert sorted((r.doc, r.item) for r in find_leaks(d, e, most_in_memory=1, **kw).collect()) == [(1, 7), (1, 7), (1, 8), (1, 8)]
    assert find_leaks(d.limit(0), e, **kw).count() == 0 and find_leaks(d, e.limit(0), **kw).count() == 0


def test_gram_hashes():
    r = np.random.default_rng(0)
    for g in (1, 2, 3, 5, 8, 77, 80, 127):
        p = r.integers(1, 3, 300).astype(np.uint32)
        q = np.concatenate([r.integers(1, 3, 37).astype(np.uint32), p])
        a, b = sp.gram_hashes(p, g), sp.gram_hashes(q, g)
        assert len(a) == 300 - g + 1 and (a == b[37:]).all()


def test_compact_windows_cover_all_stretches():
    r = np.random.default_rng(2)
    for _ in range(40):
        v, t = r.integers(0, 9, 60).astype(np.uint64), int(r.integers(3, 12))
        ws = sp.compact_windows(v, t)
        for i in range(len(v) - t + 1):
            c = i + int(v[i : i + t].argmin())
            assert sum(lo <= i and i + t <= hi and lo <= cc < hi and i <= cc < i + t for lo, cc, hi in ws) >= 1 and any(cc == c and lo <= i and i + t <= hi for lo, cc, hi in ws)
    assert len(sp.compact_windows(np.zeros(100_000, np.uint64), 81, 80)) == 2


def brute(texts, n):
    found = set()
    for a in texts:
        for b in texts:
            if a < b:
                grams = {texts[a][i : i + n] for i in range(len(texts[a]) - n + 1)}
                if any(texts[b][i : i + n] in grams for i in range(len(texts[b]) - n + 1)):
                    found.add((a, b))
    return found


def test_shared_spans_against_brute_force(spark):
    r = random.Random(9)
    make = lambda n, alphabet="abcdefgh é日🙂": "".join(r.choices(alphabet, k=n))
    base = [make(r.randint(20, 60)) for _ in range(6)]
    texts = {}
    for i in range(40):
        t = make(r.randint(0, 50))
        for _ in range(r.randint(0, 2)):
            b = r.choice(base)
            k = r.randrange(max(1, len(b) - 24))
            t += b[k : k + r.randint(17, 26)] + make(r.randint(0, 9))
        texts[f"r{i:02d}"] = t
    texts |= {"s1": "a" * 90, "s2": "b" + "a" * 50, "s3": "ab" * 40, "s4": "xab" + "ab" * 15, "s5": "abc" * 30, "s6": "zzbc" + "abc" * 9, "s7": texts["r00"], "s8": texts["r01"], "u1": "short"}
    rows = [(k, v, "x") for k, v in texts.items()] + [("r05", texts["r05"], "y"), ("n", None, "x"), (None, "a" * 99, "x")]
    df = spark.createDataFrame(rows, "rev string, text string, id string")
    for n in (20, 21):
        reps, members = sp.text_classes(df, key="rev", text="text", min_chars=n)
        spans = sp.shared_spans(reps, min_chars=n)
        got = [tuple(x) for x in sp.linked_records(spans, members).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, n)
        for s in spans.collect():
            assert texts[s.rep_a][s.begin_a : s.begin_a + s.n_chars] == texts[s.rep_b][s.begin_b : s.begin_b + s.n_chars] and s.n_chars >= n
    share = {r.id: r for r in sp.shared_share(reps, members, spans).collect()}
    assert set(share) == {k for k, v in texts.items() if len(v) >= 21} and share["s7"].n_copies == 2 if len(texts["r00"]) >= 21 else True
    assert all(0 <= r.shared_share <= 1 for r in share.values())
    reps, members = sp.text_classes(df.limit(0), key="rev", text="text", min_chars=20)
    assert sp.linked_records(sp.shared_spans(reps, min_chars=20), members).count() == 0


def test_shared_spans_after_repetitions(spark):
    """A repeated line, more often in one text than in another, before, after or on both sides of what they share: every pair, shift and run."""
    r, n = random.Random(4), 40
    make = lambda k: "".join(r.choices("abcdefgh", k=k))
    texts = {}
    for group in range(25):
        line, tail, head = make(r.randint(1, 19)), make(r.randint(9, 22)), make(r.randint(9, 22))
        for copy in range(4):
            many = line * r.randint(2, 90 // len(line) + 2)
            texts[f"g{group:02d}{copy}"] = make(r.randint(0, 9)) + (head if copy % 2 else "") + many + (tail if copy < 3 else "") + make(r.randint(0, 9))
    # Equal grams more than half a gram apart at distances that differ.
    x, y = make(5), make(8)
    texts |= {"x1": "1" + (x + y) * 2 + x + y[:2] + (x + y) * 3 + "2" + make(15), "x2": "3" + (x + y) * 4 + x + y[:2] + (x + y) * 3 + "2"}
    want = set()
    for a in texts:
        for b in texts:
            if a < b:
                ca, cb = sp.codes(texts[a]), sp.codes(texts[b])
                want |= {(a, b, i, i + s, k) for s in range(-len(ca), len(cb)) for i, k in sp.common_runs(ca, cb, s, n)}
    reps = spark.createDataFrame(list(texts.items()), "rep string, text string")
    got = [tuple(row) for row in sp.shared_spans(reps, min_chars=n).collect()]
    assert len(got) == len(set(got)) and set(got) == want
