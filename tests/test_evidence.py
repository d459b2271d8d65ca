"""Session evidence and decoys against plain loops."""

import random
from collections import defaultdict

import pytest

from strandline.operators import exposure


def sessions_of(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
        else:
            out.append([t, t])
    return out


def test_session_evidence_against_loops(spark):
    r = random.Random(7)
    names, writers, gap, window = ["Ada", "Bee", "Cy Dee", "Eve", "Fay"], ["w1", "w1#2", "w2", "w3"], 100, 300
    owners = [("Ada", "w1"), ("Bee", "w2"), (None, "w3")]
    labels = [("Eve", "w2"), ("Eve", "w3"), ("Fay", "w1"), ("Fay", "w1#2"), ("Cy Dee", "w3"), ("Ada", "w1")]
    spans = [(w, 200 * i, 200 * i + 1500) for i, w in enumerate(writers)]
    requests = [(r.choice(names), r.randrange(6_000)) for _ in range(260)]
    saves = [(n, t, r.choice(writers)) for n, t in requests if r.random() < 0.12]
    own, users = defaultdict(set), defaultdict(set)
    for n, w in owners:
        own[n].add(w)
    for n, w in labels:
        users[n].add(w.split("#")[0])

    def kind(n, w):
        return "own" if w in own[n] else "borrowed" if own[n] else "generic" if " " in n else "shared" if len(users[n]) > 1 else "private"

    want, strong_of, weak_names = {}, defaultdict(set), set()
    for n in names:
        for k, (a, z) in enumerate(sessions_of([t for m, t in requests if m == n], gap), 1):
            mine = [w for m, t, w in saves if m == n and a <= t <= z]
            kinds = [kind(n, w) for w in mine]
            strong = {w for w, x in zip(mine, kinds) if x in ("own", "private")}
            weak = {w for w, x in zip(mine, kinds) if x not in ("own", "private")}
            weak |= own[n] if weak else set()
            strong_of[n] |= strong
            weak_names |= {n} if weak else set()
            want[n, k] = (a, z, strong, weak, ";".join(f"{x}:{kinds.count(x)}" for x in sorted(set(kinds))))
    result = {}
    for (n, k), (a, z, strong, weak, kinds) in want.items():
        tier, verdict = "none", None
        if len(strong) == 1 and not weak - strong:
            tier, verdict = "session", next(iter(strong))
        elif strong and (len(strong) > 1 or weak - strong):
            tier = "ambiguous"
        elif weak:
            tier = "weak"
        elif strong_of[n] and " " not in n and n not in weak_names and len({w.split("#")[0] for w in strong_of[n]}) == 1:
            fits = [w for w, f, last in spans if w in strong_of[n] and f - window <= a and z <= last + window]
            if len(fits) == 1:
                tier, verdict = "exclusive", fits[0]
        result[n, k] = (a, z, tier, verdict, kinds)
    got = exposure.session_evidence(
        spark.createDataFrame(requests, "name string, t long"), spark.createDataFrame(saves, "name string, t long, writer string"), owners=spark.createDataFrame(owners, "name string, writer string"),
        labels=spark.createDataFrame(labels, "name string, writer string"), spans=spark.createDataFrame(spans, "writer string, first_s long, last_s long"), gap_s=gap, window_s=window).collect()
    assert {(x.name, x.session_no): (x.start_s, x.end_s, x.tier, x.verdict, x.kinds) for x in got} == result
    assert len({x[2] for x in result.values()}) >= 4


def test_decoys_against_loops(spark):
    r = random.Random(3)
    agents, pages, w, pw = [f"a{i}" for i in range(9)], [f"p{i}" for i in range(6)], 50, 40
    family = {a: r.choice(["f", "g"]) for a in agents[:8]}
    reads = [(r.choice(agents), r.choice(pages), r.randrange(400), f"s{r.randrange(5)}") for _ in range(260)]
    touches = {(r.choice(agents), r.choice(pages)) for _ in range(12)}
    targets = [(i, r.choice(agents), r.choice(pages), r.randrange(400)) for i in range(60)]
    dropped = [(i, f"s{r.randrange(5)}") for i in range(0, 60, 3)]
    want = {}
    for i, a, q, t in targets:
        drop = {s for j, s in dropped if j == i}
        mine = [(p, s) for o, p, u, s in reads if o == a and t - w <= u < t and s not in drop]
        if not mine:
            continue
        rates = []
        for same in (False, True):
            others = [o for o in agents if o != a and (o, q) not in touches and any(x == o and t - w <= u < t for x, _, u, _ in reads)]
            if same:
                others = [o for o in others if family.get(o) and family.get(o) == family.get(a)]
            hits = [any(x == o and p == q and t - w <= u < t for x, p, u, _ in reads) for o in others]
            rates.append(round(sum(hits) / len(hits), 9) if hits else None)
        near = {p for _, o, p, u in targets if o != a and t - pw <= u < t + pw and p != q and (a, p) not in touches and family.get(o) and family.get(o) == family.get(a)}
        seen = [any(p == x for x, _ in mine) for p in near]
        want[i] = (int(any(p == q for p, _ in mine)), *rates, round(sum(seen) / len(seen), 9) if seen else None)
    got = exposure.decoy_rates(
        spark.createDataFrame(targets, "target_id int, agent string, page string, t long"), spark.createDataFrame(reads, "agent string, page string, t long, session_id string"), families=spark.createDataFrame(list(family.items()), "agent string, family string"),
        touches=spark.createDataFrame(sorted(touches), "agent string, page string"), dropped=spark.createDataFrame(dropped, "target_id int, session_id string"), window_s=w, page_window_s=pw).collect()
    near = lambda x: None if x is None else round(x, 9)
    assert {x.target_id: (x.hit, near(x.reader_rate), near(x.family_rate), near(x.page_rate)) for x in got} == want
    assert all(any(x[k] is not None for x in want.values()) for k in (1, 2, 3))


def test_calls_that_overlap_raise(spark):
    points = spark.createDataFrame([(1, "a", 5), (2, "a", 30)], "p int, k string, t long")
    good = spark.createDataFrame([("a", 0, 9, "c1"), ("a", 10, 20, "c2"), ("b", 0, 90, "c3")], "k string, lo long, hi long, c string")
    args = dict(on="k", time="t", start="lo", end="hi", point_id="p", call="c")
    assert [tuple(x) for x in exposure.interval_calls(points, good, **args).collect()] == [(1, "c1")]
    for row in (("a", 9, 9, "c4"), ("a", 0, 3, "c5")):
        with pytest.raises(Exception, match="overlapping calls"):
            exposure.interval_calls(points, good.union(spark.createDataFrame([row], good.schema)), **args).collect()


def test_running_total(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 90_000, 2), ("a", 90_001, 3), ("a", 400_000, -4), ("b", 1, 9)], "k string, t long, v long")
    assert sorted(map(tuple, exposure.running_total(df, by="k", at="t", value="v").collect())) == [("a", 5, 1), ("a", 90_000, 3), ("a", 90_001, 6), ("a", 400_000, 2), ("b", 1, 9)]


def test_saves_need_page_second_and_label(spark):
    q = spark.createDataFrame([("Ada", "p", 5), ("Bee", "p", 5), ("Ada", "q", 5), ("Ada", "p", 6)], "name string, page_key string, t long")
    v = spark.createDataFrame([("p", "Ada", 5, "w1"), ("p", "Bee", 5, None), ("q", "Cy", 5, "w3")], "page_key string, label string, t long, writer string")
    assert [tuple(x) for x in exposure.saved_by(q, v).collect()] == [("Ada", 5, "w1")]
    s = spark.createDataFrame([("Ada", 1, 0, 9, "w1", "own:1"), ("Bee", 1, 0, 9, None, "")], "name string, session_no long, start_s long, end_s long, verdict string, kinds string")
    reads = spark.createDataFrame([(1, "Ada", 3), (2, "Bee", 3), (3, "Ada", 30)], "read int, name string, t long")
    assert [tuple(x) for x in exposure.with_basis(reads, s, read="read").collect()] == [(1, "Ada", 3, "w1", "own")]
    assert exposure.with_basis(reads, s, read="read", bases=("private2",)).count() == 0


def test_agents_within_against_loops(spark):
    r = random.Random(5)
    points = [(i, r.choice("abcd"), r.randrange(300)) for i in range(80)] + [(99, "a", None)]
    marks = [(r.choice("abcde"), r.randrange(300)) for _ in range(40)] + [(None, 5), ("a", None)]
    p, m = spark.createDataFrame(points, "i int, who string, t long"), spark.createDataFrame(marks, "who string, t long")
    for lo, hi in ((-20, -1), (0, 15), (-7, 9), (0, 0)):
        got = {x.i: (x.own, x.others) for x in exposure.agents_within(p, m, point_id="i", agent="who", time="t", lo=lo, hi=hi).collect()}
        near = {i: {w for w, u in marks if w and u is not None and t + lo <= u <= t + hi} for i, _, t in points if t is not None}
        assert got == {i: (int(a in near[i]), len(near[i] - {a})) for i, a, t in points if t is not None}


def test_values_at_ranks(spark):
    from strandline.operators.stats import at_ranks

    r = random.Random(2)
    rows = [(r.choice("xyz"), r.choice([r.uniform(-3, 9), 4.0, 4.0])) for _ in range(300)] + [("w", 1.0), ("w", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    from pyspark.sql import functions as F

    got = {x.k: (x.lo, x.up) for x in at_ranks(df, by="k", value="v", ranks={"lo": F.lit(1), "up": F.floor(F.col("n") / 2) + 1}).collect()}
    values = {k: sorted(v for g, v in rows if g == k and v is not None) for k in "wxyz"}
    assert got == {k: (v[0], v[len(v) // 2]) for k, v in values.items()}


def test_windows_across_time_buckets(spark):
    from strandline.operators import windows

    r = random.Random(9)
    day = windows.BUCKET_S
    rows = [(i, r.choice("ab"), day * r.choice([1, 2, 3]) + r.randrange(-40, 40), r.choice("xyz")) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k string, t long, v string")
    for span in (1, 25, 60, day + 30, 3 * day):
        counts = {k: max(sum(1 for _, g, u, _ in rows if g == k and t - span < u <= t) for _, h, t, _ in rows if h == k) for k in "ab"}
        kinds = {k: max(len({v for _, g, u, v in rows if g == k and t - span < u <= t}) for _, h, t, _ in rows if h == k) for k in "ab"}
        assert dict(map(tuple, windows.peak_count(df, by=["k"], time="t", span_s=span).collect())) == counts
        assert dict(map(tuple, windows.peak_distinct(df, by=["k"], time="t", value="v", span_s=span).collect())) == kinds
    want = {}
    for k in "ab":
        vs = [v for _, _, v in sorted((t, i, v) for i, g, t, v in rows if g == k)]
        want[k] = (len(vs), sum(x != y for x, y in zip(vs, vs[1:])), len(set(vs)) - 1)
    assert {x.k: (x.n_events, x.n_switches, x.n_new) for x in windows.switches(df, agent="k", time="t", tie="i", value="v").collect()} == want
