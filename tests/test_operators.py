import itertools
import math
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions import web
from strandline.operators import band, exposure, lines, matching, review, stats, trajectories, windows
from strandline.operators.claims import contradictions, read_claims
from strandline.operators.components import connected_components
from strandline.operators.rows import once


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_once(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 0), (2, None, 5), (2, None, 5)], "id int, v string, at int")
    assert rows(once(df, "id", {"v": F.col("v")}, prefer=F.col("at"))) == [(1, "a"), (2, None)]


def test_band_join_edges(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", None), (3, "b", -5)], "__row int, k string, t long")
    right = spark.createDataFrame([("a", 90), ("a", 110), ("a", 89), ("b", -15), (None, 100), ("a", None)], "k string, u long")
    assert rows(band.band_join(left, right, on=["k"], left_time="t", right_time="u", lo=-10, hi=10).select("__row", "u")) == [(1, 110), (1, 90), (3, -15)]
    assert rows(band.band_join(left, right, on=["k"], left_time="t", right_time="u", lo=-10, hi=10, how="left_anti").select("__row")) == [(2,)]
    assert rows(band.band_join(left, right, on=["k"], left_time="t", right_time="u", lo=11, hi=20, how="left_semi")) == []


def test_band_join_random(spark):
    r = random.Random(4)
    a = [(i, r.choice("xy"), r.randrange(-500, 500)) for i in range(120)]
    b = [(r.choice("xyz"), r.randrange(-500, 500)) for _ in range(150)]
    want = sorted((i, u) for i, k, t in a for kk, u in b if k == kk and t - 37 <= u <= t + 5)
    got = band.band_join(spark.createDataFrame(a, "i int, k string, t long"), spark.createDataFrame(b, "k string, u long"), on=["k"], left_time="t", right_time="u", lo=-37, hi=5)
    assert sorted((x.i, x.u) for x in got.collect()) == want


def test_interval_lookup(spark):
    points = spark.createDataFrame([(1, "a", 5), (2, "a", 11), (3, "a", 20), (4, "b", 5)], "p int, k string, t long")
    spans = spark.createDataFrame([("a", 0, 10, "s1"), ("a", 15, 20, "s2")], "k string, lo long, hi long, s string")
    assert rows(band.interval_lookup(points, spans, on="k", time="t", start="lo", end="hi", point_id="p", values={"s": F.col("s")}).select("p", "s")) == [(1, "s1"), (3, "s2")]


def test_novel_first_seen_and_fresh(spark):
    df = spark.createDataFrame([("p", 1, "p@1", "a\nb"), ("p", 2, "p@2", "b\nc\nc\nä x"), ("p", 3, "p@3", " x\na"), ("q", 1, "q@1", "a"), ("q", 2, "q@2", None)], "page string, seq int, rev string, text string")
    got = rows(lines.novel_lines(df, page="page", seq="seq", text="text").select("page", "seq", "line"))
    assert got == [("p", 1, "a"), ("p", 1, "b"), ("p", 2, "c"), ("p", 2, "c"), ("p", 2, "ä x"), ("q", 1, "a")]
    assert rows(lines.first_seen(df, page="page", seq="seq", rev="rev", text="text")) == [("p@2", 0, "p@1"), ("p@3", 0, "p@2"), ("p@3", 1, "p@1")]
    h = spark.createDataFrame([(3, None), (3, [("insert", 1, 5), ("delete", 0, 1), ("replace", 2, 2)]), (0, None)], "n int, h array<struct<op string, b0 int, b1 int>>")
    assert [r[0] for r in h.select(lines.fresh_numbers(F.col("n"), F.col("h"))).collect()] == [[0, 1, 2], [1, 2], []]


def test_signatures(spark):
    text = [("r1", "hello\n-- Ada_L\nbye\n-- Bob"), ("r2", "x -- lower"), ("r3", "one\n\ntwo\nsee -- [[AdaMar13X]]"), ("r4", "AdaScout1: we posted it\nmore"), ("r5", "AdaScout1: are you there?"), ("r6", None), ("r7", "")]
    df = spark.createDataFrame(text, "rev string, text string")
    assert rows(lines.last_signed(df, rev="rev", text="text")) == [("r1", "Bob", 3)]
    assert ("r2", "lower", 0) in rows(lines.last_signed(df, rev="rev", text="text", upper=False))
    assert rows(lines.rule_signed(df, rev="rev", text="text").select("rev", "rule", "name")) == [("r3", "R1", "AdaMar13X"), ("r4", "R4", "AdaScout1")]
    assert dict(rows(lines.own_block(df, rev="rev", text="text"))) == {"r1": "bye\n-- Bob", "r2": "x -- lower"}


def test_text_functions(spark):
    df = spark.createDataFrame([("NetAIDec23Police",), ("ada mar 3 and Apr99",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.date_tags(F.col("x"))).collect()] == [["dec23"], ["mar03"], None]
    keys = spark.createDataFrame([("AdaMar13X",), ("ada_",), ("Mar13",)], "x string")
    assert [r[0] for r in keys.select(tx.alias_key(F.col("x"))).collect()] == ["ada", "ada", "mar13"]
    one = spark.createDataFrame([("a Ü/b.c",)], "x string")
    assert one.select(tx.page_key_of(F.col("x"))).first()[0] == "wik~a~20~c3~9c~2fb.c"
    s = spark.createDataFrame([("at 10.1.2.3 or fe80:1:2:3:4:5:6:1 or a.b@c.org, 1:2:3",)], "x string")
    assert s.select(tx.scrub(F.col("x"))).first()[0] == "at <ip> or <ip> or <email>, 1:2:3"
    e = spark.createDataFrame([("a\\b\tc\nd\r",)], "x string")
    assert e.select(tx.tsv_escaped(F.col("x"))).first()[0] == "a\\\\b\\tc\\nd\\r"
    run = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a", "b"], ["b", "a"]), (["a"], ["a", "b"])], "w array<string>, p array<string>")
    assert [r[0] for r in run.select(tx.has_run(F.col("w"), F.col("p"))).collect()] == [True, False, False]


def test_web_functions(spark):
    df = spark.createDataFrame([("https://www.Host.example/a/wiki.cgi?action=edit&amp;id=P&cb=1&text=&id=Q#f",), ("nothing",), (None,)], "u string")
    ps = web.pairs(F.col("u"))
    r = df.select(web.host(F.col("u")), web.last_segment(F.col("u")), web.first_values(ps)["id"], web.cache_keys(ps), web.key_order(ps), web.kept_query(ps)).first()
    assert tuple(r) == ("host.example", "wiki.cgi", "P", "cb", "action id text id", "action=edit&id=P&id=Q")
    cases = [("edit'", ["text"], "P", True, "save"), ("edit", [], "P", False, "edit_form"), ("", ["keywords"], "", False, "search"), ("", ["keywords"], "P", False, "browse"), ("login", [], "", False, "prefs"), ("rc", [], "", False, "meta"), (None, ["diff"], "P", False, "diff"), ("print", [], None, False, "browse"), ("zap", [], "", False, "other")]
    c = spark.createDataFrame(cases, "a string, k array<string>, p string, t boolean, want string")
    assert c.where(web.request_class(F.col("a"), F.col("k"), F.col("p"), F.col("t")) != F.col("want")).count() == 0
    import hashlib
    import hmac

    d = spark.createDataFrame([("10.0.0.7",), ("x",)], "ip string").select(web.keyed_digest(F.col("ip"), b"k", 12), web.net24(F.col("ip"))).collect()
    assert d[0][0] == hmac.new(b"k", b"10.0.0.7", hashlib.sha256).hexdigest()[:12] and [x[1] for x in d] == ["10.0.0.0/24", None]


def _mh(tables):
    r = s = pr = mix = qs = 0.0
    n_used = 0
    for a, b, c, d in tables:
        n = a + b + c + d
        if n < 2 or a + b == 0 or c + d == 0:
            continue
        n_used += 1
        x, y, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
        r, s, pr, mix, qs = r + x, s + y, pr + p * x, mix + p * y + q * x, qs + q * y
    if not r or not s:
        return n_used, None, None, None
    h = math.exp(1.96 * math.sqrt(pr / (2 * r * r) + mix / (2 * r * s) + qs / (2 * s * s)))
    return n_used, r / s, r / s / h, r / s * h


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 4), min_size=1, max_size=6))
def test_mantel_haenszel(spark, tables):
    got = tuple(stats.mantel_haenszel(spark.createDataFrame(tables, "a long, b long, c long, d long")).first())
    want = _mh(tables)
    assert got[0] == want[0] and all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(got[1:], want[1:]))


def test_at_risk_permutation_bootstrap(spark):
    r = spark.createDataFrame([(1, "a", 1, False), (2, "a", 2, True), (3, "a", 2, False), (4, "a", 3, True), (5, "b", 9, False)], "id int, w string, t int, y boolean")
    assert sorted(x.id for x in stats.at_risk(r, agent="w", time="t", outcome=F.col("y"), tie="id").collect()) == [1, 2, 5]
    alone = spark.createDataFrame([(1, "s1", "x", ["x"]), (2, "s2", "y", ["z"]), (3, "s2", None, ["z"]), (4, "s3", "y", [])], "i int, s string, o string, v array<string>")
    got = stats.permutation_test(alone, item="i", stratum="s", own="o", visible="v", reps=19).first()
    assert (got.n_items, got.observed, got.null_mean, got.p_value) == (2, 1, 1.0, 1.0)
    tied = spark.createDataFrame([(i, "s", "x" if i < 20 else "y", ["x"] if i < 20 else ["y"]) for i in range(40)], "i int, s string, o string, v array<string>")
    got = stats.permutation_test(tied, item="i", stratum="s", own="o", visible="v", reps=99).first()
    assert got.observed == 40 and abs(got.null_mean - 20) < 2 and got.p_value == 0.01
    same = spark.createDataFrame([("a", 1, 0)] * 12, "c string, h int, d int")
    b = stats.cluster_bootstrap(same, cluster="c", hit="h", decoy="d", reps=50).first()
    assert (b.n, b.excess, b.ci_low, b.ci_high) == (12, 1.0, 1.0, 1.0)
    assert stats.cluster_bootstrap(same.limit(5), cluster="c", hit="h", decoy="d", reps=50).count() == 0


def test_permutation_neighbour_is_the_next_user_of_the_day(spark):
    """Ids of any size, the last user's next is the first, a user alone has none, and busy ones aren't used."""
    from strandline.plans.events import _items

    day = 86_400
    rows = [(1, 7, 5, "a"), (2, 7, 6, "b"), (3, 900, 7, "c"), (4, 100_000, 8, "d"), (5, 7, day, "a"), (6, None, 9, "a")] + [(10 + i, 7 + i % 2, 2 * day + i, "abc"[i // 2]) for i in range(6)]
    got = _items(spark.createDataFrame(rows, "event_id int, user_id long, t long, event_type string")).collect()
    assert {(x.user_id, x.event_type, x.n, tuple(sorted(x.types))) for x in got} == {(7, "a", 1, ("c",)), (7, "b", 1, ("c",)), (900, "c", 1, ("d",)), (100_000, "d", 1, ("a", "b"))} and len(got) == 4


def test_shuffled_hits_either_way():
    """Mean and variance of the hits are those of all orders, by counts as one by one."""
    sets, values, held = [0, 0, 1, 1, 1, 2], [0, 0, 0, 1, 1, 2], [{0}, {0, 2}, {1}]
    every = [sum(v in held[s] for s, v in zip(sets, order)) for order in itertools.permutations(values)]
    mean, var = sum(every) / len(every), sum(x * x for x in every) / len(every) - (sum(every) / len(every)) ** 2
    pairs, seen = np.zeros((3, 3), np.int64), np.array([[v in h for v in range(3)] for h in held])
    np.add.at(pairs, (sets, values), 1)
    assert pairs.size > len(sets)
    one = stats.shuffled_hits(pairs, seen, 20_000, np.random.default_rng(1))
    assert abs(one.mean() - mean) < 0.03 and abs(one.var() - var) < 0.05
    many = stats.shuffled_hits(pairs * 50, seen, 20_000, np.random.default_rng(1))
    n = pairs.sum()  # the mean grows with the items, the variance by n - 1 and n
    assert abs(many.mean() / 50 - mean) < 0.02 and abs(many.var() / 50 / (var * (n - 1) / n) / (50 * n / (50 * n - 1)) - 1) < 0.05


def test_permutation_and_calibration_run_in_full(spark, tmp_path):
    """p resolves 1 / 2,001; 20 trials give one row with median, range and p, and dealt types keep each day's counts."""
    from strandline.plans import events

    rows = [(i, i % 200, "2024-01-01 00:00:00" if i < 400 else "2024-01-02 00:00:00", "view" if (i % 200) < 100 else "click") for i in range(800)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.withColumn("value", F.lit(1.0)).withColumn("props", F.lit("{}")).write.parquet(str(tmp_path / "events.parquet"))
    got = events.permutation(spark, str(tmp_path)).first()
    assert (got.n_items, got.observed) == (800, 792) and abs(got.null_mean - 400) < 2 and got.p_value == 1 / 2001
    c = events.calibration(spark, str(tmp_path)).collect()
    assert len(c) == 1 and c[0].n_trials == 20 and c[0].p_value == 1 / 21 and c[0].low <= c[0].median <= c[0].high < c[0].observed_ratio and abs(c[0].observed_ratio - 1.98) < 0.02
    base = events.events(spark, str(tmp_path))
    days = events._dealt(base, 3).groupBy("trial", F.floor(F.col("t") / 86_400).alias("day"), "event_type").count().collect()
    assert len(days) == 16 and all(x["count"] == 200 for x in days)
    same = events._dealt(base, 3).where("trial = 0").select("event_id", "event_type")
    assert same.exceptAll(base.select("event_id", "event_type")).count() == 0


def test_leave_one_out_tie_and_mode(spark):
    df = spark.createDataFrame([(1, "g", "a", "f"), (2, "g", "b", "f"), (3, "h", "a", "f"), (4, "i", "a", None)], "r int, g string, c string, f string")
    got = {x.r: x.credit for x in stats.leave_one_out(df, row="r", group="g", candidate="c", trait="f").collect()}
    assert got == {1: 0.5, 2: 0.5}  # with one trait all tell as little
    df = spark.createDataFrame([(1, "g", "a", "f"), (2, "g", "b", "h"), (3, "h", "a", "f"), (4, "k", "a", "h"), (5, "k", "b", "f"), (6, "i", "b", "f")], "r int, g string, c string, f string")
    got = {x.r: x.credit for x in stats.leave_one_out(df, row="r", group="g", candidate="c", trait="f").collect()}
    # Row 1: a has 1 of 2 left, b 2 of 3. Row 2: a 1 of 3, b 0 of 2. Row 4: a 0 of 2, b 1 of 3. Row 5: a 2 of 3, b 1 of 2.
    assert got == {1: 0.0, 2: 0.0, 4: 0.0, 5: 0.0}
    m = spark.createDataFrame([("k", "x", 2), ("k", "y", 1), ("k", None, 0), ("j", "z", 5)], "k string, v string, t int")
    assert rows(stats.ordered_mode(m, by="k", value="v", first="t")) == [("j", "z", 1, 1.0), ("k", "y", 1, 0.5)]


def test_circular_gap(spark):
    df = spark.createDataFrame([(86100, 300), (0, 43200), (5, 5)], "a int, b int")
    assert [r[0] for r in df.select(stats.circular_gap(F.col("a"), F.col("b"))).collect()] == [600, 43200, 0]


def test_matching(spark):
    a = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m"), (4, None)], "a int, on string")
    b = spark.createDataFrame([("k", 7), ("m", 8), ("m", 9), (None, 1)], "on string, b int")
    assert rows(matching.unique_match(a, b, on=["on"], left_id="a", right_id="b")) == [(1, 7), (2, 7)]
    assert rows(matching.multi_holders(b, item="on", owner="b")) == [("m", 2)]
    assert sorted(r.status for r in matching.any_match(a, b, on="on", agrees=F.col("b") == 8).collect()) == ["agree", "differ", "differ", "unmatched"]
    log = spark.createDataFrame([("e", 1, 1, "x", "n", False), ("e", 2, 2, None, None, True), ("e", 3, 3, "y", None, False), ("f", 1, 1, None, "n", False)], "k string, t int, q int, v string, w string, c boolean")
    assert rows(matching.latest_fields(log, key="k", time="t", seq="q", fields=["v", "w"], cleared=F.col("c"))) == [("e", "y", None), ("f", None, "n")]


def test_peaks_and_switches(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 0, "y"), ("a", 59, "x"), ("a", 60, "z"), ("b", 5, None)], "k string, t long, v string")
    assert rows(windows.peak_count(df, by=["k"], time="t", span_s=60)) == [("a", 3), ("b", 1)]
    assert rows(windows.peak_distinct(df, by=["k"], time="t", value="v", span_s=60)) == [("a", 2)]
    s = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 3, 3, "x"), ("a", 4, 4, "x"), ("a", 5, 5, None)], "w string, t int, i int, v string")
    assert rows(windows.switches(s, agent="w", time="t", tie="i", value="v")) == [("a", 4, 2, 1)]


def test_review_calls(spark):
    a = spark.createDataFrame([("r1", "A", 1, "l"), ("r2", "A", 2, "l"), ("r3", "A", 3, "l"), ("r4", "B", 4, "l"), ("r5", "C", 5, "l"), ("r6", "D", 6, "l"), ("r7", "D", 7, "l")], "rev string, name string, time int, label string")
    schema = "call_no int, decision string, name string, target string, revs array<string>"
    calls = spark.createDataFrame([(1, "split", "A", None, ["r3", "r1"]), (2, "merge", "B", "A", []), (3, "reassign", "C", "D", ["r5"]), (4, "exclude", "D", None, ["r6"]), (5, "attribute", "E", "E", ["u1"])], schema)
    unsigned = spark.createDataFrame([("u1", 9, "l"), ("r1", 1, "l")], "rev string, time int, label string")
    assert review.problems(calls, a).count() == 0
    got = {r.rev: (r.name, r.part, r.signed_as) for r in review.apply_calls(a, calls, unsigned).collect()}
    assert got == {"r1": ("A", 1, None), "r2": ("A", 1, None), "r3": ("A", 2, None), "r4": ("A", 2, "B"), "r5": ("D", 1, "C"), "r7": ("D", 1, None), "u1": ("E", 1, None)}
    parts = spark.createDataFrame([(1, "partition", "A", None, ["r1", "r3"])], schema)
    assert {r.rev: r.part for r in review.apply_calls(a, parts).where("name = 'A'").collect()} == {"r1": 2, "r2": 1, "r3": 2}
    bad = spark.createDataFrame([(1, "merge", "A", "A", []), (2, "zap", "A", None, []), (3, "merge", "Z", "A", []), (4, "reassign", "A", None, ["r1"]), (5, "exclude", "A", None, ["r1"]), (6, "exclude", "A", None, ["r99"])], schema)
    assert {p for _, p in rows(review.problems(bad, a))} == {"merge into itself", "unknown decision", "unknown name", "no target", "revision in two calls", "unknown revision"}


def test_alias_and_place(spark):
    n = spark.createDataFrame([("AdaMar13",), ("Ada",), ("ada",), ("Ada Lov",), ("Mar13",), (None,)], "n string")
    assert rows(review.alias_candidates(n, name="n")) == [("Ada", "AdaMar13"), ("Ada", "ada"), ("AdaMar13", "ada")]
    one = spark.createDataFrame([("x", "AdaMar13", "p", "l", 600), ("y", "AdaMar13", "p", "l", 601), ("z", "AdaMar13", "p", "m", 0)], "rev string, name string, page_key string, label string, t long")
    to = spark.createDataFrame([("T", "Ada", "p", "l", 0)], "target string, name string, page_key string, label string, t long")
    assert rows(review.placeable(one, to)) == [("x", "T")]


def test_exposure(spark):
    arr = lambda x: F.lit(x) if x is None else F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    cases = [(["a"], [], None, "session"), (["a"], ["a"], None, "session"), (["a"], ["b"], None, "ambiguous"), (["a", "b"], [], None, "ambiguous"), ([], ["a"], None, "weak"), ([], [], "a", "exclusive"), ([], [], None, "none")]
    one = spark.range(1)
    for strong, weak, only, want in cases:
        assert one.select(exposure.session_tier(arr(strong), arr(weak), F.lit(only).cast("string"))).first()[0] == want
    b = spark.createDataFrame([("own:1;private:3",), ("private:2",), ("private:1;shared:4",), ("",), (None,)], "k string")
    assert [r[0] for r in b.select(exposure.evidence_basis(F.col("k"))).collect()] == ["own", "private2", "private1", "exclusive", "exclusive"]
    uses = spark.createDataFrame([(1, "a", "p", 10), (2, "a", "q", 10), (3, "b", "p", 10)], "use_id int, agent string, page string, t int")
    reads = spark.createDataFrame([("a", "p", 5), ("a", "q", 8), ("b", "p", 11)], "agent string, page string, t int")
    assert {r.use_id: r.how for r in exposure.read_before(uses, reads, agent="agent", page="page", lag_s=5).collect()} == {1: "confirmed", 2: "arrived_between", 3: "no_named_read"}
    u = spark.createDataFrame([("k", "a", "f", 3), ("k", "b", "f", 1), ("k", "c", "g", 2), ("k", "c", "f", 9), ("k", None, "f", 0)], "tok string, who string, fam string, t int")
    assert rows(exposure.adoption(u, token="tok", agent="who", family="fam", time="t")) == [("k", "b", 1, 3, 2, 1)]


def test_claims(spark):
    c = read_claims("R3 arrived 10:15:20; deadline 10:20. We expect R4 due about 11:00 UTC; your round 5 was 12:30Z?")
    assert [(x["tag"], x["round"], x["value_s"], x["event"], x["status"], x["inherited"]) for x in c[:2]] == [("R", 3, 36920, "arrival", "reported", False), ("R", 3, 37200, "deadline", "reported", True)]
    assert c[2]["clock"] == "other" and c[2]["status"] == "predicted" and c[2]["owner"] == "self" and c[3]["owner"] in ("peer", "mixed")
    assert read_claims(None) == [] and read_claims("") == [] and read_claims("105m = 13:19:16")[0]["status"] == "derived"
    df = spark.createDataFrame([("w", "p1", "R1 arrived 23:55:00"), ("w", "p2", "R1 arrived 00:05:00"), ("w", "p3", "R1 arrived 04:00:00"), ("v", "p4", "R1 arrived 12:00"), ("w", "p5", None)], "w string, p string, x string")
    assert rows(contradictions(df, writer="w", post="p", text="x")) == [("w", "p1", "p2", 1, 0, None), ("w", "p1", "p3", 0, 1, 14_700), ("w", "p2", "p3", 0, 1, 14_100)]


def test_components(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [("hub", f"h{i}") for i in range(40)] + [("c%02d" % i, "c%02d" % (i + 1)) for i in range(30)] + [("x", "x"), (None, "y")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = sorted((x, find(x)) for x in parent)
    assert rows(connected_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b")) == want
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_networks(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("2001:db8:1:2::9",), ("nope",), ("",), (None,)], "ip string")
    assert [r[0] for r in df.select(web.network(F.col("ip"))).collect()] == ["10.1.2.0/24", "2001:db8:1::/48", None, None, None]


def test_assemble(spark):
    e = spark.createDataFrame([("r1", "A", "family", "f", "p", 10, 1), ("r2", "A", "relay", "g", "p", 3610, 0), ("r3", "A", "other", None, "q", 1, None), ("r4", "B", "family", "f", "p", 1, 0), ("r5", None, "family", "f", "p", 1, 0)], "rev string, who string, scope string, fam string, page string, t long, copied int")
    got = trajectories.assemble(e, name="who", scope="scope", family="fam", page="page", time="t", rev="rev", flag=F.col("copied") == 1).collect()
    assert [(r.who, r.n_in_scope, r.n_family, r.n_relay, r.n_elsewhere, r.n_pages, r["first"], r["last"], r.span_hours, r.families, r.primary_family, r.n_flagged) for r in got] == [("A", 2, 1, 1, 1, 2, 10, 3610, 1.0, "f:1;g:1", "f", 1)]
    assert trajectories.assemble(e.limit(0), name="who", scope="scope", family="fam", page="page", time="t", rev="rev").count() == 0


def test_containment(spark):
    targets = [("T", "RiverScoutMar13", "f", 0), ("T", "RiverScoutMar13", "f", 50_000), ("U", "LakeScoutMar14", None, 0), ("V", "BayMar15", "f", 0), ("W", "BayMar15X", "f", 0)]
    ones = [("in", "ScoutMar13", "f", 86_400), ("late", "ScoutMar13", "f", 50_000 + 86_401), ("tag", "ScoutMar12", "f", 0), ("fam", "ScoutMar13", "g", 0), ("any", "LakeScoutMar14Agent", "z", 5), ("two", "BayMar15", "f", 1), ("null", None, "f", 1)]
    got = trajectories.containment(spark.createDataFrame(ones, "rev string, name string, family string, t long"), spark.createDataFrame(targets, "target string, name string, family string, t long"))
    assert rows(got) == [("any", "U"), ("in", "T")]


def test_origin_keys_and_asked(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = trajectories.name_origin(one("a", "b", "c", "d", "e", None), name="x", signed=one("a", None), labels=one("a", "b"), titles=one("c"), texts=one("c", "d"))
    assert rows(got) == [("a", "signoff"), ("b", "label"), ("c", "page title"), ("d", "post text"), ("e", "coined")]
    k = spark.createDataFrame([("a", "k", 1), ("b", "k", 1), ("a", "k", 1), ("b", "m", 1), ("c", "k", 2), (None, "k", 1)], "w string, k string, n int")
    assert rows(trajectories.shared_keys(k, writer="w", key=["k", "n"])) == [("a", "b", 1)]
    r = spark.createDataFrame([(1, "p", "2", 10), (2, "p", "2", 4), (3, "p", "9", 10), (4, "p", "x", 10), (5, "p", None, 10), (6, "p", "99999999999", 10)], "r int, p string, q string, t long")
    v = spark.createDataFrame([("p", 2, 5), ("p", 2, 5)], "p string, seq int, s long")
    assert rows(trajectories.asked_revision(r, v, read="r", page="p", asked="q", time="t", seq="seq", saved="s").select("r", "how")) == [(1, "asked"), (2, "unresolved"), (3, "unresolved"), (6, "unresolved")]


def test_conformity(spark):
    p = spark.createDataFrame([(1, "a", "p", 100, ["x"]), (2, "b", "p", 90, ["y"]), (3, "c", "p", 50, ["x"]), (4, "a", "p", 99, ["x"]), (5, "b", "p", 100, ["x"]), (6, "d", "p", 300, ["z"]), (7, "e", "p", 100, [])], "i int, w string, p string, t long, v array<string>")
    got = {r.side: (r.n_items, r.n_alike, r.n_nearest) for r in trajectories.conformity(p, post="i", agent="w", page="p", time="t", variants="v", back_s=60, ahead_s=60).collect()}
    # Past: 1 sees y at 90 and x at 50; 2 sees x at 50; 4 sees y at 90 and x at 50; 5 sees x at 99 and at 50. Future: 2 sees x at 99 and 100; 3 sees y and x; 4 sees x at 100.
    assert got == {"past": (4, 3, 1), "future": (3, 2, 1)}
