import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators.sessions import sessionize
from strandline.operators.versions import attributes_at

EVENTS = "eid long, k string, t long, b string, version int"
CHANGES = "k string, t long, seq int, add string"


def seen(spark, events, changes, bucket=100):
    e = spark.createDataFrame(events, EVENTS)
    c = spark.createDataFrame(changes, CHANGES)
    out = attributes_at(e, c, entity="k", event_id="eid", event_time="t", change_time="t", running_max={"seq": F.col("seq")}, bucket_s=bucket)
    return {r.eid: (r.version, r.seq) for r in out.collect()}


def test_versions_edges(spark):
    """Null keys and times, ties, repeated changes, clashing names; a change at the event's second is known."""
    events = [(1, "p", 10, "x", 0), (2, "p", 9, None, 0), (3, None, 10, "", 0), (4, "p", None, "", 0), (5, "q", 10, "", 0), (6, "p", 500, "", 0), (7, "p", -250, "", 0)]
    changes = [("p", 10, 2, "a"), ("p", 10, 1, "b"), ("p", 10, 2, "a"), ("p", 450, 1, None), (None, 1, 9, ""), ("p", None, 99, ""), ("p", -300, 0, "")]
    assert seen(spark, events, changes) == {1: (2, 2), 2: (1, 0), 6: (3, 2), 7: (1, 0)}


def test_versions_empty(spark):
    assert seen(spark, [], [("p", 1, 1, "")]) == {}
    assert seen(spark, [(1, "p", 1, "", 0)], []) == {}


def test_versions_random_against_brute_force(spark):
    r = random.Random(1)
    changes = [(r.choice("aab"), r.randrange(-50, 400), r.randrange(50), "") for _ in range(120)]
    events = [(i, r.choice("aaac"), r.randrange(-60, 500), "", 0) for i in range(300)]
    want = {}
    for i, k, t, *_ in events:
        before = [(ct, s) for ck, ct, s, _ in changes if ck == k and ct <= t]
        if before:
            want[i] = (len({ct for ct, _ in before}), max(s for _, s in before))
    assert seen(spark, events, changes, bucket=37) == want


def sessions(spark, rows, gap=1800, bucket=3600):
    df = spark.createDataFrame(rows, "name string, ts long, b int, up int, n string")
    return sorted((r.name, r.session_no, r.start_s, r.end_s, r.duration_s, r.n_events) for r in sessionize(df, key="name", time="ts", gap_s=gap, bucket_s=bucket).collect())


def test_sessions_edges(spark):
    """1,800 s stays together, 1,801 s splits; ties, repeated rows, nulls, one event, clashing names."""
    rows = [("a", 0, 1, 1, ""), ("a", 1800, 1, 1, ""), ("a", 3601, 1, 1, ""), ("a", 3601, 1, 1, ""), ("b", 7, 1, 1, ""), (None, 7, 1, 1, ""), ("b", None, 1, 1, ""), ("", 9, 0, 0, None)]
    assert sessions(spark, rows) == [("", 1, 9, 9, 0, 1), ("a", 1, 0, 1800, 1800, 2), ("a", 2, 3601, 3601, 0, 2), ("b", 1, 7, 7, 0, 1)]
    assert sessions(spark, []) == []


def test_sessions_random_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("aaaaab"), r.randrange(-20_000, 60_000), 0, 0, "") for _ in range(400)]
    want = []
    for k in "ab":
        no, run = 0, []
        for t in sorted(t for n, t, *_ in rows if n == k) + [10**9]:
            if run and t - run[-1] > 300:
                no += 1
                want.append((k, no, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
    assert sessions(spark, rows, gap=300, bucket=1000) == sorted(want)


@pytest.mark.parametrize(("text", "want"), [("2024-02-07T10:46:33Z", 1707302793), ("2024-02-07T12:46:33+02:00", 1707302793), ("2024-02-07 10:46:33Z", 1707302793), ("2024-02-07T05:46:33-0500", 1707302793), ("2024-02-07 10:46:33", 1707302793), ("soon", None), ("", None), (None, None)])
def test_iso(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(times.iso_seconds(F.col("x"))).first()[0] == want


def test_whole_seconds_and_wall_time(spark):
    df = spark.sql("SELECT 1706915278999 AS a, 1706915278 AS b, CAST(NULL AS bigint) AS c, TIMESTAMP_NTZ'2024-02-02 23:07:58.5' AS w")
    row = df.select(times.whole_seconds(F.col("a")), times.whole_seconds(F.col("b")), times.whole_seconds(F.col("c")), times.wall_micros(F.col("w")), times.ceil_seconds(times.wall_micros(F.col("w")))).first()
    assert tuple(row) == (1706915278, 1706915278, None, 1706915278500000, 1706915279)
