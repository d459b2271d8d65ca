"""The general training-data problems over the project's tables: p1 and p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators.rows import once
from strandline.operators.sessions import sessionize
from strandline.operators.versions import attributes_at
from strandline.sources.tables import table


def reads_once(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """(read_id, ts, column) of each read, sent again or not; ts in whole seconds."""
    reads = table(spark, sf, "reads").where(F.col(column).isNotNull() & F.col("ts").isNotNull())
    return once(reads, "read_id", {"ts": times.whole_seconds(F.col("ts")), column: F.col(column)}, prefer=times.wall_micros(F.col("logged_at")))


def page_changes(spark: SparkSession, sf: str) -> DataFrame:
    """(page_key, t, seq, saved, deleted): what becomes known of a page, and from which second on."""
    edits = table(spark, sf, "edits")
    saved = times.iso_micros(F.col("time"))
    shown = F.greatest(saved, F.coalesce(times.wall_micros(F.col("known_at")), saved))
    revisions = edits.where(F.col("seq").isNotNull()).select("page_key", times.ceil_seconds(shown).alias("t"), "seq", saved.alias("saved"), F.lit(None).cast("bigint").alias("deleted"))
    events = table(spark, sf, "page_events").where(F.col("event_type") == "delete")
    at = times.iso_micros(F.col("time"))
    deletes = events.select("page_key", times.ceil_seconds(at).alias("t"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("bigint").alias("saved"), at.alias("deleted"))
    return revisions.unionByName(deletes)


def p1_seen(spark: SparkSession, sf: str) -> DataFrame:
    """(read_id, page_key, ts, version, seen, deleted): the page's state as known at each read's second."""
    state = attributes_at(
        reads_once(spark, sf, "page_key"), page_changes(spark, sf),
        entity="page_key", event_id="read_id", event_time="ts", change_time="t",
        running_max={"latest": F.when(F.col("seq").isNotNull(), F.struct("seq", "saved")), "deleted_at": F.col("deleted")},
    )
    gone = F.coalesce(F.col("deleted_at") > F.col("latest.saved"), F.lit(False))
    return state.where(F.col("latest").isNotNull()).select("read_id", "page_key", "ts", "version", F.col("latest.seq").alias("seen"), gone.alias("deleted"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(read_id, seen): the revision that each read could see, if there was one."""
    return p1_seen(spark, sf).where(~F.col("deleted")).select("read_id", "seen")


def p3_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """(name, session_no, start_s, end_s, duration_s, n_events) of the reads of each name."""
    reads = reads_once(spark, sf, "name").where(F.col("name") != "")
    return sessionize(reads, key="name", time="ts")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """(name, start_s, end_s) of each session."""
    return p3_sessions(spark, sf).select("name", "start_s", "end_s")


QUERIES = {"p1_found": p1_found, "p1_seen": p1_seen, "p3_found": p3_found, "p3_sessions": p3_sessions}

_READS = """
WITH r AS (
  SELECT read_id, {col}, CASE WHEN abs(ts) > 100000000000 THEN ts // 1000 ELSE ts END AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY logged_at) AS rn FROM reads WHERE ts IS NOT NULL AND {col} IS NOT NULL)
  WHERE rn = 1)"""

_P1 = _READS.format(col="page_key") + """,
e AS (
  SELECT DISTINCT page_key, seq, epoch_us(CAST(time AS TIMESTAMPTZ)) AS saved,
         greatest(epoch_us(CAST(time AS TIMESTAMPTZ)), coalesce(epoch_us(known_at), 0)) AS shown
  FROM edits),
s AS (
  SELECT r.read_id, r.page_key, r.ts, max(e.seq) AS seen, arg_max(e.saved, e.seq) AS saved
  FROM r JOIN e ON e.page_key = r.page_key AND e.shown <= r.ts * 1000000 GROUP BY ALL),
d AS (SELECT DISTINCT page_key, epoch_us(CAST(time AS TIMESTAMPTZ)) AS at FROM page_events WHERE event_type = 'delete'),
x AS (
  SELECT s.*, EXISTS (SELECT 1 FROM d WHERE d.page_key = s.page_key AND d.at > s.saved AND d.at <= s.ts * 1000000) AS deleted FROM s)
"""

_P3 = _READS.format(col="name") + """,
g AS (SELECT name, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY name ORDER BY ts) <= 1800 THEN 0 ELSE 1 END AS new FROM r WHERE name <> ''),
n AS (SELECT name, ts, sum(new) OVER (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT read_id, seen FROM x WHERE NOT deleted",
    "p1_seen": _P1 + """, ch AS (SELECT e.page_key, CAST(-floor(-e.shown / 1e6) AS BIGINT) AS t FROM e WHERE seq IS NOT NULL UNION SELECT d.page_key, CAST(-floor(-d.at / 1e6) AS BIGINT) FROM d)
SELECT x.read_id, x.page_key, x.ts, (SELECT count(*) FROM ch WHERE ch.page_key = x.page_key AND ch.t <= x.ts) AS version, seen, deleted FROM x""",
    "p3_found": _P3 + "SELECT name, min(ts) AS start_s, max(ts) AS end_s FROM n GROUP BY name, session_no",
    "p3_sessions": _P3 + "SELECT name, CAST(session_no AS BIGINT) AS session_no, min(ts) AS start_s, max(ts) AS end_s, max(ts) - min(ts) AS duration_s, count(*) AS n_events FROM n GROUP BY name, session_no",
}
