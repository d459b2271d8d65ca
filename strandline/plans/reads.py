"""Queries over read requests: hours, peaks, classes, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators import windows
from strandline.operators.band import asof_backward
from strandline.operators.exposure import running_total
from strandline.operators.rows import once
from strandline.sources.tables import table


def reads(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per read with the columns asked for, and t in whole seconds."""
    return once(table(spark, sf, "reads"), "read_id", {c: F.col(c) for c in columns} | {"t": times.whole_seconds(F.col("ts"))}, prefer=times.wall_micros(F.col("logged_at")))


def page_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each page and hour: unnamed, named, attributed."""
    r = reads(spark, sf, "name", "traj_id", "page_key", "cls").where("page_key IS NOT NULL AND t IS NOT NULL AND cls IN ('browse', 'diff')")
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return r.groupBy("page_key", (F.floor(F.col("t") / 3600) * 3600).alias("hour_s")).agg(F.count_if(~named).alias("unnamed"), F.count_if(named).alias("named"), F.count_if(F.col("traj_id").isNotNull()).alias("attributed"))


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each class and action, with the names and pages behind them."""
    return reads(spark, sf, "cls", "action", "name", "page_key").groupBy("cls", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"), F.countDistinct("page_key").alias("n_pages"))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The most reads of a name in any 60 seconds, and the most families in any 10 minutes."""
    r = reads(spark, sf, "name", "family").where("name <> ''")
    return windows.peak_count(r, by=["name"], time="t", span_s=60).join(windows.peak_distinct(r, by=["name"], time="t", value="family", span_s=600).withColumnRenamed("peak", "peak_families"), "name", "left").select("name", "peak", F.coalesce("peak_families", F.lit(0)).alias("peak_families"))


def since_first(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from each writer's first edit to each of their reads, summed up."""
    first = once(table(spark, sf, "edits"), "rev", {"traj_id": F.col("profile_id"), "t0": times.iso_seconds(F.col("time"))}).where("traj_id IS NOT NULL").groupBy("traj_id").agg(F.min("t0").alias("t0"))
    r = reads(spark, sf, "traj_id").where("traj_id IS NOT NULL AND t IS NOT NULL").join(first, "traj_id")
    return r.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("t") - F.col("t0")).alias("least_s"), F.max(F.col("t") - F.col("t0")).alias("most_s"), F.count_if(F.col("t") < F.col("t0")).alias("n_before"))


def top_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty pages read most; of equals the least key."""
    return reads(spark, sf, "page_key").where("page_key IS NOT NULL").groupBy("page_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "page_key").limit(30)


def never_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that were read but have no revision."""
    known = table(spark, sf, "edits").select("page_key").distinct()
    return reads(spark, sf, "page_key").where("page_key IS NOT NULL").join(known, "page_key", "left_anti").groupBy("page_key").agg(F.count(F.lit(1)).alias("n"))


def last_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's revisions cut before every deletion, numbered from 1."""
    e = once(table(spark, sf, "edits"), "rev", {"page_key": F.col("page_key"), "t": times.iso_seconds(F.col("time"))})
    d = table(spark, sf, "page_events").where("event_type = 'delete'").select("page_key", times.iso_seconds(F.col("time")).alias("t")).distinct()
    # Deletions of a page up to the second before a revision, counted as-of: a hot page's revisions are never put in order.
    total = running_total(d.withColumn("n", F.lit(1)), by="page_key", at="t", value="n").withColumnRenamed("t", "at")
    e = e.where("page_key IS NOT NULL AND t IS NOT NULL")
    before = asof_backward(e.select("rev", "page_key", (F.col("t") - 1).alias("just_before")), total, key="page_key", left_id="rev", left_time="just_before", right_time="at", values={"n_cuts": F.col("total")})
    return e.join(before.select("rev", "n_cuts"), "rev", "left").groupBy("page_key", (F.coalesce("n_cuts", F.lit(0)) + 1).alias("part")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "reads_page_hours": page_hours, "reads_class_counts": class_counts, "reads_peaks": peaks, "reads_since_first": since_first, "reads_top_pages": top_pages, "reads_never_edited": never_edited,
    "pages_last_cuts": last_cuts,
}

_R = "WITH r AS (SELECT *, CASE WHEN abs(ts) > 100000000000 THEN ts // 1000 ELSE ts END AS t FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY logged_at) AS rn FROM reads) WHERE rn = 1)"
_RE = _R + ", e AS (SELECT DISTINCT ON (rev) *, epoch_us(CAST(time AS TIMESTAMPTZ)) // 1000000 AS t FROM edits)"

ORACLE = {
    "reads_page_hours": _R + " SELECT page_key, t // 3600 * 3600 AS hour_s, count(*) FILTER (coalesce(name, '') = '') AS unnamed, count(*) FILTER (coalesce(name, '') <> '') AS named, count(*) FILTER (traj_id IS NOT NULL) AS attributed FROM r WHERE page_key IS NOT NULL AND t IS NOT NULL AND cls IN ('browse', 'diff') GROUP BY 1, 2",
    "reads_class_counts": _R + " SELECT cls, action, count(*) AS n, count(DISTINCT name) AS n_names, count(DISTINCT page_key) AS n_pages FROM r GROUP BY 1, 2",
    "reads_peaks": _R + """, x AS (SELECT * FROM r WHERE name <> '' AND t IS NOT NULL), p AS (SELECT name, count(*) OVER (PARTITION BY name ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM x),
d AS (SELECT a.name, a.t, count(DISTINCT b.family) AS n FROM (SELECT DISTINCT name, t FROM x WHERE family IS NOT NULL) a JOIN x b ON a.name = b.name AND b.t BETWEEN a.t - 599 AND a.t GROUP BY 1, 2), m AS (SELECT name, max(n) AS n FROM d GROUP BY 1)
SELECT p.name, max(p.n) AS peak, coalesce(any_value(m.n), 0) AS peak_families FROM p LEFT JOIN m USING (name) GROUP BY 1""",
    "reads_since_first": _RE + ", f AS (SELECT profile_id, min(t) AS t0 FROM e WHERE profile_id IS NOT NULL GROUP BY 1) SELECT traj_id, count(*) AS n, min(r.t - t0) AS least_s, max(r.t - t0) AS most_s, count(*) FILTER (r.t < t0) AS n_before FROM r JOIN f ON f.profile_id = r.traj_id WHERE r.t IS NOT NULL GROUP BY 1",
    "reads_top_pages": _R + " SELECT page_key, count(*) AS n FROM r WHERE page_key IS NOT NULL GROUP BY 1 ORDER BY n DESC, page_key LIMIT 30",
    "reads_never_edited": _R + " SELECT page_key, count(*) AS n FROM r WHERE page_key IS NOT NULL AND page_key NOT IN (SELECT page_key FROM edits WHERE page_key IS NOT NULL) GROUP BY 1",
    "pages_last_cuts": "WITH e AS (SELECT DISTINCT ON (rev) *, epoch_us(CAST(time AS TIMESTAMPTZ)) // 1000000 AS t FROM edits), d AS (SELECT DISTINCT page_key, epoch_us(CAST(time AS TIMESTAMPTZ)) // 1000000 AS t FROM page_events WHERE event_type = 'delete'), x AS (SELECT e.rev, e.page_key, 1 + count(d.t) AS part FROM e LEFT JOIN d ON d.page_key = e.page_key AND d.t < e.t GROUP BY 1, 2) SELECT page_key, part, count(*) AS n FROM x GROUP BY 1, 2",
}
