"""Queries over the events table: sessions, exposure, as-of joins, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators import band, exposure, matching, stats, windows
from strandline.operators.lineage import durable
from strandline.operators.sessions import sessionize
from strandline.sources.tables import table

#: Exposure counts for half an hour; strata are six hours.
EXPOSURE_S, STRATUM_S = 1_800, 21_600
#: Spans of the exposure windows that are compared.
WINDOWS_S = (600, 1_800, 3_600)
#: Shuffles of a permutation test, and trials of its calibration.
SHUFFLES, TRIALS = 2_000, 20


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events with t in epoch seconds."""
    return table(spark, sf, "events").withColumn("t", F.floor(times.wall_micros(F.col("ts")) / 1_000_000).cast("bigint"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user."""
    return sessionize(events(spark, sf), key="user_id", time="t")


def session_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Most events, and most different types, of a user in any hour."""
    e = events(spark, sf)
    return windows.peak_count(e, by=["user_id"], time="t", span_s=3600).join(
        windows.peak_distinct(e, by=["user_id"], time="t", value="event_type", span_s=3600).withColumnRenamed("peak", "peak_types"), "user_id")


def type_hours(spark: SparkSession, sf: str) -> DataFrame:
    """A10: events of each hour, counted by kind in one pass."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events(spark, sf).groupBy((F.floor(F.col("t") / 3600) * 3600).alias("hour_s")).agg(
        kind("view").alias("views"), kind("click").alias("clicks"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("gains"), F.count(F.lit(1)).alias("n"))


def first_use(spark: SparkSession, sf: str) -> DataFrame:
    """The first purchase of each user."""
    e = events(spark, sf).where("event_type = 'purchase'")
    return e.groupBy("user_id").agg(F.min(F.struct("t", "event_id")).alias("m"), F.count(F.lit(1)).alias("n_purchases")).select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.t").alias("t"), "n_purchases")


def at_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Rows up to and including each user's first purchase."""
    return stats.at_risk(events(spark, sf), agent="user_id", time="t", outcome=F.col("event_type") == "purchase", tie="event_id").select("event_id", "user_id", "t", "event_type")


def exposure_rows(spark: SparkSession, sf: str, lo: int = -EXPOSURE_S, hi: int = -1) -> DataFrame:
    """At-risk rows with ``exposed``: an error of another user in [t + lo, t + hi]: the half hour before."""
    e = events(spark, sf)
    rows = stats.at_risk(e, agent="user_id", time="t", outcome=F.col("event_type") == "purchase", tie="event_id").select(F.col("event_id").alias("__row"), "user_id", "t", "event_type")
    near = exposure.agents_within(rows.select("__row", "user_id", "t"), e.where("event_type = 'error'").select("user_id", "t"), point_id="__row", agent="user_id", time="t", lo=lo, hi=hi)
    return rows.join(near, "__row", "left").select(F.col("__row").alias("event_id"), "user_id", "t", F.coalesce(F.col("others") > 0, F.lit(False)).alias("exposed"), (F.col("event_type") == "purchase").alias("bought"), F.floor(F.col("t") / STRATUM_S).alias("stratum"))


def exposure_strata(spark: SparkSession, sf: str) -> DataFrame:
    """The 2x2 counts of each six-hour stratum."""
    return stats.strata_counts(exposure_rows(spark, sf), stratum=["stratum"], exposed="exposed", outcome="bought")


def exposure_mh(spark: SparkSession, sf: str) -> DataFrame:
    """Does an error nearby go with buying? Stratified odds ratio with its interval."""
    mh = stats.mantel_haenszel(exposure_strata(spark, sf))
    return mh.select("n_strata", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")])


def exposure_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same for windows of 10 minutes, half an hour and an hour before, and after as a placebo, in strata of six hours and of the day's user group."""
    out = []
    for span in WINDOWS_S:
        for side, lo, hi in (("past", -span, -1), ("future", 1, span)):
            rows = durable(exposure_rows(spark, sf, lo, hi).withColumn("group", F.pmod("user_id", F.lit(3))))
            for name, stratum in (("hours", ["stratum"]), ("hours and group", ["stratum", "group"])):
                mh = stats.mantel_haenszel(stats.strata_counts(rows, stratum=stratum, exposed="exposed", outcome="bought"))
                out.append(mh.select(F.lit(side).alias("side"), F.lit(span).alias("span_s"), F.lit(name).alias("strata"), "n_strata", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")]))
    return reduce(DataFrame.unionByName, out)


def asof_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of the user at or before each view."""
    e = events(spark, sf)
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("t_buy"), F.col("event_id").alias("buy"))
    return band.asof_backward(e.where("event_type = 'view'"), buys, key="user_id", left_id="event_id", left_time="t", right_time="t_buy", values={"buy": F.col("buy")})


def asof_not_after_error(spark: SparkSession, sf: str) -> DataFrame:
    """Views whose user's last purchase isn't followed by an error before the view."""
    e = events(spark, sf)
    errors = e.where("event_type = 'error'").select("user_id", F.col("t").alias("t_error"))
    last_error = band.asof_backward(e.where("event_type = 'view'"), errors, key="user_id", left_id="event_id", left_time="t", right_time="t_error", values={"x": F.col("t_error")})
    return asof_purchase(spark, sf).join(last_error.select("event_id", "t_error"), "event_id", "left").where("t_error IS NULL OR t_error <= t_buy").select("event_id", "user_id", "buy")


def purchase_session(spark: SparkSession, sf: str) -> DataFrame:
    """The session of each purchase."""
    e = events(spark, sf)
    return band.interval_lookup(e.where("event_type = 'purchase'"), sessions(spark, sf), on="user_id", time="t", start="start_s", end="end_s", point_id="event_id", values={"session_no": F.col("session_no"), "n_events": F.col("n_events")}).select("event_id", "user_id", "session_no", "n_events")


def nearest_error(spark: SparkSession, sf: str) -> DataFrame:
    """The gap from each purchase to the nearest error of another user within ten minutes before and after; -1 where there is none."""
    e = events(spark, sf)
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("other"), F.col("t").alias("t_error"))
    near = band.band_join(buys, errors, on=[], left_time="t", right_time="t_error", lo=-600, hi=600).where("other <> user_id")
    return near.groupBy("event_id").agg(
        F.coalesce(F.min(F.when(F.col("t_error") < F.col("t"), F.col("t") - F.col("t_error"))), F.lit(-1)).alias("before_s"), F.coalesce(F.min(F.when(F.col("t_error") > F.col("t"), F.col("t_error") - F.col("t"))), F.lit(-1)).alias("after_s"))


def type_switches(spark: SparkSession, sf: str) -> DataFrame:
    """How often each user turns to another type of event."""
    return windows.switches(events(spark, sf), agent="user_id", time="t", tie="event_id", value="event_type").select("user_id", "n_events", "n_switches", "n_new")


def dominant_type(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest type of each user and its share."""
    return stats.ordered_mode(events(spark, sf), by="user_id", value="event_type", first="event_id").select("user_id", "event_type", "n", F.round("purity", 6).alias("purity"))


def loo_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Can an event's type tell its user from the others active on that day? Leave-one-out."""
    e = events(spark, sf).withColumn("day", F.floor(F.col("t") / 86_400))
    credit = stats.leave_one_out(e, row="event_id", group="day", candidate="user_id", trait="event_type")
    return credit.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("credit"), 6).alias("accuracy"))


def props(spark: SparkSession, sf: str) -> DataFrame:
    """a key of the JSON column, and the column written anew."""
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k")).where("k IS NOT NULL")


def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's log folded to its last value of each field; a signup clears what was before."""
    e = events(spark, sf).withColumn("spent", F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("seen", F.when(F.col("event_type") == "view", F.col("event_id")))
    folded = matching.latest_fields(e, key="user_id", time="t", seq="event_id", fields=["spent", "seen"], cleared=F.col("event_type") == "signup")
    return folded.select("user_id", F.coalesce(F.round("spent", 6), F.lit(-1.0)).alias("spent"), F.coalesce("seen", F.lit(-1)).alias("seen"))


def three_medians(spark: SparkSession, sf: str) -> DataFrame:
    """The interpolated median, the upper one and the lower quartile's element, per type."""
    e = events(spark, sf).where("value IS NOT NULL")
    n = F.col("n")
    half = {"low": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1, "quarter": F.floor(n / 4) + 1}
    at = stats.at_ranks(e, by="event_type", value="value", ranks=half)
    return at.select("event_type", F.round((F.col("low") + F.col("upper")) / 2, 6).alias("median"), F.round("upper", 6).alias("upper"), F.round("quarter", 6).alias("quarter"))


def _items(e: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, stratum, user_id, event_type, n, types): each user's n events of a type in a day, with what the next user of the day did, by id and around: under three types, or the row is left out; so it is where nobody else was there.

    A user's day is one row with a count for each type; the next one is a window over the day's users.
    """
    e = e.where("user_id IS NOT NULL AND event_type IS NOT NULL").withColumn("stratum", F.col("day") if "day" in e.columns else F.floor(F.col("t") / 86_400))
    each = e.groupBy(*by, "stratum", "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    users = each.groupBy(*by, "stratum", "user_id").agg(F.collect_list(F.struct("event_type", "n")).alias("own"))
    day, user = Window.partitionBy(*by, "stratum").orderBy("user_id"), F.struct("user_id", F.col("own.event_type").alias("types"))
    mates = users.withColumn("next", F.coalesce(F.lead(user).over(day), F.first(user).over(day))).where((F.col("next.user_id") != F.col("user_id")) & (F.size("next.types") < 3))
    return mates.select(*by, "stratum", "user_id", "next.types", F.inline("own")).select(*by, "stratum", "user_id", "event_type", "n", "types")


def permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Do users' types agree with their neighbour's of the day beyond chance? 2,000 shuffles within days."""
    return stats.permutation_test(_items(events(spark, sf)), item="user_id", stratum="stratum", own="event_type", visible="types", weight="n", reps=SHUFFLES)


def _dealt(e: DataFrame, trials: int) -> DataFrame:
    """(trial, day, event_id, user_id, t, event_type): e once for each trial, 0 as it is, in others the types dealt anew within the day.

    The event in place k by the order of a keyed hash gets the k-th of the day's types, which are kept as counts.
    Rows are shuffled by day before they are multiplied, and not again.
    """
    e = e.select("event_id", "user_id", "t", "event_type", F.floor(F.col("t") / 86_400).alias("day"))
    counts = e.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("c"))
    upto = F.transform("c", lambda x, i: F.struct(x["event_type"].alias("event_type"), F.aggregate(F.slice("c", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda total, y: total + y["n"]).alias("upto")))
    each = e.repartition("day").join(counts.select("day", upto.alias("types")), "day").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    place = F.row_number().over(Window.partitionBy("trial", "day").orderBy(F.xxhash64("trial", "event_id"), "event_id"))
    new = F.get(F.filter("types", lambda x: x["upto"] >= F.col("place")), F.lit(0))["event_type"]
    return each.withColumn("place", place).select("trial", "day", "event_id", "user_id", "t", F.when(F.col("trial") == 0, F.col("event_type")).otherwise(new).alias("event_type"))


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The same test's ratio beside those of 20 trials in which the types were dealt anew within days, 2,000 shuffles each: median, range and p."""
    items = _items(_dealt(events(spark, sf), TRIALS), by=("trial",))
    tests = stats.permutation_test(items, item="user_id", stratum="stratum", own="event_type", visible="types", weight="n", reps=SHUFFLES, by="trial")
    return stats.calibrated(tests, trial="trial")


def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Views followed by a click within ten minutes against those with another user's click: excess with its interval."""
    e = events(spark, sf)
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("__row"), "user_id", "t")
    near = exposure.agents_within(views, e.where("event_type = 'click'").select("user_id", "t"), point_id="__row", agent="user_id", time="t", lo=0, hi=600)
    rows = views.join(near, "__row").select("user_id", F.col("own").alias("hit"), (F.col("others") > 0).cast("int").alias("decoy"))
    return stats.cluster_bootstrap(rows, cluster="user_id", hit="hit", decoy="decoy")


QUERIES = {
    "events_sessions": sessions, "events_session_peaks": session_peaks, "events_type_hours": type_hours, "events_first_use": first_use, "events_at_risk": at_risk, "events_exposure_strata": exposure_strata,
    "events_exposure_mh": exposure_mh, "events_exposure_windows": exposure_windows, "events_asof": asof_purchase, "events_asof_anti": asof_not_after_error, "events_interval_session": purchase_session, "events_nearest_error": nearest_error,
    "events_switches": type_switches, "events_dominant_type": dominant_type, "events_loo_accuracy": loo_accuracy, "events_props": props, "events_latest_state": latest_state, "events_three_medians": three_medians,
    "events_permutation": permutation, "events_calibration": calibration, "events_bootstrap": bootstrap,
}

_E = "WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"
_RISK = _E + """,
f AS (SELECT user_id, min((t, event_id)) AS m FROM e WHERE event_type = 'purchase' GROUP BY 1),
k AS (SELECT e.* FROM e LEFT JOIN f USING (user_id) WHERE f.m IS NULL OR (e.t, e.event_id) <= f.m)"""
_STRATA = _RISK + """,
x AS (SELECT k.event_id, k.t // 21600 AS stratum, k.event_type = 'purchase' AS y,
             EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'error' AND o.user_id <> k.user_id AND o.t BETWEEN k.t - 1800 AND k.t - 1) AS ex FROM k),
s AS (SELECT stratum, count(*) FILTER (ex AND y) AS a, count(*) FILTER (ex AND NOT y) AS b, count(*) FILTER (NOT ex AND y) AS c, count(*) FILTER (NOT ex AND NOT y) AS d FROM x GROUP BY 1)"""
_SESS = _E + """,
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS new FROM e),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
s AS (SELECT user_id, session_no, min(t) AS start_s, max(t) AS end_s, max(t) - min(t) AS duration_s, count(*) AS n_events FROM n GROUP BY 1, 2)"""

def _window_sql(side: str, span: int, name: str) -> str:
    lo, hi = (f"k.t - {span}", "k.t - 1") if side == "past" else ("k.t + 1", f"k.t + {span}")
    by = "k.t // 21600" if name == "hours" else "(k.t // 21600) * 3 + k.user_id % 3"
    return f"""SELECT '{side}' AS side, {span} AS span_s, '{name}' AS strata, count(*) AS n_strata, sum(a * d / n) AS r, sum(b * c / n) AS q, sum((a + d) / n * (a * d / n)) AS pr, sum((a + d) / n * (b * c / n) + (b + c) / n * (a * d / n)) AS mixed, sum((b + c) / n * (b * c / n)) AS qs FROM (
SELECT *, a + b + c + d AS n FROM (SELECT z, count(*) FILTER (ex AND y) AS a, count(*) FILTER (ex AND NOT y) AS b, count(*) FILTER (NOT ex AND y) AS c, count(*) FILTER (NOT ex AND NOT y) AS d FROM (
SELECT {by} AS z, k.event_type = 'purchase' AS y, EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'error' AND o.user_id <> k.user_id AND o.t BETWEEN {lo} AND {hi}) AS ex FROM k) GROUP BY 1)) WHERE n >= 2 AND a + b > 0 AND c + d > 0"""


ORACLE = {
    "events_exposure_windows": _RISK + ", v AS (" + " UNION ALL ".join(_window_sql(side, span, name) for span in WINDOWS_S for side in ("past", "future") for name in ("hours", "hours and group")) + """),
w AS (SELECT *, r / nullif(q, 0) AS o, exp(1.96 * sqrt(pr / (2 * r * r) + mixed / (2 * r * q) + qs / (2 * q * q))) AS h FROM v)
SELECT side, span_s, strata, n_strata, coalesce(round(o, 6), -1) AS odds_ratio, coalesce(round(o / h, 6), -1) AS ci_low, coalesce(round(o * h, 6), -1) AS ci_high FROM w""",
    "events_sessions": _SESS + " SELECT * FROM s",
    "events_session_peaks": _E + """,
p AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM e),
d AS (SELECT a.user_id, a.t, count(DISTINCT b.event_type) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 3599 AND a.t GROUP BY 1, 2)
SELECT p.user_id, max(p.n) AS peak, any_value(q.n) AS peak_types FROM p JOIN (SELECT user_id, max(n) AS n FROM d GROUP BY 1) q USING (user_id) GROUP BY 1""",
    "events_type_hours": _E + " SELECT t // 3600 * 3600 AS hour_s, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type IN ('purchase', 'signup')) AS gains, count(*) AS n FROM e GROUP BY 1",
    "events_first_use": _E + " SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t, count(*) AS n_purchases FROM e WHERE event_type = 'purchase' GROUP BY 1",
    "events_at_risk": _RISK + " SELECT event_id, user_id, t, event_type FROM k",
    "events_exposure_strata": _STRATA + " SELECT * FROM s",
    "events_exposure_mh": _STRATA + """,
u AS (SELECT *, a + b + c + d AS n FROM s WHERE a + b + c + d >= 2 AND a + b > 0 AND c + d > 0),
v AS (SELECT count(*) AS n_strata, sum(a * d / n) AS r, sum(b * c / n) AS q, sum((a + d) / n * (a * d / n)) AS pr, sum((a + d) / n * (b * c / n) + (b + c) / n * (a * d / n)) AS mixed, sum((b + c) / n * (b * c / n)) AS qs FROM u),
w AS (SELECT n_strata, r / q AS o, exp(1.96 * sqrt(pr / (2 * r * r) + mixed / (2 * r * q) + qs / (2 * q * q))) AS h FROM v)
SELECT n_strata, round(o, 6) AS odds_ratio, round(o / h, 6) AS ci_low, round(o * h, 6) AS ci_high FROM w""",
    "events_asof": _E + ", b AS (SELECT user_id, t AS t_buy, max(event_id) AS buy FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT v.event_id, v.user_id, v.t, b.t_buy, b.buy FROM (SELECT * FROM e WHERE event_type = 'view') v ASOF JOIN b ON v.user_id = b.user_id AND v.t >= b.t_buy",
    "events_asof_anti": _E + """, b AS (SELECT user_id, t AS t_buy, max(event_id) AS buy FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
x AS (SELECT v.event_id, v.user_id, v.t, b.t_buy, b.buy FROM (SELECT * FROM e WHERE event_type = 'view') v ASOF JOIN b ON v.user_id = b.user_id AND v.t >= b.t_buy)
SELECT event_id, user_id, buy FROM x WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'error' AND r.user_id = x.user_id AND r.t > x.t_buy AND r.t <= x.t)""",
    "events_interval_session": _SESS + " SELECT e.event_id, e.user_id, s.session_no, s.n_events FROM e JOIN s ON s.user_id = e.user_id AND e.t BETWEEN s.start_s AND s.end_s WHERE e.event_type = 'purchase'",
    "events_nearest_error": _E + " SELECT b.event_id, coalesce(min(CASE WHEN r.t < b.t THEN b.t - r.t END), -1) AS before_s, coalesce(min(CASE WHEN r.t > b.t THEN r.t - b.t END), -1) AS after_s FROM e b JOIN e r ON r.event_type = 'error' AND r.user_id <> b.user_id AND r.t BETWEEN b.t - 600 AND b.t + 600 WHERE b.event_type = 'purchase' GROUP BY 1",
    "events_switches": _E + ", w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS last FROM e) SELECT user_id, count(*) AS n_events, count(*) FILTER (last <> event_type) AS n_switches, count(DISTINCT event_type) - 1 AS n_new FROM w GROUP BY 1",
    "events_dominant_type": _E + ", c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2) SELECT user_id, event_type, n, round(n / total, 6) AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1",
    "events_loo_accuracy": _E + """,
r AS (SELECT event_id AS r, t // 86400 AS g, user_id AS c, event_type AS f FROM e),
m AS (SELECT DISTINCT g, c AS k FROM r), many AS (SELECT g FROM m GROUP BY 1 HAVING count(*) >= 2),
bt AS (SELECT c AS k, f, count(*) AS nf FROM r GROUP BY 1, 2), tot AS (SELECT c AS k, count(*) AS n FROM r GROUP BY 1), v AS (SELECT count(DISTINCT f) AS v FROM r),
o AS (SELECT r.r, r.g, r.c, m.k, (coalesce(bt.nf, 0) - CAST(m.k = r.c AS INT) + 0.5::DOUBLE) / (tot.n - CAST(m.k = r.c AS INT) + 0.5::DOUBLE * v.v) AS score FROM r JOIN many USING (g) JOIN m USING (g) LEFT JOIN bt ON bt.k = m.k AND bt.f = r.f JOIN tot ON tot.k = m.k, v),
b AS (SELECT *, max(score) OVER (PARTITION BY r) AS best FROM o),
x AS (SELECT r, g, max(CASE WHEN k = c THEN 1.0 ELSE 0.0 END) / count(*) AS credit FROM b WHERE score = best GROUP BY 1, 2)
SELECT g AS day, count(*) AS n, round(avg(credit), 6) AS accuracy FROM x GROUP BY 1""",
    "events_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "events_latest_state": _E + """,
w AS (SELECT user_id, max((t, event_id)) AS at FROM e WHERE event_type = 'signup' GROUP BY 1),
l AS (SELECT e.* FROM e LEFT JOIN w USING (user_id) WHERE w.at IS NULL OR (e.t, e.event_id) > w.at)
SELECT u.user_id, coalesce(round(any_value(s.spent), 6), -1) AS spent, coalesce(any_value(s.seen), -1) AS seen FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN (
  SELECT user_id, arg_max(value, (t, event_id)) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS spent, arg_max(event_id, (t, event_id)) FILTER (event_type = 'view') AS seen FROM l GROUP BY 1) s USING (user_id) GROUP BY 1""",
    "events_three_medians": _E + """,
k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value IS NOT NULL)
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(max(CASE WHEN k = n // 2 + 1 THEN value END), 6) AS upper, round(max(CASE WHEN k = n // 4 + 1 THEN value END), 6) AS quarter FROM k GROUP BY 1""",
}
