"""Queries over reads and revisions together: who was behind a session, what they read beside decoys, switches, tools, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import exposure, stats, trajectories, windows
from strandline.operators.lineage import durable
from strandline.plans.behaviour import ROLES
from strandline.plans.edits import _E, CLOCKS, _when, edits, profiles
from strandline.plans.events import events
from strandline.plans.reads import _RE, reads
from strandline.sources.tables import table

#: Hours of a window, in seconds.
DAY_S, HALF_DAY_S = 86_400, 43_200


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = edits(spark, sf, "label", "profile_id").where("label IS NOT NULL AND t IS NOT NULL")
    r = reads(spark, sf, "name").where("name <> '' AND t IS NOT NULL")
    # A save is a request of the name it was made under.
    requests = r.select("name", "t").unionByName(e.select(F.col("label").alias("name"), "t"))
    saves = e.where("profile_id IS NOT NULL").select(F.col("label").alias("name"), "t", F.col("profile_id").alias("writer"))
    owners = profiles(spark, sf, "name").select("name", F.col("id").alias("writer"))
    spans = edits(spark, sf, "profile_id").where("profile_id IS NOT NULL").groupBy(F.col("profile_id").alias("writer")).agg(F.min("t").alias("first_s"), F.max("t").alias("last_s"))
    return exposure.session_evidence(requests, saves, owners=owners, labels=saves.select("name", "writer"), spans=spans)


def session_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each name with their tier, who was behind them, and what the saves in them say."""
    return _sessions(spark, sf)


def basis_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads in sessions with a verdict, by the session's basis."""
    r = reads(spark, sf, "name", "page_key").where("name <> '' AND t IS NOT NULL").select("read_id", "name", "t")
    return exposure.with_basis(r, _sessions(spark, sf), read="read_id").groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("verdict").alias("n_writers"))


def _targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = edits(spark, sf, "profile_id", "page_key").where("profile_id IS NOT NULL AND page_key IS NOT NULL AND t IS NOT NULL")
    firsts = e.groupBy(F.col("profile_id").alias("agent"), F.col("page_key").alias("page")).agg(F.min(F.struct("t", "rev")).alias("m"))
    targets = firsts.select(F.col("m.rev").alias("target_id"), "agent", "page", F.col("m.t").alias("t"))
    r = reads(spark, sf, "traj_id", "page_key").where("traj_id IS NOT NULL AND t IS NOT NULL").select(F.col("traj_id").alias("agent"), F.col("page_key").alias("page"), "t", F.lit(None).cast("string").alias("session_id"))
    families = profiles(spark, sf, "primary_family").select(F.col("id").alias("agent"), F.col("primary_family").alias("family"))
    return targets, r, families, targets.select("agent", "page")


def decoys(spark: SparkSession, sf: str) -> DataFrame:
    """Did writers read a page in the day before their first edit of it, beside other readers, readers of the family, and other pages?"""
    t, r, f, touched = _targets(spark, sf)
    rates = exposure.decoy_rates(t, r, families=f, touches=touched, window_s=DAY_S, page_window_s=DAY_S)
    return rates.select("target_id", "hit", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("reader_rate", "family_rate", "page_rate")])


def decoy_excess(spark: SparkSession, sf: str) -> DataFrame:
    """The excess of hits over each of the three decoys, with its interval over clusters of writers."""
    t, r, f, touched = _targets(spark, sf)
    rates = durable(exposure.decoy_rates(t, r, families=f, touches=touched, window_s=DAY_S, page_window_s=DAY_S))
    names = ("reader_rate", "family_rate", "page_rate")
    return reduce(DataFrame.unionByName, [stats.cluster_bootstrap(rates.where(F.col(n).isNotNull()), cluster="agent", hit="hit", decoy=n).withColumn("decoy", F.lit(n)) for n in names])


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The status of each revision made from where it is placed and what it is signed with, beside the stored one."""
    e = edits(spark, sf, "scope", "status", "profile_id", "signoff_read")
    split = profiles(spark, sf, "name", "split_part").where("split_part IS NOT NULL AND name IS NOT NULL").select(F.col("name").alias("signoff_read")).distinct().withColumn("in_split", F.lit(True))
    made = (
        F.when(F.col("profile_id").startswith("S:"), "assigned").when(F.col("profile_id").startswith("O:"), "one_off").when(F.col("scope") == "other", "out_of_scope")
        .when(F.col("signoff_read").isNull(), "unsigned").when(F.col("in_split"), "split_dropped").otherwise("signed_other")
    )
    return e.join(split, "signoff_read", "left").groupBy(made.alias("made"), "status").agg(F.count(F.lit(1)).alias("n"))


def page_named(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions on a page whose title holds the writer's name, without signs between its parts."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    e = edits(spark, sf, "page", "profile_name", "scope").where("page IS NOT NULL AND profile_name IS NOT NULL")
    part = F.regexp_extract(F.lower("profile_name"), r"([a-z]{5,})", 1)
    return e.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(bare(F.col("page")), bare(F.col("profile_name")))).alias("n_whole"), F.count_if((part != "") & F.contains(bare(F.col("page")), part)).alias("n_part"))


def _name_parts(names: DataFrame) -> DataFrame:
    """(agent, part, value) of (agent, name): role noun, place of the date, spaces, trailing X."""
    n = F.col("name")
    base, day = F.regexp_replace(n, "(?:Agent|X)$", ""), tx.MONTH_DAY_IN_NAME
    role = F.coalesce(*[F.when(n.contains(r), F.lit(r)) for r in ROLES], F.lit("none"))
    place = F.when(base.rlike(f"^{day}"), "first").when(base.rlike(f"{day}$"), "last").when(base.rlike(day), "middle").otherwise("none")
    parts = {"role": role, "date place": place, "spaced": F.when(n.contains(" "), "yes").otherwise("no"), "trailing X": F.when(n.endswith("X"), "yes").otherwise("no")}
    return names.where(n.isNotNull()).select("agent", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()])).alias("p")).select("agent", "p.*")


def name_conformity(spark: SparkSession, sf: str) -> DataFrame:
    """Do writers' names have the parts of the names that others signed on their first page, before and in the half day after?"""
    e = edits(spark, sf, "profile_id", "page_key").where("profile_id IS NOT NULL AND page_key IS NOT NULL")
    parts = _name_parts(profiles(spark, sf, "name").select(F.col("id").alias("agent"), "name"))
    items = trajectories.name_conformity(e, parts, post="rev", agent="profile_id", page="page_key", time="t", ahead_s=HALF_DAY_S)
    return items.groupBy("part", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("visible", F.col("own"))).alias("n_visible"))


def name_conformity_test(spark: SparkSession, sf: str) -> DataFrame:
    """The same against shuffles of the own parts within days, for each part and side."""
    e = edits(spark, sf, "profile_id", "page_key").where("profile_id IS NOT NULL AND page_key IS NOT NULL")
    parts = _name_parts(profiles(spark, sf, "name").select(F.col("id").alias("agent"), "name"))
    items = trajectories.name_conformity(e, parts, post="rev", agent="profile_id", page="page_key", time="t", ahead_s=HALF_DAY_S)
    items = items.withColumn("test", F.concat_ws(" ", "part", "side")).withColumn("stratum", F.floor(F.col("t") / DAY_S))
    return stats.permutation_test(items, item="profile_id", stratum="stratum", own="own", visible="visible", reps=500, by="test")


def tools(spark: SparkSession, sf: str) -> DataFrame:
    """Each reader's commonest kind of request, its share, how many it is that of, and whether the reader's sessions agree."""
    r = reads(spark, sf, "traj_id", "cls", "action").where("traj_id IS NOT NULL AND t IS NOT NULL")
    mix = trajectories.tool_mix(r, agent="traj_id", tool=F.concat_ws("|", F.coalesce("cls", F.lit("")), F.coalesce("action", F.lit(""))), time="t", request="read_id")
    return mix.select("traj_id", "tool", "n", F.round("purity", 6).alias("purity"), "n_sharing", "n_sessions", F.coalesce(F.round("same_share", 6), F.lit(-1.0)).alias("same_share"))


def switches(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of writers to a clock word they had not used, by what others' revisions of the page show half a day before and after."""
    e = edits(spark, sf, "page_key", "profile_id", "text").where("text IS NOT NULL AND profile_id IS NOT NULL AND t IS NOT NULL").withColumn("v", tx.variants(F.col("text"), CLOCKS))
    return windows.variant_switches(e, post="rev", agent="profile_id", page="page_key", time="t", variants="v", window_s=HALF_DAY_S)


def random_trait(spark: SparkSession, sf: str) -> DataFrame:
    """users' commonest types dealt anew among all users, three times: users with each type stay as many, and how many keep their own."""
    top = stats.ordered_mode(events(spark, sf), by="user_id", value="event_type", first="event_id").select("user_id", "event_type")
    dealt = windows.dealt_trait(top, agent="user_id", trait="event_type", reps=3)
    both = dealt.join(top.withColumnRenamed("event_type", "own"), "user_id")
    return both.groupBy("rep", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == F.col("event_type")).alias("n_kept"))


QUERIES = {
    "reads_session_evidence": session_evidence, "reads_by_basis": basis_reads, "reads_decoys": decoys, "reads_decoy_excess": decoy_excess, "edits_statuses": statuses, "edits_page_named": page_named, "writers_name_conformity": name_conformity,
    "writers_name_conformity_test": name_conformity_test, "readers_tools": tools, "edits_switches": switches, "events_random_trait": random_trait,
}

_GENERIC = r"(contains(name, ' ') OR regexp_matches(name, '^(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\d{1,2}$'))"
_EVIDENCE = _RE + f""",
q AS (SELECT name, t FROM r WHERE name <> '' AND t IS NOT NULL UNION ALL SELECT label, t FROM e WHERE label IS NOT NULL AND t IS NOT NULL),
sv AS (SELECT label AS name, t, profile_id AS w FROM e WHERE label IS NOT NULL AND profile_id IS NOT NULL AND t IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY name ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS new FROM q),
nn AS (SELECT name, t, CAST(sum(new) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
s AS (SELECT name, session_no, min(t) AS start_s, max(t) AS end_s, count(*) AS n_events FROM nn GROUP BY 1, 2),
ow AS (SELECT DISTINCT name, id AS w FROM profiles WHERE name IS NOT NULL),
us AS (SELECT name, count(DISTINCT split_part(w, '#', 1)) AS n FROM sv GROUP BY 1),
k AS (SELECT sv.*, s.session_no, CASE WHEN EXISTS (SELECT 1 FROM ow WHERE ow.name = sv.name AND ow.w = sv.w) THEN 'own' WHEN sv.name IN (SELECT name FROM ow) THEN 'borrowed' WHEN {_GENERIC.replace('name', 'sv.name')} THEN 'generic' WHEN us.n > 1 THEN 'shared' ELSE 'private' END AS kind
  FROM sv JOIN us USING (name) JOIN s ON s.name = sv.name AND sv.t BETWEEN s.start_s AND s.end_s),
c AS (SELECT name, session_no, string_agg(kind || ':' || n, ';' ORDER BY kind) AS kinds FROM (SELECT name, session_no, kind, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL),
st AS (SELECT DISTINCT name, session_no, w FROM k WHERE kind IN ('own', 'private')),
wk AS (SELECT DISTINCT name, session_no, w FROM k WHERE kind NOT IN ('own', 'private') UNION SELECT k.name, k.session_no, ow.w FROM k JOIN ow USING (name) WHERE kind NOT IN ('own', 'private')),
n1 AS (SELECT name, session_no, count(*) AS n, min(w) AS w FROM st GROUP BY ALL),
n2 AS (SELECT wk.name, wk.session_no, count(*) AS n, count(*) FILTER (st.w IS NULL) AS extra FROM wk LEFT JOIN st ON st.name = wk.name AND st.session_no = wk.session_no AND st.w = wk.w GROUP BY ALL),
sp AS (SELECT profile_id AS w, min(t) AS a, max(t) AS z FROM e WHERE profile_id IS NOT NULL GROUP BY 1),
on1 AS (SELECT name FROM k WHERE NOT {_GENERIC} GROUP BY 1 HAVING count(DISTINCT split_part(w, '#', 1)) FILTER (kind IN ('own', 'private')) = 1 AND count(*) FILTER (kind NOT IN ('own', 'private')) = 0),
ex AS (SELECT s.name, s.session_no, min(o.w) AS w FROM s JOIN on1 USING (name) JOIN (SELECT DISTINCT name, w FROM st) o USING (name) JOIN sp ON sp.w = o.w WHERE s.start_s >= sp.a - 86400 AND s.end_s <= sp.z + 86400 GROUP BY ALL HAVING count(*) = 1),
v AS (SELECT s.name, s.session_no, start_s, end_s, n_events, coalesce(kinds, '') AS kinds,
  CASE WHEN coalesce(n1.n, 0) = 1 AND coalesce(n2.extra, 0) = 0 THEN 'session' WHEN coalesce(n1.n, 0) > 1 OR (coalesce(n1.n, 0) = 1 AND n2.extra > 0) THEN 'ambiguous' WHEN n2.n > 0 THEN 'weak' WHEN ex.w IS NOT NULL THEN 'exclusive' ELSE 'none' END AS tier, n1.w AS one, ex.w AS sole
  FROM s LEFT JOIN n1 USING (name, session_no) LEFT JOIN n2 USING (name, session_no) LEFT JOIN c USING (name, session_no) LEFT JOIN ex USING (name, session_no)),
z AS (SELECT name, session_no, start_s, end_s, n_events, tier, CASE tier WHEN 'session' THEN one WHEN 'exclusive' THEN sole END AS verdict, kinds FROM v)"""
_TARGETS = _RE + """,
tg AS (SELECT arg_min(rev, (t, rev)) AS target_id, profile_id AS a, page_key AS q, min(t) AS t FROM e WHERE profile_id IS NOT NULL AND page_key IS NOT NULL AND t IS NOT NULL GROUP BY 2, 3),
rd AS (SELECT traj_id AS a, page_key AS p, t FROM r WHERE traj_id IS NOT NULL AND t IS NOT NULL),
fm AS (SELECT id AS a, any_value(primary_family) AS f FROM profiles WHERE primary_family IS NOT NULL GROUP BY 1),
ow AS (SELECT target_id, tg.a, q, tg.t, max(CASE WHEN p = q THEN 1 ELSE 0 END) AS hit FROM tg JOIN rd ON rd.a = tg.a AND rd.t >= tg.t - 86400 AND rd.t < tg.t GROUP BY ALL),
oa AS (SELECT ow.target_id, rd.a AS o, any_value(ow.a) AS a, max(CASE WHEN rd.p = ow.q THEN 1.0 ELSE 0.0 END) AS h FROM ow JOIN rd ON rd.t >= ow.t - 86400 AND rd.t < ow.t AND rd.a <> ow.a WHERE NOT EXISTS (SELECT 1 FROM tg x WHERE x.a = rd.a AND x.q = ow.q) GROUP BY ALL),
rr AS (SELECT target_id, avg(h) AS reader_rate, avg(h) FILTER (fo.f = fa.f) AS family_rate FROM oa LEFT JOIN fm fo ON fo.a = oa.o LEFT JOIN fm fa ON fa.a = oa.a GROUP BY 1),
pg AS (SELECT DISTINCT ow.target_id, ow.a, ow.t, o.q AS p FROM ow JOIN fm fa ON fa.a = ow.a JOIN tg o ON o.a <> ow.a AND o.q <> ow.q AND o.t >= ow.t - 86400 AND o.t < ow.t + 86400 JOIN fm fo ON fo.a = o.a AND fo.f = fa.f WHERE NOT EXISTS (SELECT 1 FROM tg x WHERE x.a = ow.a AND x.q = o.q)),
pr AS (SELECT target_id, avg(CASE WHEN EXISTS (SELECT 1 FROM rd WHERE rd.a = pg.a AND rd.p = pg.p AND rd.t >= pg.t - 86400 AND rd.t < pg.t) THEN 1.0 ELSE 0.0 END) AS page_rate FROM pg GROUP BY 1)"""
_DAY = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\d{1,2}"
_PARTS = f"""np AS (SELECT id AS a, name, regexp_replace(name, '(?:Agent|X)$', '') AS base FROM (SELECT DISTINCT id, name FROM profiles) WHERE name IS NOT NULL),
pt AS (SELECT a, 'role' AS part, CASE {" ".join(f"WHEN contains(name, '{r}') THEN '{r}'" for r in ROLES)} ELSE 'none' END AS v FROM np
  UNION ALL SELECT a, 'date place', CASE WHEN regexp_matches(base, '^{_DAY}') THEN 'first' WHEN regexp_matches(base, '{_DAY}$') THEN 'last' WHEN regexp_matches(base, '{_DAY}') THEN 'middle' ELSE 'none' END FROM np
  UNION ALL SELECT a, 'spaced', CASE WHEN contains(name, ' ') THEN 'yes' ELSE 'no' END FROM np UNION ALL SELECT a, 'trailing X', CASE WHEN ends_with(name, 'X') THEN 'yes' ELSE 'no' END FROM np)"""

ORACLE = {
    "reads_session_evidence": _EVIDENCE + " SELECT * FROM z",
    "reads_by_basis": _EVIDENCE + """,
b AS (SELECT z.*, CASE WHEN kinds LIKE 'own:%' OR kinds LIKE '%;own:%' THEN 'own' WHEN coalesce(TRY_CAST(regexp_extract(kinds, '(?:^|;)private:(\\d+)', 1) AS INT), 0) >= 2 THEN 'private2' WHEN regexp_matches(kinds, '(?:^|;)private:1(?:;|$)') THEN 'private1' ELSE 'exclusive' END AS basis FROM z WHERE verdict IS NOT NULL)
SELECT basis, count(*) AS n, count(DISTINCT verdict) AS n_writers FROM r JOIN b ON b.name = r.name AND r.t BETWEEN b.start_s AND b.end_s WHERE r.name <> '' GROUP BY 1""",
    "reads_decoys": _TARGETS + " SELECT target_id, hit, coalesce(round(reader_rate, 6), -1) AS reader_rate, coalesce(round(family_rate, 6), -1) AS family_rate, coalesce(round(page_rate, 6), -1) AS page_rate FROM ow LEFT JOIN rr USING (target_id) LEFT JOIN pr USING (target_id)",
    "edits_statuses": _E + """, x AS (SELECT DISTINCT name FROM profiles WHERE split_part IS NOT NULL)
SELECT CASE WHEN profile_id LIKE 'S:%' THEN 'assigned' WHEN profile_id LIKE 'O:%' THEN 'one_off' WHEN scope = 'other' THEN 'out_of_scope' WHEN signoff_read IS NULL THEN 'unsigned' WHEN signoff_read IN (SELECT name FROM x WHERE name IS NOT NULL) THEN 'split_dropped' ELSE 'signed_other' END AS made, status, count(*) AS n FROM e GROUP BY 1, 2""",
    "edits_page_named": _E + r""", b AS (SELECT scope, regexp_replace(lower(page), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(profile_name), '[^a-z0-9]', '', 'g') AS n, regexp_extract(lower(profile_name), '([a-z]{5,})', 1) AS w FROM e WHERE page IS NOT NULL AND profile_name IS NOT NULL)
SELECT scope, count(*) AS n, count(*) FILTER (contains(p, n)) AS n_whole, count(*) FILTER (w <> '' AND contains(p, w)) AS n_part FROM b GROUP BY 1""",
    "writers_name_conformity": _E + f""", {_PARTS}, x AS (SELECT rev, profile_id AS a, page_key AS pg, t FROM e WHERE profile_id IS NOT NULL AND page_key IS NOT NULL AND t IS NOT NULL),
f AS (SELECT a, min(t) AS t, arg_min(pg, (t, rev)) AS pg FROM x GROUP BY 1), m AS (SELECT pg, arg_min(a, (t, rev, a)) AS maker FROM x GROUP BY 1),
n AS (SELECT DISTINCT f.a, CASE WHEN x.t < f.t THEN 'past' ELSE 'future' END AS side, x.a AS o FROM f JOIN m USING (pg) JOIN x USING (pg) WHERE f.a <> maker AND x.a <> f.a AND x.t <> f.t AND x.t <= f.t + 43200),
i AS (SELECT own.part, n.side, n.a, max(CASE WHEN own.v = th.v THEN 1 ELSE 0 END) AS same FROM n JOIN pt own ON own.a = n.a JOIN pt th ON th.a = n.o AND th.part = own.part GROUP BY ALL)
SELECT part, side, count(*) AS n, count(*) FILTER (same = 1) AS n_visible FROM i GROUP BY 1, 2""",
    "readers_tools": _RE + """, x AS (SELECT read_id, traj_id AS a, coalesce(cls, '') || '|' || coalesce(action, '') AS tool, t FROM r WHERE traj_id IS NOT NULL AND t IS NOT NULL),
c AS (SELECT a, tool, count(*) AS n, min((t, read_id)) AS f FROM x GROUP BY 1, 2), d AS (SELECT a, arg_min(tool, (-n, f)) AS tool, max(n) AS top, sum(n) AS n FROM c GROUP BY 1), sh AS (SELECT tool, count(*) AS n_sharing FROM d GROUP BY 1),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY a ORDER BY t, read_id) <= 1800 THEN 0 ELSE 1 END AS new FROM x), s AS (SELECT *, sum(new) OVER (PARTITION BY a ORDER BY t, read_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
big AS (SELECT a, k FROM s GROUP BY 1, 2 HAVING count(*) >= 5), sc AS (SELECT a, k, tool, count(*) AS n, min((t, read_id)) AS f FROM s JOIN big USING (a, k) GROUP BY 1, 2, 3), st AS (SELECT a, k, arg_min(tool, (-n, f)) AS tool FROM sc GROUP BY 1, 2),
sm AS (SELECT st.a, count(*) AS n_sessions, avg(CASE WHEN st.tool = d.tool THEN 1.0 ELSE 0.0 END) AS share FROM st JOIN d ON d.a = st.a GROUP BY 1)
SELECT d.a AS traj_id, d.tool, CAST(d.n AS BIGINT) AS n, round(top / d.n, 6) AS purity, n_sharing, coalesce(n_sessions, 0) AS n_sessions, CASE WHEN n_sessions >= 2 THEN round(share, 6) ELSE -1 END AS same_share FROM d JOIN sh USING (tool) LEFT JOIN sm ON sm.a = d.a""",
    "edits_switches": _E + f""", p AS (SELECT rev, page_key AS pg, profile_id AS a, t, {_when(CLOCKS)} AS vs FROM e WHERE text IS NOT NULL AND profile_id IS NOT NULL AND t IS NOT NULL), u AS (SELECT rev, pg, a, t, unnest(vs) AS v FROM p),
f AS (SELECT a, v, min((t, rev)) AS f, arg_min(pg, (t, rev)) AS pg, min(t) AS t FROM u GROUP BY 1, 2), b AS (SELECT a, min((t, rev)) AS b FROM u GROUP BY 1), w AS (SELECT f.* FROM f JOIN b USING (a) WHERE f.f > b.b),
n AS (SELECT w.a, w.v, p.t < w.t AS before, list_contains(p.vs, w.v) AS shows, len(p.vs) > 0 AS bears, g.t < w.t AS prior FROM w JOIN p ON p.pg = w.pg AND p.a <> w.a AND p.t <> w.t AND abs(p.t - w.t) <= 43200 LEFT JOIN f g ON g.a = p.a AND g.v = w.v),
s AS (SELECT a, v, max(CAST(before AND shows AS INT)) AS x1, max(CAST(NOT before AND shows AND coalesce(prior, false) AS INT)) AS x2, max(CAST(NOT before AND shows AS INT)) AS x3, max(CAST(before AS INT)) AS x4, max(CAST(NOT before AS INT)) AS x5, max(CAST(before AND bears AS INT)) AS x6, max(CAST(NOT before AND bears AS INT)) AS x7 FROM n GROUP BY 1, 2)
SELECT count(*) AS events, CAST(coalesce(sum(x1), 0) AS BIGINT) AS visible_before, CAST(coalesce(sum(x2), 0) AS BIGINT) AS visible_after_prior_users, CAST(coalesce(sum(x3), 0) AS BIGINT) AS visible_after_any_author, CAST(coalesce(sum(x4), 0) AS BIGINT) AS any_post_before, CAST(coalesce(sum(x5), 0) AS BIGINT) AS any_post_after, CAST(coalesce(sum(x6), 0) AS BIGINT) AS any_variant_post_before, CAST(coalesce(sum(x7), 0) AS BIGINT) AS any_variant_post_after FROM w LEFT JOIN s USING (a, v)""",
}
