"""Queries over writers: assembly, names, requests, conformity, views of a review board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions import times
from strandline.operators import trajectories
from strandline.plans.edits import _E, CLOCKS, _when, edits, profiles
from strandline.sources.tables import table

ROLES = ("Scout", "Observer", "Helper", "Researcher", "Agent", "Bot")


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Writers with two edits in scope or more, from their edits."""
    e = edits(spark, sf, "profile_name", "scope", "family", "page_key", "copied")
    return trajectories.assemble(e, name="profile_name", scope="scope", family="family", page="page_key", time="t", rev="rev", flag=F.col("copied") == 1).select(
        "profile_name", "n_in_scope", "n_family", "n_relay", "n_elsewhere", "n_pages", "first", "last", "span_hours", "families", F.coalesce("primary_family", F.lit("none")).alias("primary_family"), "n_flagged")


def origins(spark: SparkSession, sf: str) -> DataFrame:
    """Where the names of profiles first stand: a signoff, a label, a page title, a text, or nowhere."""
    e = edits(spark, sf, "signed_as", "label", "page", "text")
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"[A-Za-z][\w.]{2,}"), 0)).alias("w")
    named = trajectories.name_origin(profiles(spark, sf, "name"), name="name", signed=e.where("signed_as IS NOT NULL").select("signed_as"), labels=e.where("label IS NOT NULL").select("label"), titles=e.where("page IS NOT NULL").select(words("page")), texts=e.where("text IS NOT NULL").select(words("text")))
    return named.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Role noun, place of the date and form of each profile name, counted."""
    n = F.col("name")
    role = F.coalesce(*[F.when(n.contains(r), F.lit(r)) for r in ROLES], F.lit("none"))
    base = F.regexp_replace(n, "(?:Agent|X)$", "")
    date = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{1,2}"
    place = F.when(base.rlike(f"^{date}"), "first").when(base.rlike(f"{date}$"), "last").when(base.rlike(date), "middle").otherwise("none")
    return profiles(spark, sf, "name").groupBy(role.alias("role"), place.alias("date_place"), n.contains(" ").alias("spaced")).agg(F.count(F.lit(1)).alias("n"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses that ask somebody for something, by their first word."""
    e = edits(spark, sf, "text").where("text IS NOT NULL")
    clauses = e.select("rev", F.explode(F.split("text", r"[.!?;]\s+|\n")).alias("clause"))
    asks = clauses.where(F.col("clause").rlike(r"(?i)\b(please|should|must|can you|could you)\b|^(Write|Send|Call|Compare|See)\b"))
    return asks.groupBy(F.lower(F.regexp_extract("clause", r"^\W*(\w+)", 1)).alias("word")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rev").alias("n_revs"))


def addressed(spark: SparkSession, sf: str) -> DataFrame:
    """Other writers' names that a text holds as whole words."""
    names = profiles(spark, sf, "name").where(r"name RLIKE '^[A-Za-z][A-Za-z0-9_]{5,}$'").select("name").distinct()
    e = edits(spark, sf, "text", "signed_as").where("text IS NOT NULL")
    words = e.select("rev", "signed_as", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_]{5,}"), 0))).alias("name"))
    return words.join(names, "name").where("signed_as IS NULL OR signed_as <> name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def conform(spark: SparkSession, sf: str) -> DataFrame:
    """Do revisions use clock words that others' revisions of the page show, a day back and ahead?"""
    e = edits(spark, sf, "page_key", "profile_id", "text").where("text IS NOT NULL AND profile_id IS NOT NULL AND t IS NOT NULL").withColumn("v", tx.variants(F.col("text"), CLOCKS))
    return trajectories.conformity(e, post="rev", agent="profile_id", page="page_key", time="t", variants="v", back_s=86_400, ahead_s=86_400)


def shared_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Writers whose texts hold the same item codes."""
    e = edits(spark, sf, "text", "profile_id").where("text IS NOT NULL AND profile_id IS NOT NULL")
    codes = e.select("profile_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z]{2}-\d{4,6}\b"), 0)).alias("code"))
    return trajectories.shared_keys(codes, writer="profile_id", key=["code"])


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that name a revision, here the stored ``seen``: does it exist, and was it saved by then?"""
    r = table(spark, sf, "reads").where("seen IS NOT NULL AND page_key IS NOT NULL AND ts IS NOT NULL").select("read_id", "page_key", F.col("seen").cast("string").alias("wanted"), times.whole_seconds(F.col("ts")).alias("t")).distinct()
    v = edits(spark, sf, "page_key", "seq").select("page_key", "seq", "t")
    return trajectories.asked_revision(r, v.withColumnRenamed("t", "saved"), read="read_id", page="page_key", asked="wanted", time="t", seq="seq", saved="saved").groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def board_index(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the review board's list of writers, with the edits to look at."""
    p = profiles(spark, sf, "name", "primary_family", "review_decision")
    e = edits(spark, sf, "profile_id", "copied", "reencoded", "multipost").where("profile_id IS NOT NULL").groupBy(F.col("profile_id").alias("id")).agg(F.count(F.lit(1)).alias("n_edits"), F.count_if(F.expr("copied = 1 OR reencoded = 1 OR multipost = 1")).alias("n_to_check"))
    return p.join(e, "id", "left").select("id", "name", F.coalesce("primary_family", F.lit("none")).alias("family"), F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("n_to_check", F.lit(0)).alias("n_to_check"), F.col("review_decision").isNotNull().alias("reviewed"))


def board_page(spark: SparkSession, sf: str) -> DataFrame:
    """The review board's view of pages: revisions made and stored, first and last write, events."""
    e = edits(spark, sf, "page_key").groupBy("page_key").agg(F.count(F.lit(1)).alias("made"), F.min("t").alias("first_s"), F.max("t").alias("last_s"))
    v = table(spark, sf, "page_events").select("event_type", "page_key", times.iso_seconds(F.col("time")).alias("at")).distinct().groupBy("page_key").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "delete").alias("n_deletes"))
    w = table(spark, sf, "wiki_pages").groupBy("page_key").agg(F.max("n_revs").alias("stored"))
    return w.join(e, "page_key", "left").join(v, "page_key", "left").select("page_key", F.coalesce("made", F.lit(0)).alias("made"), (F.coalesce("made", F.lit(0)) == F.coalesce("stored", F.lit(-1))).alias("as_stored"), F.coalesce("first_s", F.lit(-1)).alias("first_s"), F.coalesce("last_s", F.lit(-1)).alias("last_s"), F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_deletes", F.lit(0)).alias("n_deletes"))


QUERIES = {
    "writers_assembled": assembled, "writers_origins": origins, "writers_name_parts": name_parts, "edits_requests": requests, "edits_addressed": addressed, "edits_conformity": conform, "writers_shared_codes": shared_codes,
    "reads_asked": asked, "board_index": board_index, "board_pages": board_page,
}

ORACLE = {
    "writers_assembled": _E + """, i AS (SELECT * FROM e WHERE scope IN ('family', 'relay') AND profile_name IS NOT NULL),
b AS (SELECT profile_name, count(*) FILTER (scope IN ('family', 'relay')) AS n_in_scope, count(*) FILTER (scope = 'family') AS n_family, count(*) FILTER (scope = 'relay') AS n_relay, count(*) FILTER (scope NOT IN ('family', 'relay')) AS n_elsewhere, count(DISTINCT page_key) AS n_pages,
  min(t) FILTER (scope IN ('family', 'relay')) AS first, max(t) FILTER (scope IN ('family', 'relay')) AS last, count(*) FILTER (copied = 1) AS n_flagged FROM e WHERE profile_name IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (scope IN ('family', 'relay')) >= 2),
c AS (SELECT profile_name, family, count(*) AS n, min((t, rev)) AS f FROM i WHERE family IS NOT NULL GROUP BY 1, 2),
w AS (SELECT profile_name, string_agg(family || ':' || n, ';' ORDER BY n DESC, family) AS families, arg_min(family, (-n, f)) AS p FROM c GROUP BY 1)
SELECT b.profile_name, n_in_scope, n_family, n_relay, n_elsewhere, n_pages, first, last, round((last - first) / 3600, 2) AS span_hours, families, coalesce(p, 'none') AS primary_family, n_flagged FROM b LEFT JOIN w USING (profile_name)""",
    "writers_origins": _E + r""", t AS (SELECT DISTINCT unnest(regexp_extract_all(page, '[A-Za-z][\w.]{2,}')) AS w FROM e), x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z][\w.]{2,}')) AS w FROM e), n AS (SELECT DISTINCT name FROM profiles WHERE name IS NOT NULL)
SELECT CASE WHEN name IN (SELECT signed_as FROM e WHERE signed_as IS NOT NULL) THEN 'signoff' WHEN name IN (SELECT label FROM e WHERE label IS NOT NULL) THEN 'label' WHEN name IN (SELECT w FROM t) THEN 'page title' WHEN name IN (SELECT w FROM x) THEN 'post text' ELSE 'coined' END AS origin, count(*) AS n FROM n GROUP BY 1""",
    "writers_name_parts": r"""WITH p AS (SELECT DISTINCT id, name, regexp_replace(name, '(?:Agent|X)$', '') AS base FROM profiles)
SELECT CASE """ + " ".join(f"WHEN contains(name, '{r}') THEN '{r}'" for r in ROLES) + r""" ELSE 'none' END AS role, CASE WHEN regexp_matches(base, '^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{1,2}') THEN 'first' WHEN regexp_matches(base, '(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{1,2}$') THEN 'last'
  WHEN regexp_matches(base, '(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{1,2}') THEN 'middle' ELSE 'none' END AS date_place, contains(name, ' ') AS spaced, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "edits_requests": _E + r""", c AS (SELECT rev, unnest(string_split_regex(text, '[.!?;]\s+|\n')) AS clause FROM e WHERE text IS NOT NULL)
SELECT lower(regexp_extract(clause, '^\W*(\w+)', 1)) AS word, count(*) AS n, count(DISTINCT rev) AS n_revs FROM c WHERE regexp_matches(clause, '(?i)\b(please|should|must|can you|could you)\b|^(Write|Send|Call|Compare|See)\b') GROUP BY 1""",
    "edits_addressed": _E + r""", n AS (SELECT DISTINCT name FROM profiles WHERE regexp_matches(name, '^[A-Za-z][A-Za-z0-9_]{5,}$')), w AS (SELECT rev, signed_as, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{5,}'))) AS name FROM e)
SELECT name, count(*) AS n FROM w JOIN n USING (name) WHERE signed_as IS NULL OR signed_as <> name GROUP BY 1""",
    "edits_conformity": _E + f""", v AS (SELECT rev, page_key, profile_id, t, {_when(CLOCKS)} AS v FROM e WHERE text IS NOT NULL AND profile_id IS NOT NULL), k AS (SELECT * FROM v WHERE len(v) > 0),
n AS (SELECT CASE WHEN b.t < a.t THEN 'past' ELSE 'future' END AS side, a.rev, CAST(list_has_any(a.v, b.v) AS INT) AS alike, abs(a.t - b.t) AS d FROM k a JOIN k b ON a.page_key = b.page_key AND a.profile_id <> b.profile_id AND a.t <> b.t AND abs(a.t - b.t) <= 86400),
p AS (SELECT side, rev, max(alike) AS alike, arg_min(alike, (d, -alike)) AS nearest FROM n GROUP BY 1, 2)
SELECT side, count(*) AS n_items, CAST(sum(alike) AS BIGINT) AS n_alike, CAST(sum(nearest) AS BIGINT) AS n_nearest FROM p GROUP BY 1""",
    "writers_shared_codes": _E + r""", c AS (SELECT DISTINCT profile_id, unnest(regexp_extract_all(text, '\b[a-z]{2}-\d{4,6}\b')) AS code FROM e WHERE profile_id IS NOT NULL) SELECT a.profile_id AS writer_a, b.profile_id AS writer_b, count(*) AS n_keys FROM c a JOIN c b ON a.code = b.code AND a.profile_id < b.profile_id GROUP BY 1, 2""",
    "reads_asked": _E + ", r AS (SELECT DISTINCT read_id, page_key, seen, CASE WHEN abs(ts) > 100000000000 THEN ts // 1000 ELSE ts END AS t FROM reads WHERE seen IS NOT NULL AND page_key IS NOT NULL AND ts IS NOT NULL) SELECT CASE WHEN e.t <= r.t THEN 'asked' ELSE 'unresolved' END AS how, count(*) AS n FROM r LEFT JOIN e ON e.page_key = r.page_key AND e.seq = r.seen GROUP BY 1",
    "board_index": _E + ", p AS (SELECT DISTINCT ON (id) * FROM profiles), m AS (SELECT profile_id, count(*) AS n, count(*) FILTER (copied = 1 OR reencoded = 1 OR multipost = 1) AS k FROM e GROUP BY 1) SELECT p.id, p.name, coalesce(primary_family, 'none') AS family, coalesce(n, 0) AS n_edits, coalesce(k, 0) AS n_to_check, review_decision IS NOT NULL AS reviewed FROM p LEFT JOIN m ON m.profile_id = p.id",
    "board_pages": _E + """, m AS (SELECT page_key, count(*) AS made, min(t) AS first_s, max(t) AS last_s FROM e GROUP BY 1), v AS (SELECT page_key, count(*) AS n, count(*) FILTER (event_type = 'delete') AS d FROM (SELECT DISTINCT event_type, page_key, epoch_us(CAST(time AS TIMESTAMPTZ)) AS at FROM page_events) GROUP BY 1), w AS (SELECT page_key, max(n_revs) AS stored FROM wiki_pages GROUP BY 1)
SELECT w.page_key, coalesce(made, 0) AS made, coalesce(made, 0) = coalesce(stored, -1) AS as_stored, coalesce(first_s, -1) AS first_s, coalesce(last_s, -1) AS last_s, coalesce(n, 0) AS n_events, coalesce(d, 0) AS n_deletes FROM w LEFT JOIN m USING (page_key) LEFT JOIN v USING (page_key)""",
}
