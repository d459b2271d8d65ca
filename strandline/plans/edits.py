"""Queries over revisions, profiles, pages and documents: lines, signatures, features, placement, adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions import times, web
from strandline.operators import exposure, lines, matching, stats
from strandline.operators.rows import once
from strandline.sources.tables import table

#: Named patterns, as data: what a text is counted to have. Free of lookaround, so that SQL can state the same.
FEATURES = {
    "time of day": r"\b\d{1,2}:\d{2}:\d{2}\b", "round marker": r"\bR\d\b|\b[Rr]ound\s\d", "please": r"(?i)\bplease\b", "amount": r"[$€£]\d", "code": r"\b[a-z]{2}-\d{4,6}\b", "link": r"https?://|www\.|(^|\s)//", "quotation": r"[“”‘«»]", "question": r"[?¿]",
}
CLOCKS = {"round": r"(?i)\bround\b", "step": r"(?i)\bstep\b", "thread": r"(?i)\bthread\b", "grid": r"(?i)\bgrid\b"}
SCHEMES = {"grid": r"\bgrid \d+/12\b", "serial": r"\bSerial \d", "build": r"\bbuild 2\.", "arrived": r"\bArrived \d"}


def edits(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per revision with the columns asked for, and t, the second it was saved."""
    picked = {c: F.col(c) for c in columns}
    return once(table(spark, sf, "edits"), "rev", picked | {"t": times.iso_seconds(F.col("time"))})


def profiles(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return once(table(spark, sf, "profiles"), "id", {c: F.col(c) for c in columns})


def scope(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions by the scope of their page: a known family, the relay, or other."""
    pages = table(spark, sf, "wiki_pages").select("page_key", "page_family").distinct()
    known = table(spark, sf, "families").select(F.col("family_id").alias("page_family")).distinct().withColumn("known", F.lit(True))
    e = edits(spark, sf, "page_key").join(pages, "page_key", "left").join(known, "page_family", "left")
    case = F.when(F.col("known"), "family").when(F.col("page_family").startswith("relay"), "relay").otherwise("other")
    return e.groupBy(case.alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_key").alias("n_pages"))


def family_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Signed and unsigned revisions of each family, and each status."""
    return edits(spark, sf, "family", "signed_as", "status").groupBy(F.coalesce("family", F.lit("none")).alias("family")).agg(
        F.count_if(F.col("signed_as").isNotNull()).alias("signed"), F.count_if(F.col("signed_as").isNull()).alias("unsigned"), *[F.count_if(F.col("status") == s).alias(s) for s in ("assigned", "one_off", "out_of_scope")], F.count_if(F.col("status") == "unsigned").alias("stored_unsigned"))


def novel(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose skeleton is on no earlier revision of the page, by revision."""
    e = edits(spark, sf, "page_key", "seq", "text")
    return lines.novel_lines(e, page="page_key", seq="seq", text="text").groupBy("page_key", "seq").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def documents_novel(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents that no earlier document of their source holds."""
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    return lines.novel_lines(d, page="source", seq="doc_id", text="text").groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest earlier revision of the page that holds a line."""
    return lines.first_seen(edits(spark, sf, "page_key", "seq", "text"), page="page_key", seq="seq", rev="rev", text="text")


def last_signoff(spark: SparkSession, sf: str) -> DataFrame:
    """The last signed line of each revision."""
    return lines.last_signed(edits(spark, sf, "text"), rev="rev", text="text").select("rev", "signed_as", F.col("line_no").cast("int").alias("line_no"))


def own_block(spark: SparkSession, sf: str) -> DataFrame:
    """The signed block of each revision, its last 80 characters."""
    return lines.own_block(edits(spark, sf, "text"), rev="rev", text="text").select("rev", F.right("block", F.lit(80)).alias("tail"), F.char_length("block").alias("n_chars"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions with each feature, and their share in percent; one pass."""
    e = edits(spark, sf, "text").where("text IS NOT NULL")
    flags = tx.pattern_flags(F.col("text"), FEATURES)
    row = e.select(*[c.cast("int").alias(n) for n, c in flags.items()]).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"`{n}`").alias(n) for n in flags])
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("n"), F.round(100 * F.col(f"`{n}`") / F.col("__n"), 1).alias("percent")) for n in flags])
    return row.select(F.explode(each).alias("f")).select("f.*")


def feature_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions by the set of clock words they use."""
    e = edits(spark, sf, "text").where("text IS NOT NULL")
    return e.groupBy(F.array_join(tx.variants(F.col("text"), CLOCKS), "+").alias("clocks")).agg(F.count(F.lit(1)).alias("n"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Up to four revisions of each scope with a short text, and its beginning."""
    e = edits(spark, sf, "scope", "text").where("char_length(text) < 600")
    w = Window.partitionBy("scope").orderBy("t", "rev")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 4").select("scope", "k", "rev", F.left("text", F.lit(400)).alias("begin"))


def url_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Links of each revision, its lines with one, and whether the stored flag says so."""
    url = r"https?://[^\s)\"\]>]+"
    e = edits(spark, sf, "text", "has_url").where("text IS NOT NULL")
    return e.select("rev", F.regexp_count("text", F.lit(url)).alias("n_urls"), F.size(F.filter(tx.lines(F.col("text")), lambda x: x.rlike(url))).alias("url_lines"), (F.coalesce("has_url", F.lit(0)) == F.col("text").rlike(url).cast("int")).alias("flag_right"))


def link_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all texts by the last segment of their path, query keys in order and cache-defeating keys."""
    e = edits(spark, sf, "text").where("text IS NOT NULL")
    urls = e.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:https?:)?//[^\s)\"\]>]+"), 0)).alias("url"))
    ps = web.pairs(F.col("url"))
    parts = urls.select(web.host(F.col("url")).alias("host"), F.regexp_replace(web.last_segment(F.col("url")), r"\d+", "#").alias("last"), web.key_order(ps).alias("keys"), web.cache_keys(ps).alias("cache"), F.size(web.first_values(ps)).alias("n_keys"))
    return parts.groupBy("last", "keys", "cache").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("n_hosts"), F.max("n_keys").alias("n_keys"))


def page_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of page titles, with their pages and revisions."""
    e = edits(spark, sf, "page").where("page IS NOT NULL")
    words = e.select("rev", "page", "t", F.explode(F.array_distinct(F.regexp_extract_all("page", F.lit(r"[A-Z][a-z]+"), 0))).alias("word"))
    return words.groupBy("word").agg(F.countDistinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_revs"), F.min("t").alias("first_s"))


def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    """page keys made from page names, and revision ids taken apart, against the stored ones."""
    e = edits(spark, sf, "page", "page_key", "seq").where("page IS NOT NULL")
    made = tx.page_key_of(F.regexp_replace("page", r"^wik/", ""))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(made == F.col("page_key")).alias("n_key"), F.count_if(tx.rev_page(F.col("rev")) == F.col("page_key")).alias("n_rev"))


def email_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their e-mail addresses scrubbed, by what is left of them."""
    e = edits(spark, sf, "text").where(F.col("text").rlike(tx.EMAIL))
    return e.select("rev", F.md5(F.regexp_replace("text", tx.EMAIL, "<email>")).alias("scrubbed"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each writer's first and last edit, hours between them, and pages."""
    e = edits(spark, sf, "profile_id", "page_key").where("profile_id IS NOT NULL")
    return e.groupBy("profile_id").agg(F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.round((F.max("t") - F.min("t")) / 3600, 2).alias("hours"), F.countDistinct("page_key").alias("n_pages"), F.count(F.lit(1)).alias("n"))


def profile_families(spark: SparkSession, sf: str) -> DataFrame:
    """the map ``family:n;family:n`` taken apart and written again, by its families."""
    p = profiles(spark, sf, "families").where("families IS NOT NULL")
    m = p.select("id", F.explode(F.str_to_map("families", F.lit(";"), F.lit(":"))).alias("family", "n"))
    return m.groupBy("family").agg(F.count(F.lit(1)).alias("n_profiles"), F.sum(F.col("n").cast("bigint")).alias("n_edits"))


def unplaced(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles without an edit, and edits without a profile, as one set of rows."""
    e, p = edits(spark, sf, "profile_id").where("profile_id IS NOT NULL").select(F.col("profile_id").alias("id")).distinct(), profiles(spark, sf, "kind").select("id")
    return p.join(e, "id", "left_anti").withColumn("side", F.lit("profile")).unionByName(e.join(p, "id", "left_anti").withColumn("side", F.lit("edit")))


def level_union(spark: SparkSession, sf: str) -> DataFrame:
    """Writers and revisions in one table with a level, counted by it and the family."""
    e = edits(spark, sf, "family").select(F.lit("edit").alias("level"), F.col("rev").alias("key"), "family")
    p = profiles(spark, sf, "primary_family").select(F.lit("profile").alias("level"), F.col("id").alias("key"), F.col("primary_family").alias("family"))
    return e.unionByName(p).groupBy("level", F.coalesce("family", F.lit("none")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Stored counts of profiles against those made from the edits."""
    e = edits(spark, sf, "profile_id", "scope").groupBy(F.col("profile_id").alias("id")).agg(F.count_if(F.col("scope").isin("family", "relay")).alias("made"), F.count_if(F.col("scope") == "family").alias("made_family"))
    p = profiles(spark, sf, "edits_in_scope", "family_page_edits").join(e, "id", "left")
    return matching.reconciled(p, {"edits in scope": (F.sum(F.coalesce("made", F.lit(0))), F.sum("edits_in_scope")), "family page edits": (F.sum(F.coalesce("made_family", F.lit(0))), F.sum("family_page_edits")), "profiles": (F.count(F.lit(1)), F.countDistinct("id"))})


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Places named in a text that are part of a page title, with the texts and pages."""
    e = edits(spark, sf, "text", "page_key").where("text IS NOT NULL")
    named = e.select("rev", "page_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{6,}\b"), 0))).alias("word"))
    titles = edits(spark, sf, "page").select(F.explode(F.regexp_extract_all("page", F.lit(r"[A-Z][a-z]{6,}"), 0)).alias("word")).distinct()
    return named.join(titles, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_key").alias("n_pages"))


def shared_shingles(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of eight words of a revision that an earlier one of another page holds, if on three pages at most."""
    e = edits(spark, sf, "page_key", "text").where("text IS NOT NULL AND t IS NOT NULL")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), 0)
    # Shingles travel as hashes of 64 bits: two of them would have to share one to be taken for each other.
    each = e.select("rev", "page_key", "t", words.alias("w")).select("rev", "page_key", "t", F.explode(F.array_distinct(tx.shingle_hashes(F.col("w"), 8))).alias("s"))
    rare = each.groupBy("s", "page_key").agg(F.min("t").alias("t")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first")).where("n BETWEEN 2 AND 3")
    origin = each.join(rare.select("s", "first"), "s")
    early = origin.where("t = first").groupBy("s").agg(F.collect_set("page_key").alias("pages"))  # three at most
    return origin.where("t > first + 60").join(early, "s").where(~F.array_contains("pages", F.col("page_key"))).groupBy("rev").agg(F.count(F.lit(1)).alias("n_shingles"))


def adoption(spark: SparkSession, sf: str) -> DataFrame:
    """Who first used each scheme, and how many writers and families took it up."""
    e = edits(spark, sf, "text", "profile_id", "family").where("text IS NOT NULL AND profile_id IS NOT NULL AND family IS NOT NULL")
    uses = e.select("profile_id", "family", "t", F.explode(tx.variants(F.col("text"), SCHEMES)).alias("token"))
    return exposure.adoption(uses, token="token", agent="profile_id", family="family", time="t")


def read_before(spark: SparkSession, sf: str) -> DataFrame:
    """Edits by whether their writer read the page before, at least five seconds earlier."""
    uses = edits(spark, sf, "profile_id", "page_key").where("profile_id IS NOT NULL").select(F.col("rev").alias("use_id"), F.col("profile_id").alias("agent"), "page_key", "t")
    reads = table(spark, sf, "reads").where("traj_id IS NOT NULL AND page_key IS NOT NULL AND cls IN ('browse', 'diff', 'edit_form')").select(F.col("traj_id").alias("agent"), "page_key", times.whole_seconds(F.col("ts")).alias("t"))
    return exposure.read_before(uses, reads, agent="agent", page="page_key", lag_s=5).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("agent").alias("n_agents"))


def nearby_posts(spark: SparkSession, sf: str) -> DataFrame:
    """For each revision, revisions of others on the page in the three hours before, and the features they share with it."""
    from strandline.operators.band import band_join

    e = edits(spark, sf, "page_key", "profile_id", "text").where("text IS NOT NULL AND profile_id IS NOT NULL AND t IS NOT NULL").withColumn("v", tx.variants(F.col("text"), CLOCKS))
    left = e.select("rev", "page_key", F.col("profile_id").alias("own"), "t", F.col("v").alias("mine"))
    right = e.select("page_key", F.col("profile_id").alias("other"), F.col("t").alias("t_other"), F.col("v").alias("theirs"))
    near = band_join(left, right, on=["page_key"], left_time="t", right_time="t_other", lo=-10_800, hi=-1).where("own <> other")
    return near.groupBy("rev").agg(F.count(F.lit(1)).alias("n_near"), F.count_if(F.arrays_overlap("mine", "theirs")).alias("n_alike"), F.min(F.col("t") - F.col("t_other")).alias("nearest_s"))


def page_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The writer with most revisions of each page, and their share."""
    e = edits(spark, sf, "page_key", "label", "seq")
    return stats.ordered_mode(e, by="page_key", value="label", first="seq").select("page_key", "label", "n", F.round("purity", 6).alias("purity"))


QUERIES = {
    "edits_scope": scope, "edits_family_pivot": family_pivot, "edits_novel_lines": novel, "documents_novel_lines": documents_novel, "edits_first_seen": first_seen, "edits_last_signoff": last_signoff,
    "edits_own_block": own_block, "edits_features": features, "edits_variants": feature_variants, "edits_samples": samples, "edits_url_counts": url_counts, "edits_link_parts": link_parts, "edits_page_words": page_words,
    "edits_page_keys": page_keys, "edits_email_scrub": email_scrub, "edits_spans": spans, "profiles_families": profile_families, "edits_unplaced": unplaced, "edits_level_union": level_union, "edits_reconcile": reconcile,
    "edits_mentions": mentions, "edits_shared_shingles": shared_shingles, "edits_adoption": adoption, "edits_read_before": read_before, "edits_nearby_posts": nearby_posts,
    "edits_page_mode": page_mode, 
}

# Repeated rows are equal in what these queries read.
_E = "WITH e AS (SELECT DISTINCT ON (rev) *, epoch_us(CAST(time AS TIMESTAMPTZ)) // 1000000 AS t FROM edits)"
_P = "WITH p AS (SELECT DISTINCT ON (id) * FROM profiles)"
_L = _E + r", l AS (SELECT rev, page_key, seq, i - 1 AS line_no, ls[i] AS line, trim(regexp_replace(regexp_replace(ls[i], '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS s FROM (SELECT *, string_split(text, chr(10)) AS ls FROM e WHERE text IS NOT NULL), unnest(generate_series(1, len(ls))) AS u(i))"
_SIGNED = r"(?:^|\s)--\s*([A-Za-z][\w.\-]{2,})\s*(?:\?|[\[(][^\])]{1,40}[\])])?\s*$"
_UNION = " UNION ALL "


def _when(table_: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in table_.items()) + "], lambda x: x IS NOT NULL))"


ORACLE = {
    "edits_scope": _E + """, p AS (SELECT DISTINCT page_key, page_family FROM wiki_pages)
SELECT CASE WHEN page_family IN (SELECT family_id FROM families) THEN 'family' WHEN page_family LIKE 'relay%' THEN 'relay' ELSE 'other' END AS scope, count(*) AS n, count(DISTINCT e.page_key) AS n_pages FROM e LEFT JOIN p USING (page_key) GROUP BY 1""",
    "edits_family_pivot": _E + " SELECT coalesce(family, 'none') AS family, count(*) FILTER (signed_as IS NOT NULL) AS signed, count(*) FILTER (signed_as IS NULL) AS unsigned, count(*) FILTER (status = 'assigned') AS assigned, count(*) FILTER (status = 'one_off') AS one_off, count(*) FILTER (status = 'out_of_scope') AS out_of_scope, count(*) FILTER (status = 'unsigned') AS stored_unsigned FROM e GROUP BY 1",
    "edits_novel_lines": _L + ", f AS (SELECT page_key, s, min(seq) AS q FROM l GROUP BY 1, 2) SELECT l.page_key, l.seq, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l JOIN f ON l.page_key = f.page_key AND l.s = f.s AND l.seq = f.q GROUP BY 1, 2",
    "documents_novel_lines": r"WITH l AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(x, '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS s FROM documents, unnest(string_split(text, chr(10))) AS u(x)), f AS (SELECT source, s, min(doc_id) AS q FROM l GROUP BY 1, 2) SELECT l.source, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM l JOIN f ON l.source = f.source AND l.s = f.s AND l.doc_id = f.q GROUP BY 1",
    "edits_first_seen": _L + ", f AS (SELECT page_key, s, min(seq) AS q, arg_min(rev, seq) AS origin FROM l GROUP BY 1, 2) SELECT rev, line_no, origin FROM l JOIN f ON l.page_key = f.page_key AND l.s = f.s AND f.q < l.seq",
    "edits_last_signoff": _L + f", n AS (SELECT rev, line_no, regexp_extract(rtrim(line), '{_SIGNED}', 1) AS name FROM l) SELECT rev, arg_max(name, line_no) AS signed_as, CAST(max(line_no) AS INTEGER) AS line_no FROM n WHERE regexp_matches(name, '^[A-Z]') GROUP BY 1",
    "edits_features": _E + ", x AS (SELECT text FROM e WHERE text IS NOT NULL) " + _UNION.join(f"SELECT '{n}' AS feature, CAST(count(*) FILTER (regexp_matches(text, '{p}')) AS BIGINT) AS n, round(100 * count(*) FILTER (regexp_matches(text, '{p}')) / count(*), 1) AS percent FROM x" for n, p in FEATURES.items()),
    "edits_variants": _E + f" SELECT array_to_string({_when(CLOCKS)}, '+') AS clocks, count(*) AS n FROM e WHERE text IS NOT NULL GROUP BY 1",
    "edits_samples": _E + " SELECT scope, k, rev, left(text, 400) AS begin FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t, rev) AS k FROM e WHERE length(text) < 600) WHERE k <= 4",
    "edits_url_counts": _E + r""" SELECT rev, len(regexp_extract_all(text, 'https?://[^\s)"\]>]+')) AS n_urls, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'https?://[^\s)"\]>]+'))) AS url_lines, coalesce(has_url, 0) = CAST(regexp_matches(text, 'https?://[^\s)"\]>]+') AS INT) AS flag_right FROM e WHERE text IS NOT NULL""",
    "edits_page_words": _E + " SELECT word, count(DISTINCT page) AS n_pages, count(*) AS n_revs, min(t) AS first_s FROM (SELECT rev, page, t, unnest(list_distinct(regexp_extract_all(page, '[A-Z][a-z]+'))) AS word FROM e) GROUP BY 1",
    "edits_page_keys": _E + r""", k AS (SELECT rev, page_key, 'wik~' || array_to_string(list_transform(regexp_extract_all(regexp_replace(page, '^wik/', ''), '(?s).'), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.\-]$') THEN c ELSE regexp_replace(lower(hex(encode(c))), '(..)', '~\1', 'g') END), '') AS made FROM e WHERE page IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (made = page_key) AS n_key, count(*) FILTER (regexp_extract(rev, '^(.*)@', 1) = page_key) AS n_rev FROM k""",
    "edits_email_scrub": _E + r" SELECT rev, md5(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '<email>', 'g')) AS scrubbed FROM e WHERE regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+')",
    "edits_spans": _E + " SELECT profile_id, min(t) AS first_s, max(t) AS last_s, round((max(t) - min(t)) / 3600, 2) AS hours, count(DISTINCT page_key) AS n_pages, count(*) AS n FROM e WHERE profile_id IS NOT NULL GROUP BY 1",
    "profiles_families": _P + " SELECT split_part(x, ':', 1) AS family, count(*) AS n_profiles, CAST(sum(CAST(split_part(x, ':', 2) AS BIGINT)) AS BIGINT) AS n_edits FROM p, unnest(string_split(families, ';')) AS u(x) GROUP BY 1",
    "edits_unplaced": "SELECT id, 'profile' AS side FROM (SELECT DISTINCT id FROM profiles) WHERE id NOT IN (SELECT profile_id FROM edits WHERE profile_id IS NOT NULL) UNION ALL SELECT profile_id, 'edit' FROM (SELECT DISTINCT profile_id FROM edits WHERE profile_id IS NOT NULL) WHERE profile_id NOT IN (SELECT id FROM profiles)",
    "edits_level_union": _E + ", p AS (SELECT DISTINCT ON (id) * FROM profiles) SELECT 'edit' AS level, coalesce(family, 'none') AS family, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'profile', coalesce(primary_family, 'none'), count(*) FROM p GROUP BY 2",
    "edits_reconcile": _E + """, p AS (SELECT DISTINCT ON (id) * FROM profiles), m AS (SELECT profile_id, count(*) FILTER (scope IN ('family', 'relay')) AS made, count(*) FILTER (scope = 'family') AS made_family FROM e GROUP BY 1), x AS (SELECT p.id, p.edits_in_scope, p.family_page_edits, coalesce(made, 0) AS made, coalesce(made_family, 0) AS made_family FROM p LEFT JOIN m ON m.profile_id = p.id),
r AS (SELECT 'edits in scope' AS check_name, CAST(sum(made) AS DOUBLE) AS recomputed, CAST(sum(edits_in_scope) AS DOUBLE) AS stored FROM x UNION ALL SELECT 'family page edits', CAST(sum(made_family) AS DOUBLE), CAST(sum(family_page_edits) AS DOUBLE) FROM x UNION ALL SELECT 'profiles', CAST(count(*) AS DOUBLE), CAST(count(DISTINCT id) AS DOUBLE) FROM x)
SELECT *, recomputed IS NOT DISTINCT FROM stored AS equal FROM r""",
    "edits_mentions": _E + r", n AS (SELECT rev, page_key, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]{6,}\b'))) AS word FROM e), t AS (SELECT DISTINCT unnest(regexp_extract_all(page, '[A-Z][a-z]{6,}')) AS word FROM e) SELECT word, count(*) AS n, count(DISTINCT page_key) AS n_pages FROM n JOIN t USING (word) GROUP BY 1",
    "edits_shared_shingles": _E + """, w AS (SELECT rev, page_key, t, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM e WHERE text IS NOT NULL AND t IS NOT NULL),
s AS (SELECT DISTINCT rev, page_key, t, array_to_string(ws[i : i + 7], ' ') AS s FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
r AS (SELECT s, min(t) AS first FROM s GROUP BY 1 HAVING count(DISTINCT page_key) BETWEEN 2 AND 3),
o AS (SELECT s.*, r.first FROM s JOIN r USING (s)), f AS (SELECT DISTINCT s, page_key FROM o WHERE t = first)
SELECT rev, count(*) AS n_shingles FROM o WHERE t > first + 60 AND NOT EXISTS (SELECT 1 FROM f WHERE f.s = o.s AND f.page_key = o.page_key) GROUP BY 1""",
    "edits_adoption": _E + f""", u AS (SELECT profile_id, family, t, unnest({_when(SCHEMES)}) AS token FROM e WHERE text IS NOT NULL AND profile_id IS NOT NULL AND family IS NOT NULL),
f AS (SELECT token, profile_id, min((t, family)) AS m FROM u GROUP BY 1, 2), g AS (SELECT token, profile_id AS a, m[1] AS t, m[2] AS fam FROM f), o AS (SELECT token, min((t, a, fam)) AS m, count(*) AS n_users, count(DISTINCT fam) AS n_families FROM g GROUP BY 1)
SELECT o.token, o.m[2] AS origin, o.m[1] AS first_use, n_users, n_families, count(*) FILTER (g.a <> o.m[2] AND g.fam <> o.m[3]) AS n_elsewhere FROM o JOIN g USING (token) GROUP BY ALL""",
    "edits_read_before": _E + """, r AS (SELECT traj_id, page_key, min(CASE WHEN abs(ts) > 100000000000 THEN ts // 1000 ELSE ts END) AS first FROM reads WHERE cls IN ('browse', 'diff', 'edit_form') AND ts IS NOT NULL GROUP BY 1, 2)
SELECT CASE WHEN first <= t - 5 THEN 'confirmed' WHEN first <= t THEN 'arrived_between' ELSE 'no_named_read' END AS how, count(*) AS n, count(DISTINCT profile_id) AS n_agents FROM e LEFT JOIN r ON r.traj_id = e.profile_id AND r.page_key = e.page_key WHERE profile_id IS NOT NULL GROUP BY 1""",
    "edits_nearby_posts": _E + f", v AS (SELECT rev, page_key, profile_id, t, {_when(CLOCKS)} AS v FROM e WHERE text IS NOT NULL AND profile_id IS NOT NULL) SELECT a.rev, count(*) AS n_near, count(*) FILTER (list_has_any(a.v, b.v)) AS n_alike, min(a.t - b.t) AS nearest_s FROM v a JOIN v b ON a.page_key = b.page_key AND a.profile_id <> b.profile_id AND b.t BETWEEN a.t - 10800 AND a.t - 1 GROUP BY 1",
    "edits_page_mode": _E + ", c AS (SELECT page_key, label, count(*) AS n, min(seq) AS f FROM e WHERE label IS NOT NULL GROUP BY 1, 2) SELECT page_key, label, n, round(n / total, 6) AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY page_key) AS total, row_number() OVER (PARTITION BY page_key ORDER BY n DESC, f, label) AS k FROM c) WHERE k = 1",
    "edits_link_parts": _E + r""", u AS (SELECT unnest(regexp_extract_all(text, '(?:https?:)?//[^\s)"\]>]+')) AS url FROM e WHERE text IS NOT NULL),
q AS (SELECT regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1), '([^/]*)$', 1), '\d+', '#', 'g') AS last,
  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: regexp_replace(regexp_extract(x, '^([^=]*)', 1), '^amp;', '')) AS ks FROM u),
k AS (SELECT host, last, ks, list_filter(ks, lambda x: x NOT IN (@busters)) AS rest, list_sort(list_distinct(list_filter(ks, lambda x: x IN (@busters)))) AS bust FROM q)
SELECT last, coalesce(nullif(array_to_string(rest, ' '), ''), '-') AS keys, coalesce(nullif(array_to_string(bust, ','), ''), '-') AS cache, count(*) AS n, count(DISTINCT host) AS n_hosts, max(len(list_distinct(ks))) AS n_keys FROM k GROUP BY 1, 2, 3""".replace("@busters", ", ".join(f"'{x}'" for x in web.CACHE_BUSTERS)),
}
