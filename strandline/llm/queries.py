"""Queries of the training-text operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.bpe import encode_column
from strandline.llm.encoding import repair_encoding
from strandline.llm.hosts import unique_runs
from strandline.llm.leaks import find_leaks
from strandline.llm.markup import clean_markup
from strandline.llm.names import entity_pairs, link_names
from strandline.llm.pii import redact
from strandline.llm.spans import MIN_CHARS, linked_records, shared_share, shared_spans, text_classes
from strandline.llm.split import split_oversized
from strandline.operators.rows import once
from strandline.sources.tables import table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode_column(table(spark, sf, "documents"), key="doc_id", text="text")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, piece_no, begin, end, n_tokens, piece) of every document of more than 1,024 tokens."""
    return split_oversized(table(spark, sf, "documents"), key="doc_id", text="text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id) of the documents that had to be split."""
    pieces = split_oversized(table(spark, sf, "documents"), key="doc_id", text="text", with_text=False)
    return pieces.where(F.col("piece_no") == 2).select("doc_id")


def edits_once(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, text) of each revision that has a text, repeated rows counted once."""
    return once(table(spark, sf, "edits").where(F.col("text").isNotNull()), "rev", {"text": F.col("text")})


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, restored, pairs, complete) of each revision with garbled text."""
    return repair_encoding(edits_once(spark, sf), key="rev", text="text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """(rev) of each revision with garbled text."""
    return p2_restored(spark, sf).select("rev")


def p4_entities(spark: SparkSession, sf: str) -> DataFrame:
    """(id, entity): the entity of each profile, named by its least id."""
    return link_names(table(spark, sf, "profiles"), key="id", name="name", family="primary_family", families="families")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """(id_a, id_b): all pairs of profiles that mean the same."""
    return entity_pairs(p4_entities(spark, sf))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, redacted, found) of each revision with personal information."""
    return redact(edits_once(spark, sf), key="rev", text="text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, kind), a row for each kind of personal information in a revision."""
    return p5_redacted(spark, sf).select("rev", F.explode(F.array_distinct("found.kind")).alias("kind"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, clean, structure, kinds) of each revision with markup."""
    return clean_markup(edits_once(spark, sf), key="rev", text="text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, kind), a row for each kind of markup in a revision."""
    return p7_clean(spark, sf).select("rev", F.explode("kinds").alias("kind"))


def p7_unique(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, kept, removed, removed_chars): each revision without the strings of 30 tokens or more that another page of its wiki has, too."""
    edits = once(table(spark, sf, "edits").where(F.col("text").isNotNull()), "rev", {"page_key": F.col("page_key"), "text": F.col("text")})
    return unique_runs(edits, key="rev", text="text", page="page_key", host=F.regexp_extract("page_key", r"^([^~]*)", 1))


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reps, members = text_classes(table(spark, sf, "edits"), key="rev", text="text", min_chars=MIN_CHARS)
    return reps, members, shared_spans(reps)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """(rev_a, rev_b): revisions that share at least 160 consecutive characters."""
    _, members, spans = _spans(spark, sf)
    return linked_records(spans, members).select(F.col("id_a").alias("rev_a"), F.col("id_b").alias("rev_b"))


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(rev_a, rev_b, begin_a, begin_b, n_chars): each shared span of the representatives of different texts."""
    return _spans(spark, sf)[2].withColumnsRenamed({"rep_a": "rev_a", "rep_b": "rev_b"})


def p6_shared(spark: SparkSession, sf: str) -> DataFrame:
    """(rev, class_id, n_copies, n_links, shared_chars, shared_share) of each revision."""
    return shared_share(*_spans(spark, sf)).withColumnRenamed("id", "rev")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id, errors, at_word) with up to one word edit in a window of 15."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", max_errors=1)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id): documents with at least 15 consecutive words of an item: the leaks whose best window has no error."""
    return p9_leaks(spark, sf).where("errors = 0").select("doc_id", "item_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p7_unique": p7_unique,
    "p6_found": p6_found,
    "p6_spans": p6_spans,
    "p6_shared": p6_shared,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

ORACLE: dict[str, str] = {
    "p6_found": """
WITH e AS (SELECT rev, min(text) AS text FROM edits WHERE text IS NOT NULL GROUP BY rev),
g AS (SELECT rev, substring(text, CAST(i AS BIGINT), 160) AS s FROM e, unnest(generate_series(1, length(text) - 159)) AS u(i) WHERE length(text) >= 160),
h AS (SELECT rev, s FROM g WHERE s IN (SELECT s FROM g GROUP BY s HAVING count(DISTINCT rev) > 1))
SELECT DISTINCT a.rev AS rev_a, b.rev AS rev_b FROM h a JOIN h b ON a.s = b.s AND a.rev < b.rev""",
    "p6_shared": """
WITH e AS (SELECT rev, min(text) AS text FROM edits WHERE text IS NOT NULL GROUP BY rev),
c AS (SELECT text, min(rev) AS rep, count(*) AS n_copies FROM e WHERE length(text) >= 160 GROUP BY text),
g AS (SELECT rep, i, substring(text, CAST(i AS BIGINT), 160) AS s FROM c, unnest(generate_series(1, length(text) - 159)) AS u(i)),
h AS (SELECT * FROM g WHERE s IN (SELECT s FROM g GROUP BY s HAVING count(DISTINCT rep) > 1)),
l AS (SELECT a.rep, count(DISTINCT b.rep) AS n_links FROM h a JOIN h b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1),
k AS (SELECT rep, sum(least(160, coalesce(next - i, 160))) AS n FROM (SELECT rep, i, lead(i) OVER (PARTITION BY rep ORDER BY i) AS next FROM h) GROUP BY 1)
SELECT e.rev, c.rep AS class_id, n_copies, coalesce(n_links, 0) AS n_links, CAST(CASE WHEN n_copies > 1 THEN length(c.text) ELSE coalesce(k.n, 0) END AS INTEGER) AS shared_chars, CASE WHEN n_copies > 1 THEN length(c.text) ELSE coalesce(k.n, 0) END / length(c.text)::DOUBLE AS shared_share
FROM e JOIN c USING (text) LEFT JOIN l ON l.rep = c.rep LEFT JOIN k ON k.rep = c.rep""",
    "p9_found": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS words FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS words FROM eval_items),
d AS (SELECT doc_id, array_to_string(words[i : i + 14], ' ') AS s FROM w, unnest(generate_series(1, len(words) - 14)) AS u(i)),
t AS (SELECT item_id, array_to_string(words[i : i + 14], ' ') AS s FROM v, unnest(generate_series(1, len(words) - 14)) AS u(i))
SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (s)""",
}
