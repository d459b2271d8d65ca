"""Readers with explicit schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVISION = "rev_id string, page_id string, page_key string, seq int, time string, label string, body string, diff_base string, hunks array<struct<op string, a0 int, a1 int, b0 int, b1 int>>, change_summary string"
PAGE = "page_key string, page_id string, page_family string, n_revs int, first_write string, last_write string"
PAGE_EVENT = "event_type string, page_key string, time string"
LOG_EVENT = "event_id string, at string, reviewer string, target struct<dossier string, rev string>, verdict string, assign_to string, tags array<string>, note string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON object per line, only the columns of the schema; a malformed line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small files that are one JSON value each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tsv(spark: SparkSession, path: str, schema: str, escaped: bool = False) -> DataFrame:
    """Tab-separated text with a header and without quoting, compressed or not; empty fields are null. escaped: undo two-sign escapes."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).option("nullValue", "").csv(path)
    if not escaped:
        return df
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def plain(c):
        mark = "\x00"
        out = F.regexp_replace(c, r"\\\\", mark)
        for sign, to in (("t", "\t"), ("n", "\n"), ("r", "\r")):
            out = F.regexp_replace(out, rf"\\{sign}", to)
        return F.regexp_replace(out, mark, r"\\")

    return df.withColumns({c: plain(F.col(c)) for c in strings})


def log_records(spark: SparkSession, path: str, start: str = "#DONE2|") -> DataFrame:
    """(record): records of a raw log that begin with ``start``; line ends inside a record are kept, text before the first one is left out.

    The reader splits at the start mark itself, so a file is still read in splits.
    """
    raw = spark.read.option("lineSep", "\n" + start).text(path)
    body = F.when(F.col("value").startswith(start), F.substring("value", len(start) + 1, 1 << 30)).otherwise(F.col("value"))
    return raw.select(F.regexp_replace(body, r"[\r\n]+$", "").alias("record")).where(F.col("record") != "")


REQUEST = r"(?s)^1\|UT\|([^|]*)\|ST\|([^|]*)\|STAMP\|[^|]*\|IP\|([^|]*)\|HOST\|([^|]*)\|USER\|([^|]*)\|NAME\|([^|]*)\|ACTION\|(.*?)(?:\|TS\|(\d*))?$"
REQUEST_FIELDS = ("ut", "st", "ip", "host", "user", "name", "url", "ts")


def request_fields(records: DataFrame) -> DataFrame:
    """(parsed, ut, st, ip, host, user, name, url, ts, killed): the fields of each record; unparsed ones have parsed false and nulls."""
    hit = F.col("record").rlike(REQUEST)
    fields = [F.when(hit, F.regexp_extract("record", REQUEST, i)).alias(n) for i, n in enumerate(REQUEST_FIELDS, 1)]
    out = records.select("record", hit.alias("parsed"), *fields)
    return out.withColumn("ts", F.nullif(F.expr("try_cast(nullif(ts, '') AS bigint)"), F.lit(0))).withColumn("killed", F.coalesce(F.col("host").endswith(" KILLED"), F.lit(False)))


def referrers(spark: SparkSession, path: str) -> DataFrame:
    """(ts, path, referrer_host) of lines ``ts|path|url``; lines without a time in digits are left out."""
    from strandline.functions.web import host

    parts = F.split(F.col("value"), r"\|", 3)
    rows = spark.read.text(path).where((F.size(parts) == 3) & F.element_at(parts, 1).rlike(r"^\d+$"))
    return rows.select(F.element_at(parts, 1).cast("bigint").alias("ts"), F.element_at(parts, 2).alias("path"), host(F.element_at(parts, 3)).alias("referrer_host"))


def rule_titles(spark: SparkSession, path: str) -> DataFrame:
    """(rule, title) of a document's ``**R1 — title**`` lines."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"\*\*(R\d+ — [^*]+)\*\*"), 1)).alias("x"))
    return rows.select(F.regexp_extract("x", r"^(R\d+)", 1).alias("rule"), F.regexp_extract("x", r"^R\d+ — (.*)$", 1).alias("title"))


def merged_sources(spark: SparkSession, paths: dict[str, str], schema: str, key: str) -> DataFrame:
    """Rows of several JSON-lines sources by priority: of one key, the first source that has it counts; ``source`` names it."""
    out = None
    for rank, (name, path) in enumerate(paths.items()):
        rows = json_lines(spark, path, schema).where(F.col(key).isNotNull()).withColumns({"source": F.lit(name), "__rank": F.lit(rank)})
        out = rows if out is None else out.unionByName(rows)
    columns = [c for c in out.columns if c != key]
    best = out.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("__rank", F.to_json(F.struct(*columns)))).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in columns if c != "__rank"])


def zip_lines(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """The JSON lines of one member of each zip archive below a path, only the columns of the schema. An archive is read by one task: zip isn't splittable."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        continue
                    with z.open(member) as raw:
                        chunk: list[str] = []
                        for line in io.TextIOWrapper(raw, "utf-8"):
                            if line.strip():
                                chunk.append(line.strip())
                            if len(chunk) == 5_000:
                                yield pd.DataFrame({"value": chunk})
                                chunk = []
                        yield pd.DataFrame({"value": chunk})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInPandas(lines, "value string")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(rev, n, last): the observation index, by revision: how many there are, and the signature of the last line observed."""
    rows = json_lines(spark, path, "revision_id string, line int, signature string").where("revision_id IS NOT NULL")
    return rows.groupBy(F.col("revision_id").alias("rev")).agg(F.count(F.lit(1)).alias("n"), F.max_by("signature", "line").alias("last"))


def record_counts(spark: SparkSession, path: str, start: str = "#DONE2|") -> DataFrame:
    """One row (n_records, n_continued, n_orphans) of a raw log: records, lines that continue one, and lines before the first."""
    whole = spark.read.option("lineSep", "\n" + start).text(path)
    first = F.col("value").startswith(start)
    n_lines = F.size(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\n"))
    # Only what stands before a file's first mark begins without it and isn't followed by the fields of a record.
    record = first | F.col("value").rlike(r"^\d+\|")
    return whole.where("value <> ''").agg(F.count_if(record).alias("n_records"), F.coalesce(F.sum(F.when(record, n_lines - 1)), F.lit(0)).alias("n_continued"), F.coalesce(F.sum(F.when(~record, n_lines)), F.lit(0)).alias("n_orphans"))
