"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import tsv_escaped


def write_tsv(df: DataFrame, path: str, escaped: bool = True, compression: str = "gzip") -> None:
    """Tab-separated text without quoting; signs that would break a line are escaped, nulls are empty."""
    if escaped:
        df = df.withColumns({f.name: tsv_escaped(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).option("nullValue", "").option("emptyValue", "").option("compression", compression).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, unique: list[str] | None = None, partition: list[str] | None = None) -> None:
    """Parquet; raises before writing if the key columns aren't unique."""
    if unique:
        twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        if twice.take(1):
            raise ValueError(f"{', '.join(unique)} isn't unique")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_event(df: DataFrame, path: str, required: list[str]) -> int:
    """Append valid events to a JSON-lines log and return their number; raises, and writes nothing, if a required field is null in any row.

    One pass counts events and bad ones; the rows are checked again as they are written, so a row that changed between is never appended.
    """
    lacking = " OR ".join(f"{c} IS NULL" for c in required)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(lacking)).alias("bad")).first()
    message = f"an event lacks one of {', '.join(required)}"
    if row["bad"]:
        raise ValueError(message)
    df.where(F.assert_true(~F.expr(lacking), F.lit(message)).isNull()).write.mode("append").json(path)
    return row["n"]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, columns in the order given, quoted where needed; nulls are empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_summary(parts: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """One JSON document: a key for each part, an object for a table of one row, else an array of objects. Parts are aggregates: more than ``most`` rows raise."""
    out = None
    for name, df in parts.items():
        if df.limit(most + 1).count() > most:
            raise ValueError(f"{name} has too many rows for a summary")
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("j")).select(F.lit(name).alias("k"), F.when(F.lit(len(df.columns) > 0) & (F.size(F.from_json("j", "array<string>")) == 1), F.regexp_replace("j", r"^\[|\]$", "")).otherwise(F.col("j")).alias("j"))
        out = one if out is None else out.unionByName(one)
    document = out.coalesce(1).agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "k", F.lit('": '), "j"))).alias("p")).select(F.concat(F.lit("{"), F.array_join("p", ", "), F.lit("}")).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame, most: int = 1_000) -> str:
    """A table as aligned text, numbers to the right; for small results: more than ``most`` rows raise."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    number = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = [df.columns, *[["-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    widths = [max(len(row[i]) for row in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.rjust(w) if n in number else c.ljust(w) for c, w, n in zip(row, widths, df.columns)).rstrip() for row in cells)
