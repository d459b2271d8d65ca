"""A recursive scan of files of any kind for credentials and addresses, for use before a release."""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import urllib.parse
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# What must not be in a release.
PATTERNS = {
    "credential in a query": re.compile(r"(?i)[?&](?:amp;)?(?:api[_-]?key|access[_-]?token|token|password|secret|signature|auth)=(?!X+(?:[&\s\"'<>\\]|$))[^&\s\"'<>\\]+"),
    "credential": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16}|xox[baprs]-[A-Za-z0-9-]{12,})"),
    "private key": re.compile(r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    "ip address": re.compile(r"(?<![\d.])(?!127\.0\.0\.1(?![\d.])|0\.0\.0\.0(?![\d.]))(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
}


def kinds_in(text: str) -> set[str]:
    """The kinds of a text, URL-decoded up to four times."""
    for _ in range(4):
        text = urllib.parse.unquote(text)
    return {kind for kind, rx in PATTERNS.items() if rx.search(text)}


def strings_of(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    """(place, string) of all strings in a file: members of archives, tables of databases, values of JSON, cells of CSV, else its text."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for member in z.namelist():
                yield from strings_of(f"{name}!{member}", z.read(member))
        return
    if data[:16] == b"SQLite format 3\x00":
        base = sqlite3.connect(":memory:")
        base.deserialize(data)
        for (table,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
            for row in base.execute(f'SELECT * FROM "{table}"'):
                yield from ((f"{name}!{table}", v) for v in row if isinstance(v, str))
        base.close()
        return
    text = data.decode("utf-8", "replace")
    if name.endswith(".csv"):
        yield from ((name, cell) for row in csv.reader(io.StringIO(text)) for cell in row)
        return
    if name.endswith((".json", ".jsonl")):
        for part in text.splitlines() if name.endswith("l") else [text]:
            try:
                todo = [json.loads(part)] if part.strip() else []
            except ValueError:
                yield name, part
                continue
            while todo:
                v = todo.pop()
                if isinstance(v, str):
                    yield name, v
                else:
                    todo.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
        return
    yield name, text


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, kind): what each file below a folder, or a member of it, must not hold. Values are never returned."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = {(place, kind) for path, data in zip(part.path, part.content) for place, s in strings_of(path.rsplit("/", 1)[-1], bytes(data)) for kind in kinds_in(s)}
            yield pd.DataFrame(sorted(found), columns=["file", "kind"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInPandas(scan, "file string, kind string")
