"""Column expressions over text lines, names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they stand in names and tags.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_DAY = r"(?i)(?<![a-z])(" + "|".join(MONTHS) + r")[a-z]*\s?(\d{1,2})(?!\d)"
MONTH_DAY_IN_NAME = "(?:" + "|".join(m.capitalize() for m in MONTHS) + r")[a-z]*\d{1,2}"
# Fixed value: the end of a line that a writer signed: `-- Name`, with an optional `?` or a short tag in brackets.
SIGNED = r"(?:^|\s)--\s*([A-Za-z][\w.\-]{2,})\s*(?:\?|[\[(][^\])]{1,40}[\])])?\s*$"
# What is scrubbed.
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])"
EMAIL = r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]+"


def skeleton(text: Column) -> Column:
    """A line without what is outside ASCII, white space collapsed: equal for a line and its re-encoded copy."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), r"\s+", " "))


def lines(text: Column) -> Column:
    """The lines of a text, empty ones at the end included."""
    return F.split(text, "\n", -1)


def rstrip(text: Column) -> Column:
    """Without any white space at the end."""
    return F.regexp_replace(text, r"\s+$", "")


def signer(line: Column) -> Column:
    """The name a line is signed with, or null."""
    return F.nullif(F.regexp_extract(rstrip(line), SIGNED, 1), F.lit(""))


def camel_spaced(text: Column) -> Column:
    """Camel case with spaces between its words; the pattern is a fixed value."""
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def date_tags(text: Column) -> Column:
    """Sorted tags like mar13 of the dates in a text, also inside camel-case names; days 1 to 31."""
    spaced = camel_spaced(text)
    months, days = F.regexp_extract_all(spaced, F.lit(MONTH_DAY), 1), F.regexp_extract_all(spaced, F.lit(MONTH_DAY), 2)
    tags = F.zip_with(months, days, lambda m, d: F.when(d.cast("int").between(1, 31), F.concat(F.lower(F.left(m, F.lit(3))), F.lpad(d.cast("int").cast("string"), 2, "0"))))
    return F.array_sort(F.array_distinct(F.array_compact(tags)))


def alias_key(name: Column) -> Column:
    """A name without its date, case and trailing signs: equal for the aliases of one writer."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, MONTH_DAY_IN_NAME, "")), r"[x_.\-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lower(name))


def is_generic(name: Column) -> Column:
    """A bare date or a name of several words says nothing about its writer."""
    return name.rlike(r"^(?i:" + "|".join(MONTHS) + r")[a-z]*\d{1,2}$") | name.contains(" ")


def tokens_of(name: Column) -> Column:
    """Camel-case words of a name, in small letters."""
    return F.split(F.lower(F.trim(F.regexp_replace(camel_spaced(name), r"[_.\-\s]+", " "))), " ")


def has_run(whole: Column, part: Column) -> Column:
    """Whether an array holds another one as a run of neighbours."""
    n, m = F.size(whole), F.size(part)
    return F.when((m == 0) | (m > n), m == 0).otherwise(F.exists(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice(whole, i, m) == part))


def page_key_of(page: Column, prefix: str = "wik~") -> Column:
    """A page name as a key: each byte outside [A-Za-z0-9_.-] as ~hh."""
    def char(c: Column) -> Column:
        hexed = F.lower(F.hex(F.encode(c, "UTF-8")))
        return F.when(c.rlike(r"^[A-Za-z0-9_.\-]$"), c).otherwise(F.regexp_replace(hexed, r"(..)", "~$1"))

    return F.concat(F.lit(prefix), F.array_join(F.transform(F.filter(F.split(page, ""), lambda c: c != ""), char), ""))


def rev_page(rev: Column) -> Column:
    """The page key of a revision id ``page_key@seq``."""
    return F.regexp_extract(rev, r"^(.*)@", 1)


def scrub(text: Column) -> Column:
    """Addresses out: IPv4, IPv6 of three colons or more, e-mail."""
    out = F.regexp_replace(F.regexp_replace(text, IPV4, "<ip>"), IPV6, "<ip>")
    return F.regexp_replace(out, EMAIL, "<email>")


def tsv_escaped(text: Column) -> Column:
    """Backslash, tab and line ends as two signs each."""
    for what, by in (("\\\\", "\\\\\\\\"), ("\t", "\\\\t"), ("\n", "\\\\n"), ("\r", "\\\\r")):
        text = F.regexp_replace(text, what, by)
    return text


def pattern_flags(text: Column, table: dict[str, str]) -> dict[str, Column]:
    """A boolean column for each named pattern of a table: all in one pass over the rows."""
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)) for name, pattern in table.items()}


def variants(text: Column, table: dict[str, str]) -> Column:
    """Sorted names of the patterns that a text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in sorted(table.items())]))


def shingles(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces; none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words; none if there are fewer. No run is ever written out as a text."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))
