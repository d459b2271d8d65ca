"""Column expressions over requests: URLs, queries, classes, fingerprints, pseudonyms."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys whose values only defeat caches, and keys never kept.
CACHE_BUSTERS = "x cb uniq _ z nocache cachebust rnd rand".split()
PRIVATE_KEYS = "text p_cookieid p_cookie_id p_expirecookie expirecookie p_username p_password password p_email email".split()
# Actions of each request class.
PREFERENCES, LISTS, VIEWS = "editprefs form_editprefs login".split(), "rc rss history archive index wordindex showtop top random links info".split(), "browse raw print source".split()
READ_CLASSES = ("browse", "diff", "search", "meta")


def host(url: Column) -> Column:
    """Host of a URL without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#:]+)", 1)), r"^www\.", "")


def last_segment(url: Column) -> Column:
    """The last segment of a URL's path."""
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.regexp_extract(path, r"([^/]*)$", 1)


def pairs(url: Column) -> Column:
    """array<struct<k, v>> of a URL's query in order, blank values kept, ``amp;`` before keys cut off, not decoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.regexp_replace(F.regexp_extract(p, r"^([^=]*)", 1), r"^amp;", "").alias("k"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("v")))


def first_values(ps: Column) -> Column:
    """map of each key to its first value."""
    keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), 1)["v"]))


def request_class(action: Column, keys: Column, page: Column, has_text: Column) -> Column:
    """save, edit_form, search, prefs, delete, meta, diff, browse or other, the first that fits."""
    a = F.regexp_replace(F.coalesce(action, F.lit("")), "'+$", "")
    has_page = F.coalesce(page, F.lit("")) != ""
    editing = a.isin("edit", "form_edit")
    searching = a.isin("search", "form_search") | F.array_contains(keys, "search") | (F.array_contains(keys, "keywords") & ~has_page)
    cases = [
        (editing & has_text, "save"), (editing, "edit_form"), (searching, "search"), (a.isin(PREFERENCES), "prefs"), (a == "delete", "delete"), (a.isin(LISTS), "meta"),
        (F.array_contains(keys, "diff") | (a == "diff"), "diff"), (has_page | a.isin(VIEWS), "browse"),
    ]
    return reduce(lambda done, case: done.when(case[0], case[1]), cases[1:], F.when(*cases[0])).otherwise("other")


def cache_keys(ps: Column) -> Column:
    """Sorted cache-defeating keys, joined by commas; ``-`` if there are none."""
    used = F.array_sort(F.array_distinct(F.filter(F.transform(ps, lambda p: p["k"]), lambda k: k.isin(CACHE_BUSTERS))))
    return F.coalesce(F.nullif(F.array_join(used, ","), F.lit("")), F.lit("-"))


def key_order(ps: Column) -> Column:
    """The other keys in the order they stand, joined by spaces; ``-`` if there are none."""
    rest = F.filter(F.transform(ps, lambda p: p["k"]), lambda k: ~k.isin(CACHE_BUSTERS))
    return F.coalesce(F.nullif(F.array_join(rest, " "), F.lit("")), F.lit("-"))


def kept_query(ps: Column) -> Column:
    """The query again, without private and cache-defeating keys."""
    kept = F.filter(ps, lambda p: ~p["k"].isin(PRIVATE_KEYS + CACHE_BUSTERS))
    # Decoded and encoded again, so that a value has one form.
    plain = lambda c: F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.array_join(F.transform(kept, lambda p: F.concat(plain(p["k"]), F.lit("="), plain(p["v"]))), "&")


def net24(ip: Column) -> Column:
    """The /24 network of an IPv4 address in dotted form; null if it is none."""
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.concat(F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))


def network(ip: Column, v4: int = 24, v6: int = 48) -> Column:
    """The network of an address of either version, in Arrow batches as version 6 has no expression; null if it is none."""

    def prefix(value: str | None) -> str | None:
        try:
            version = ipaddress.ip_address(value or "").version
            return str(ipaddress.ip_network(f"{value}/{v4 if version == 4 else v6}", strict=False))
        except ValueError:
            return None

    def read(values: pd.Series) -> pd.Series:
        # Each different address once.
        return values.map({value: prefix(value) for value in values.unique()})

    wide = F.pandas_udf(read, "string")(F.when(ip.contains(":"), ip))
    return F.coalesce(net24(ip), wide) if v4 == 24 else F.pandas_udf(read, "string")(ip)


def keyed_digest(value: Column, key: bytes, length: int) -> Column:
    """The first ``length`` hex digits of HMAC-SHA256 with a key that is never stored (at most 64 bytes)."""
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    first = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.encode(value, "UTF-8")), 256)
    return F.left(F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(first)), 256), F.lit(length))
