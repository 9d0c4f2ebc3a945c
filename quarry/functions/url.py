"""URLs as Column expressions.  A string that is no URL has empty parts, and null gives null."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import let

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_HOST = _HEAD + r"(?:[^/?#@]*@)?([^/?#:]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def raw_host(url: Column) -> Column:
    """The host as written."""
    return F.regexp_extract(url, _HOST, 1)


def host(url: Column) -> Column:
    """The host without a leading ``www.``."""
    return strip_www(raw_host(url))


def strip_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def has_www(url: Column) -> Column:
    return raw_host(url).startswith("www.")


def has_https(url: Column) -> Column:
    return scheme(url) == "https"


def path(url: Column) -> Column:
    """The path, ``/`` where it is empty."""
    p = F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1)
    return F.when((p == "") & (raw_host(url) != ""), "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_with_query(url: Column) -> Column:
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def key(url: Column) -> Column:
    return F.concat(host(url), path(url), query(url))


def hash_input(url: Column) -> Column:
    """What identifies a page: host, path and query, whatever the scheme and ``www.``."""
    return F.concat(host(url), path_with_query(url))


def canonically_different(a: Column, b: Column) -> Column:
    return key(a) != key(b)


def labels(h: Column) -> Column:
    return F.split(h, r"\.")


def host_reverse(h: Column) -> Column:
    return F.array_join(F.reverse(labels(h)), ".")


def host_top_domain(h: Column) -> Column:
    """The registered domain: two labels, or three under co.uk and au; other hosts under uk stay whole."""
    parts = labels(h)
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), ".")
    return F.when(h.endswith(".co.uk") | h.endswith(".au"), last(3)).when(h.endswith(".uk"), h).otherwise(last(2))


def host_reverse_top_domain(h: Column) -> Column:
    parts = labels(h)
    return F.array_join(F.reverse(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))), ".")


def domain_without_tld(h: Column) -> Column:
    """The last label but one."""
    return F.coalesce(F.try_element_at(labels(h), F.lit(-2)), F.lit(""))


def tld(url: Column) -> Column:
    return F.element_at(labels(raw_host(url)), -1)


def rebuild(url: Column, new_scheme: str | None = None, www: bool | None = None) -> Column:
    """The URL with another scheme, or with or without ``www.``."""
    front = F.lit(new_scheme) if new_scheme else scheme(url)
    prefix = F.lit("www." if www else "") if www is not None else F.when(has_www(url), "www.").otherwise("")
    return F.concat(front, F.lit("://"), prefix, host(url), path_with_query(url))


def link_hash_input(source_host: Column, target_url: Column) -> Column:
    return F.concat(source_host, target_url)


def domain_link_hash_input(source_host: Column, target_host: Column) -> Column:
    return F.concat(source_host, target_host)


# --- percent signs
_PERCENT = re.compile(rb"%([0-9a-fA-F]{2})|%%")


def decode_percent(s: str) -> str:
    """Lenient: what is no code stays, ``%%`` is a percent sign, and a NUL ends the string."""
    out = _PERCENT.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else b"%", s.encode())
    return out.split(b"\0")[0].decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def urldecode(c: pa.Array) -> pa.Array:
    return pa.array([None if s is None else decode_percent(s) if "%" in s else s for s in c.to_pylist()], pa.string())


def urlencode(c: Column) -> Column:
    """Percent codes for all but letters, digits and ``-._~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """An array of (key, raw value) in order; pairs without ``=`` are dropped."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.get(F.split(p, "="), F.lit(1)).alias("value")))


def query_map(url: Column) -> Column:
    """The query as a map with raw values, the last of equal keys; see ``urldecode`` for the values."""
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(query_pairs(url), last))


# --- relative links
@F.arrow_udf(T.StringType())
def resolve(base: pa.Array, href: pa.Array) -> pa.Array:
    """The absolute URL of a link on a page; null where there is none."""
    out = []
    for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True):
        try:
            out.append(None if h is None else urljoin(b or "", h.strip()))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def resolve_path(base: Column, href: Column) -> Column:
    """``resolve`` for the usual forms without Python: absolute, ``//host``, ``/path``, ``?query``, ``#part`` and plain names; dot segments stay."""
    origin = F.regexp_extract(base, _HEAD + r"[^/?#]*", 0)
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.concat(origin, F.regexp_extract(path(base), r"^(.*/)", 1))
    return (
        F.when(href.rlike(_HEAD), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )
