"""Title, headings, text and links of HTML pages as Column expressions.

A page is scanned as a string, not as a tree.  Script and style ranges are taken
out first, so what stands in them is never found.  Everything but the resolution
of unusual relative links stays in the JVM.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import url as ur

LONG_TEXT = 100_000
#: As many bytes as no string has.
UNBOUNDED = (1 << 31) - 1
MOST_TITLE = MOST_H1 = 400
_ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def encoding(html: Column) -> Column:
    """``utf-8``, ``iso-8859-1``, or ``unknown``, which bars the page. Without a charset in the first 1024 characters it is utf-8."""
    at = F.instr(html, "charset=")
    named = tx.lower_ascii(F.substr(html, F.greatest(at, F.lit(1)), F.lit(40)))
    return F.when((at == 0) | (at > 1025), "utf-8").when(F.contains(named, F.lit("utf-8")), "utf-8").when(F.contains(named, F.lit("iso-8859-1")), "iso-8859-1").otherwise("unknown")


def decode_latin(raw: Column) -> Column:
    """Text of ISO-8859-1 bytes."""
    return F.decode(raw, "ISO-8859-1")


def visible(html: Column) -> Column:
    """Without script and style ranges; one that isn't closed stays."""
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", "")


def strip_tags(c: Column) -> Column:
    """Without tags, white space collapsed; an open tag takes the rest."""
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]*(?:>|$)", ""), r"\s+", " ")


def decode_entities(c: Column) -> Column:
    """Named (HTML 4 and apos) and numeric entities that end in a semicolon; others stay."""
    table = F.create_map(*(F.lit(x) for pair in sorted(_ENTITIES.items()) for x in pair))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z0-9]{2,8});", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        real = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(name.startswith("#"), F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(table, name))
        return F.when((name != "") & sign.isNotNull(), F.concat(sign, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    decoded = tx.let(F.split(c, "&"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), "")))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def clean(c: Column, most: int = LONG_TEXT) -> Column:
    """Tags off, entities decoded, white space collapsed, trimmed; text of ``most`` bytes or more keeps its entities."""
    bare = strip_tags(c)
    return F.when(F.octet_length(bare) >= most, bare).otherwise(tx.trim(F.regexp_replace(decode_entities(bare), r"\s+", " ")))


def tag_content(shown: Column, tag: str) -> Column:
    """What the first such tag holds, uncleaned; the tag is matched by its beginning."""
    return F.regexp_extract(shown, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


def title(shown: Column, most: int = LONG_TEXT) -> Column:
    return clean(tag_content(shown, "title"), most)


def h1(shown: Column, most: int = LONG_TEXT) -> Column:
    return clean(tag_content(shown, "h1"), most)


def meta_description(shown: Column, most: int = LONG_TEXT) -> Column:
    """The content of the first meta tag that names a description; the quotes go when it is trimmed."""
    tag = F.regexp_extract(shown, r'(<meta[^>]*description"[^>]*)>', 1)
    return clean(F.regexp_extract(tag, r"content=(.*)", 1), most)


def body_text(shown: Column, most: int = LONG_TEXT) -> Column:
    """Text after the first ``</h1>``, or else from ``<body`` on; a tag becomes a blank."""
    h, b = F.instr(shown, "</h1>"), F.instr(shown, "<body")
    start = F.when(h > 0, h).otherwise(b)
    bare = F.regexp_replace(F.regexp_replace(F.substr(shown, F.greatest(start, F.lit(1))), r"<[^>]*(?:>|$)", " "), r"\s+", " ")
    return F.when(start > 0, clean(F.substring(bare, 1, most), most)).otherwise("")


def is_exotic(c: Column) -> Column:
    """More than 5 characters of three bytes or more, or (of more than 3) over half of two bytes or more."""
    exotic = F.length(F.regexp_replace(c, r"[^\x{800}-\x{10FFFF}]", ""))
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    total = F.length(c)
    return (exotic > 5) | ((total > 3) & (wide / total > 0.5))


def is_captcha(body: Column) -> Column:
    return F.contains(tx.lower_ascii(body), F.lit("captcha"))


def parse_pages(df: DataFrame, html: str = "html", most: int = LONG_TEXT) -> DataFrame:
    """df with title, h1, meta, text, encoding and should_insert; columns of these names are replaced. ``most`` as in ``clean``; text is cut there."""
    out = df.withColumn("__shown", visible(F.col(html)))
    out = out.withColumns({"title": title(F.col("__shown"), most), "h1": h1(F.col("__shown"), most), "meta": meta_description(F.col("__shown"), most), "text": body_text(F.col("__shown"), most), "encoding": encoding(F.col(html))}).drop("__shown")
    return out.withColumn("should_insert", should_insert())


def should_insert() -> Column:
    """The gate of parsed pages: a known encoding, a title that is neither empty, long nor exotic, no long h1."""
    t = F.col("title")
    return F.coalesce((F.col("encoding") != "unknown") & (t != "") & (F.octet_length(t) <= MOST_TITLE) & ~is_exotic(t) & (F.octet_length("h1") <= MOST_H1), F.lit(False))


def links(df: DataFrame, html: str = "html", url: str = "url", *keep: str, exact: bool = False) -> DataFrame:
    """(keep, host, path, target_host, target_path, text, nofollow, internal) of each anchor in order (pos).

    ``exact`` resolves every kind of relative link, by Python; without it dot segments stay.
    Links to other hosts without text are dropped, internal ones are kept for the graph.
    """
    anchor = F.explode(F.filter(F.transform(F.regexp_extract_all(F.col(html), F.lit(r"(?s)(<a .*?</a>)"), F.lit(1)), lambda a, i: F.struct((i + 1).alias("pos"), a.alias("a"))), lambda s: s["a"].rlike('href="[^"]*"')))
    rows = df.select(*keep, F.col(url).alias("__url"), anchor.alias("__s"))
    a = F.col("__s.a")
    href = F.regexp_extract(a, r'href="([^"]*)"', 1)
    absolute = ur.resolve(F.col("__url"), href) if exact else ur.resolve_path(F.col("__url"), href)
    rows = rows.withColumn("__to", absolute)
    to = F.col("__to")
    return rows.select(
        *keep,
        F.col("__s.pos").alias("pos"),
        ur.host(F.col("__url")).alias("host"),
        ur.path_with_query(F.col("__url")).alias("path"),
        ur.host(to).alias("target_host"),
        F.concat(decode_entities(ur.path(to)), F.when(ur.query(to) != "", F.concat(F.lit("?"), decode_entities(ur.query(to)))).otherwise("")).alias("target_path"),
        clean(F.regexp_extract(a, r'(?s)href="[^"]*"[^>]*>(.*)</a>', 1)).alias("text"),
        F.regexp_extract(a, r'rel="([^"]*)"', 1).contains("nofollow").alias("nofollow"),
    ).withColumn("internal", F.col("host") == F.col("target_host")).where((F.col("target_host") != "") & (F.col("internal") | (F.col("text") != "")))


def internal_links(linked: DataFrame) -> DataFrame:
    """(source, target) of a host's followed internal links."""
    return linked.where("internal AND NOT nofollow").select(F.concat("host", "path").alias("source"), F.concat("target_host", "target_path").alias("target"))
