"""Tokens, words, n-grams and snippets as Column expressions.

All of them stay in the JVM. Lengths are in bytes of UTF-8 and lower case is that
of ASCII, as the stored indexes have it.  A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.wordlists import STOP_WORDS

#: White space and ASCII punctuation but for + and #.
_ENDS = " \t\n\x0b\f\r!\"$%&'()*,-./:;<=>?@[\\]^_`{|}~"
#: These without white space.
_SIGN = r"[!-\"$-*,-/:-@\[-`{-~]"
SEPARATOR = r"[ \t,|!]"
MOST_BYTES = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, though ``use`` names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim_signs(c: Column) -> Column:
    """Without punctuation (but + and #) at both ends."""
    return F.regexp_replace(c, f"^{_SIGN}+|{_SIGN}+$", "")


def trim(c: Column) -> Column:
    """Without white space and punctuation (but + and #) at both ends."""
    return F.btrim(c, F.lit(_ENDS))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _limited(words: Column, limit: int | None) -> Column:
    return F.slice(words, 1, limit) if limit else words


def full_text_words(c: Column, limit: int | None = None) -> Column:
    """Lower-case words of 1 to 100 bytes, trimmed; a new line alone does not part words. A split makes bad UTF-8 valid."""
    spaced = F.translate(c, _UPPER + "\t,|!", _LOWER + "    ")  # one pass, and a split at a single sign needs no regex
    return _limited(F.filter(F.transform(F.split(spaced, " "), trim), lambda w: F.octet_length(w).between(1, MOST_BYTES)), limit)


def unique_words(c: Column) -> Column:
    """The set of the full-text words, sorted."""
    return F.sort_array(F.array_distinct(full_text_words(c)))


def _with_parts(w: Column) -> Column:
    whole = F.concat(F.array(w), F.transform(F.split(w, r"[.\-:]"), trim))
    compound = F.contains(w, F.lit(".")) | F.contains(w, F.lit("-")) | F.contains(w, F.lit(":"))
    return F.when(compound, whole).otherwise(F.array(w))


def expanded_words(c: Column) -> Column:
    """Full-text words, each compound (joined by . - or :) followed by its parts; empty parts are kept."""
    return F.flatten(F.transform(full_text_words(c), _with_parts))


def expanded_word_set(c: Column) -> Column:
    """What ``expanded_words`` has, each once and in no certain order: only distinct words are taken apart."""

    def with_parts(words: Column) -> Column:
        compounds = F.filter(words, lambda w: F.contains(w, F.lit(".")) | F.contains(w, F.lit("-")) | F.contains(w, F.lit(":")))
        return F.array_union(words, F.flatten(F.transform(compounds, lambda w: F.transform(F.split(w, r"[.\-:]"), trim))))

    return let(F.array_distinct(full_text_words(c)), with_parts)


def unique_expanded_words(c: Column) -> Column:
    return F.sort_array(expanded_word_set(c))


def tokens(c: Column) -> Column:
    """Words of a single pass: white space inside a token is dropped, one of mere punctuation becomes empty, any length."""
    raw = F.split(F.regexp_replace(lower_ascii(c), r"[\n\r\f\x0B]", ""), SEPARATOR)
    return F.transform(F.filter(raw, lambda w: w != ""), trim_signs)


def is_clean_word(w: Column) -> Column:
    return w.rlike("^[a-z0-9åäö]*$")


def clean_word(w: Column) -> Column:
    return F.regexp_replace(w, "[^a-z0-9åäö]", "")


def clean_words(c: Column, limit: int | None = None) -> Column:
    """The full-text words made of a-z, 0-9, å, ä and ö only."""
    return _limited(F.filter(full_text_words(c), is_clean_word), limit)


def words_without_stopwords(c: Column, limit: int | None = None, stop: frozenset[str] = STOP_WORDS) -> Column:
    return _limited(F.filter(full_text_words(c), lambda w: is_clean_word(w) & ~w.isin(*sorted(stop))), limit)


def ngrams(words: Column, n: int) -> Column:
    """All runs of up to n words, by their start and then their length."""

    def all_(w: Column) -> Column:
        size = F.size(w)
        at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), size - i + 1)), lambda k: F.array_join(F.slice(w, i, k), " "))
        return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), at))).otherwise(F.array().cast("array<string>"))

    return F.when(words.isNotNull(), let(words, all_))


def snippets(c: Column, most: int = 300) -> Column:
    """The words packed into pieces of at most ``most`` bytes; the last word stays with the last piece, whatever its length."""

    def add(s: Column, w: Column) -> Column:
        full = F.octet_length(s["now"]) + F.octet_length(w) > most
        return F.struct(F.when(full, F.concat(s["done"], F.array(trim_space(s["now"])))).otherwise(s["done"]).alias("done"), F.when(full, F.concat(w, F.lit(" "))).otherwise(F.concat(s["now"], w, F.lit(" "))).alias("now"))

    def pack(raw: Column) -> Column:
        last = F.element_at(raw, -1)
        words = F.filter(F.slice(raw, 1, F.size(raw) - 1), lambda w: (w != "") & F.is_valid_utf8(w))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
        end = lambda s: F.concat(s["done"], F.array(trim_space(F.concat(s["now"], F.when(F.is_valid_utf8(last), last).otherwise("")))))
        return F.aggregate(words, start, add, end)

    return F.when(c.isNotNull(), let(F.split(c, SEPARATOR), pack))


def make_snippet(c: Column, most: int = 140) -> Column:
    """The first ``most`` bytes, cut back to a whole character, and an ellipsis where something may be missing."""
    bytes_ = c.cast("binary")
    lead = lambda p: F.conv(F.hex(F.substring(bytes_, p, 1)), 16, 10).cast("int")
    whole = F.lit(most)
    for back in (3, 2, 1):  # a character that begins up to three bytes before the edge may cross it
        length = F.when(lead(most - back + 1) >= 0xF0, 4).when(lead(most - back + 1) >= 0xE0, 3).when(lead(most - back + 1) >= 0xC0, 2).otherwise(1)
        whole = F.when(length > back, most - back).otherwise(whole)
    cut = F.decode(F.substr(bytes_, F.lit(1), whole), "UTF-8")
    return F.when(F.octet_length(c) >= most, F.concat(F.when(F.octet_length(c) > most, cut).otherwise(c), F.lit("..."))).otherwise(c)


def snippet_or_meta(text: Column, meta: Column, most: int = 140) -> Column:
    """The snippet of the text, or of the meta description where there is no text."""
    return make_snippet(F.coalesce(F.nullif(text, F.lit("")), meta), most)


def is_valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c.cast("string"))


def encode_utf8(c: Column) -> Column:
    """Valid text: bad sequences and control signs become ``?``, a cut last character goes."""
    text = F.decode(F.encode(F.make_valid_utf8(c.cast("string")), "UTF-8"), "UTF-8")
    valid = F.is_valid_utf8(c.cast("string"))
    dropped = F.when(valid, text).otherwise(F.regexp_replace(text, "�$", ""))
    return F.regexp_replace(F.regexp_replace(dropped, "�", "?"), r"[\x00-\x1f]", "?")


def chunks(items: Column, size: int) -> Column:
    """The array in pieces of ``size`` elements, the last of which may be shorter."""

    def cut(a: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / size).cast("int"), F.lit(1)) - 1), lambda i: F.slice(a, i * size + 1, F.lit(size)))
        return F.filter(pieces, lambda x: F.size(x) > 0)

    return F.when(items.isNotNull(), let(items, cut))


# --- over rows
def word_counts(df: DataFrame, words: Column, *keys: str) -> DataFrame:
    """(keys, word, n)."""
    return df.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def word_frequency(df: DataFrame, words: Column, *keys: str) -> DataFrame:
    """(keys, word, frequency). Each text carries its own total, so the counts need a single shuffle."""
    rows = df.select(*keys, words.alias("__words")).select(*keys, F.size("__words").alias("__size"), F.explode("__words").alias("word"))
    return rows.groupBy(*keys, "word").agg((F.count(F.lit(1)) / F.first("__size")).alias("frequency"))
