"""Score curves, dates and response encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_curve(harmonic: Column) -> Column:
    """What a link adds to its target's score."""
    return F.expm1(25 * harmonic) / 50


def grouped_link_curve(score: Column) -> Column:
    """What a link adds in the search of a single site."""
    return F.expm1(20 * score) / 10


def length_bonus(url_length: Column) -> Column:
    """Short URLs first."""
    return (1000 - url_length) / F.lit(500.0)


def documented_domain_curve(score: Column) -> Column:
    return F.expm1(5 * score) + 0.1


def documented_url_curve(score: Column) -> Column:
    return F.expm1(10 * score) + 0.1


def link_url_score(source: Column, target: Column) -> Column:
    return F.greatest(source - target, source / 100)


def link_domain_score(source: Column, target: Column) -> Column:
    return link_url_score(source, target) / 100


def idf(documents: Column, with_word: Column) -> Column:
    return F.when(with_word > 0, F.ln(documents / with_word)).otherwise(F.lit(0.0))


def datetime_number(ts: Column) -> Column:
    """YYYYMMDDhhmmss."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("long")


def date_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def time_number(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss").cast("int")


def iso_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def new_uuid() -> Column:
    return F.uuid()
