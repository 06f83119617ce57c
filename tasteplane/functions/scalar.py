"""Small column functions: parsing, keys, buckets, rounding. None of them throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasteplane.functions.text import folded


def film_key(name: Column, year: Column) -> Column:
    """Join key of a diary entry and a rating: case-folded trimmed name and year."""
    return F.concat(folded(name), F.lit("::"), F.coalesce(year.cast("string"), F.lit("")))


def parse_year(text: Column) -> Column:
    """An int if the trimmed text is all ASCII digits, else null."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))


def parse_date(text: Column) -> Column:
    """Strict yyyy-MM-dd, else null."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def parse_rating(text: Column) -> Column:
    """Half stars from 0.5 to 5.0, else null. The range is tested before the narrow cast, which would round."""
    v = F.trim(text).try_cast("decimal(10,4)")
    return F.when((v >= 0.5) & (v <= 5) & (v % 0.5 == 0), v.cast("decimal(2,1)"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("yes", "true", "1"), F.lit(False))


def decade(year: Column) -> Column:
    """Start of the decade; 0 for an unknown year."""
    return F.coalesce((F.floor(year / 10) * 10).cast("int"), F.lit(0))


def release_year(date: Column) -> Column:
    head = F.substring(date, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))


def country_of(countries: Column) -> Column:
    first = F.get(countries, 0)
    return F.when(F.length(first) == 2, first)


def preference(rating: Column, in_diary: Column, rewatches: Column) -> Column:
    """The rating, raised by a quarter star a rewatch (three at most) where the diary knows the film."""
    return F.when(in_diary, rating + 0.25 * F.least(rewatches, F.lit(3))).otherwise(rating)


def quantise(x: Column) -> Column:
    """To half stars, ties to even, within the scale."""
    return F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.bround(x * 2) / 2))


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence >= 1), "1.00").otherwise(F.format_string("%.2f", confidence))
