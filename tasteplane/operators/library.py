"""The analytic library: ratings joined to films, diary and credits, for all uploads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.functions import scalar
from tasteplane.operators.roles import with_roles


def diary_counts(diary: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the film is in the diary, and how many of its entries are rewatches."""
    return diary.groupBy(*keys).agg(F.sum(F.col("is_rewatch").cast("int")).cast("int").alias("rewatches")).withColumn("in_diary", F.lit(True))


def build_library(ratings: DataFrame, films: DataFrame, diary: DataFrame | None, diary_keys: list[str]) -> DataFrame:
    """One row per (upload, film): catalog columns, rating, date, diary knowledge and preference.

    ``ratings`` carries film_id (resolved). A film absent from the diary has unknown
    rewatches: in_diary false, rewatches 0, preference equal to the rating.
    """
    out = ratings.join(films, "film_id")
    if diary is not None:
        out = out.join(diary_counts(diary, diary_keys), diary_keys, "left")
    else:
        out = out.withColumns({"rewatches": F.lit(None).cast("int"), "in_diary": F.lit(None).cast("boolean")})
    out = out.withColumns({"rewatches": F.coalesce("rewatches", F.lit(0)), "in_diary": F.coalesce("in_diary", F.lit(False)), "rating": F.col("rating").cast("double")})
    return out.withColumn("preference", scalar.preference(F.col("rating"), F.col("in_diary"), F.col("rewatches")))


def resolved_ratings(ratings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Ratings with film_id; of a title rated twice under one URI the first row (by date, then rating) stays."""
    first = ratings.groupBy("upload_id", "source_uri").agg(F.min(F.struct("logged_date", "rating", "name", "year")).alias("r")).select("upload_id", "source_uri", "r.*")
    found = resolutions.filter(F.col("film_id").isNotNull()).select("source_uri", "film_id")
    return first.join(found, "source_uri")


def library_credits(library: DataFrame, credits: DataFrame) -> DataFrame:
    """upload_id, film_id, role, person_id: the modelled credits of each library, distinct."""
    people = with_roles(credits).select("film_id", "role", "person_id").distinct()
    return library.select("upload_id", "film_id").join(people, "film_id").select("upload_id", "film_id", "role", "person_id")


def film_credits(library: DataFrame, credits: DataFrame) -> DataFrame:
    """The same credits once for each film that any library holds."""
    people = with_roles(credits).select("film_id", "role", "person_id").distinct()
    return people.join(library.select("film_id").distinct(), "film_id", "left_semi")


def crew_map(credits: DataFrame) -> DataFrame:
    """film_id, crew: role -> sorted distinct people."""
    per_role = credits.groupBy("film_id", "role").agg(F.array_sort(F.collect_set("person_id")).alias("people"))
    return per_role.groupBy("film_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "people")))).alias("crew"))


def person_names(ids: DataFrame, people: DataFrame) -> DataFrame:
    return people.join(ids.select("person_id").distinct(), "person_id", "left_semi")
