"""The portrait of a library: loyalties, disagreements, revealed preference, blind spots, rating style."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasteplane.functions import scalar

SECTION, VOTE_FLOOR = 8, 50


def loyalties(library: DataFrame, credits: DataFrame, limit: int = SECTION) -> DataFrame:
    """Most-watched people: films per (role, person); ties by role, then id."""
    n = library.select("upload_id", "film_id").join(credits, "film_id").groupBy("upload_id", "role", "person_id").agg(F.count("*").alias("films"))
    w = W.partitionBy("upload_id").orderBy(F.desc("films"), "role", "person_id")
    return n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def disagreements(expected: DataFrame, limit: int = SECTION, floor: int = VOTE_FLOOR) -> DataFrame:
    """Films rated furthest above and below expectation among those with enough votes, and how many had too few."""
    rows = expected.withColumns({"residual": F.col("rating") - F.col("expected"), "ok": F.coalesce("vote_count", F.lit(0)) >= floor})
    rows = rows.withColumn("excluded", F.count_if(~F.col("ok")).over(W.partitionBy("upload_id"))).filter("ok")
    by = W.partitionBy("upload_id")
    rows = rows.withColumns({"top": F.row_number().over(by.orderBy(F.desc("residual"), "film_id")), "bottom": F.row_number().over(by.orderBy("residual", F.desc("film_id")))})
    side = F.when((F.col("top") <= limit) & (F.col("residual") > 0), "above").when((F.col("bottom") <= limit) & (F.col("residual") < 0), "below")
    place = F.when(side == "above", F.col("top")).otherwise(F.col("bottom"))
    return rows.withColumns({"direction": side, "place": place}).filter(F.col("direction").isNotNull()).select("upload_id", "direction", "place", "film_id", "residual", "excluded")


def rewatched(library: DataFrame, limit: int = SECTION) -> DataFrame:
    w = W.partitionBy("upload_id").orderBy(F.desc("rewatches"), F.desc("rating"), "film_id")
    return library.filter(F.col("rewatches") > 0).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("upload_id", "place", "film_id", "rewatches", "rating")


def revealed_preference(library: DataFrame) -> DataFrame:
    """Of top-rated films: how many, how many the diary knows, how many of those were never seen again, and the revisit rate."""
    top = F.col("rating") >= 5
    out = library.groupBy("upload_id").agg(
        F.count_if(top).alias("top_rated_total"), F.count_if(top & F.col("in_diary")).alias("top_rated_in_diary"), F.count_if(top & F.col("in_diary") & (F.col("rewatches") == 0)).alias("top_rated_never_revisited"),
    )
    return out.withColumn("revisit_rate", F.when(F.col("top_rated_in_diary") > 0, 1 - F.col("top_rated_never_revisited") / F.col("top_rated_in_diary")).otherwise(0.0))


def blind_spots(library: DataFrame, least: int = 5, most: int = 60, limit: int = SECTION) -> DataFrame:
    """Slices (decade, country, genre) rated above the library's mean but thinly watched, by lift."""
    mean = library.groupBy("upload_id").agg(F.avg("rating").alias("library_mean"))
    labels = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("year") != 0, F.concat(F.lit("decade "), scalar.decade(F.col("year")).cast("string"), F.lit("s"))),
                F.when(F.col("country") != "", F.concat(F.lit("country "), F.col("country"))),
            ),
            F.transform(F.coalesce("genres", F.array().cast("array<string>")), lambda g: F.concat(F.lit("genre "), g)),
        )
    )
    slices = library.select("upload_id", "rating", F.explode(labels).alias("label")).groupBy("upload_id", "label").agg(F.count("*").alias("films"), F.avg("rating").alias("mean_rating"))
    found = slices.filter(F.col("films").between(least, most)).join(mean, "upload_id").filter(F.col("mean_rating") > F.col("library_mean")).withColumn("lift", F.col("mean_rating") - F.col("library_mean"))
    w = W.partitionBy("upload_id").orderBy(F.desc(F.round("lift", 9)), "label")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def rating_style(library: DataFrame) -> DataFrame:
    r = F.col("rating")
    out = library.groupBy("upload_id").agg(
        F.avg((r == F.floor(r)).cast("double")).alias("whole_star_share"), F.count_distinct(r).alias("levels_used"), F.lit(10).alias("levels_available"),
        F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"), F.avg((r >= 5).cast("double")).alias("top_rating_share"),
    )
    return out.withColumn("is_decisive", F.col("whole_star_share") >= 0.6)


def portrait(library: DataFrame, credits: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    return {
        "loyalties": loyalties(library, credits), "disagreements": disagreements(expected), "rewatched": rewatched(library),
        "revealed": revealed_preference(library), "blind_spots": blind_spots(library), "style": rating_style(library),
    }
