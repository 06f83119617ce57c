"""Unrated films scored by the people of known effect who made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasteplane.operators import crew
from tasteplane.operators.roles import BELOW_THE_LINE

LEAST_VOTES, CAP, FAMILIAR_FILMS = 20, 2, 1


def unrated(films: DataFrame, library: DataFrame, least_votes: int = LEAST_VOTES) -> DataFrame:
    """upload_id and the columns of films that the upload has not rated, with a public average and votes enough."""
    eligible = films.filter((F.coalesce("vote_count", F.lit(0)) >= least_votes) & F.col("vote_average").isNotNull())
    uploads = library.select("upload_id").distinct()
    return eligible.join(uploads, how="cross").join(library.select("upload_id", "film_id"), ["upload_id", "film_id"], "left_anti")


def novelty(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Adds ``percentile``: the share of the library's vote counts that do not exceed the candidate's. Distinct counts are ranked, not films."""
    mine = library.groupBy("upload_id", F.coalesce("vote_count", F.lit(0)).alias("v")).agg(F.count("*").alias("c"))
    asked = candidates.select("upload_id", F.coalesce("vote_count", F.lit(0)).alias("v")).distinct().withColumn("c", F.lit(0).cast("long"))
    both = mine.unionByName(asked).groupBy("upload_id", "v").agg(F.sum("c").alias("c"))
    below = F.sum("c").over(W.partitionBy("upload_id").orderBy("v").rangeBetween(W.unboundedPreceding, 0))
    total = F.sum("c").over(W.partitionBy("upload_id"))
    ranks = both.select("upload_id", F.col("v").alias("_v"), F.when(total > 0, below / total).otherwise(0.0).alias("percentile"))
    c = candidates.withColumn("_v", F.coalesce("vote_count", F.lit(0)))
    return c.join(ranks, ["upload_id", "_v"]).drop("_v")


def scoreable(films: DataFrame, library: DataFrame, credits: DataFrame, fitted: DataFrame, combine: str = "mean", across: str = "mean", least_votes: int = LEAST_VOTES) -> DataFrame:
    """Of ``unrated`` the rows with a below-the-line person of known effect, with their adjustment and reason.

    They are reached from the effects through credits, so films and uploads are not multiplied. The
    reason is the person of largest effect (ties: role order, then id); ``n_known`` people are known.
    """
    eligible = films.filter((F.coalesce("vote_count", F.lit(0)) >= least_votes) & F.col("vote_average").isNotNull())
    credits = credits.join(eligible.select("film_id"), "film_id", "left_semi")
    known = crew.of_films(fitted, credits, "effect", *(("stderr",) if combine == "weighted" else ()))
    below = F.col("role").isin(*BELOW_THE_LINE)
    order = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(BELOW_THE_LINE)], F.lit(99))
    best = F.min(F.when(below, F.struct((-F.abs("effect")).alias("size"), order.alias("ord"), "person_id", "role", "effect")))
    per_role = known.groupBy("upload_id", "film_id", "role").agg(crew.combined(combine).alias("e"), best.alias("b"), F.count_if(below).alias("n"))
    per_film = per_role.groupBy("upload_id", "film_id").agg(crew.across_roles(across).alias("adjustment"), F.min("b").alias("b"), F.sum("n").alias("n_known")).filter("n_known > 0")
    out = per_film.join(library.select("upload_id", "film_id"), ["upload_id", "film_id"], "left_anti").join(eligible, "film_id")
    return out.withColumns({"reason_person_id": F.col("b.person_id"), "reason_role": F.col("b.role"), "reason_effect": F.col("b.effect")}).drop("b")


def director_familiarity(candidates: DataFrame, credits: DataFrame, library: DataFrame) -> DataFrame:
    """Whether any director of a candidate directed a film of the library; null if its directors are unknown."""
    directors = credits.filter("role = 'director'").select("film_id", "person_id")
    familiar = library.select("upload_id", "film_id").join(directors, "film_id").groupBy("upload_id", "person_id").agg(F.count("*").alias("seen")).filter(F.col("seen") >= FAMILIAR_FILMS)
    of = candidates.select("upload_id", "film_id").join(directors, "film_id").join(familiar, ["upload_id", "person_id"], "left")
    answers = of.groupBy("upload_id", "film_id").agg(F.max(F.col("seen").isNotNull()).alias("director_is_familiar"))
    return candidates.join(answers, ["upload_id", "film_id"], "left")


def scored(films: DataFrame, library: DataFrame, credits: DataFrame, fitted: DataFrame, expect) -> DataFrame:
    """Scoreable candidates; ``expect`` maps rows with upload_id and film columns to rows with ``expected``."""
    return expect(scoreable(films, library, credits, fitted)).withColumn("predicted", F.col("expected") + F.col("adjustment")).withColumnRenamed("adjustment", "crew_adjustment")


def recommendations(films: DataFrame, library: DataFrame, credits: DataFrame, fitted: DataFrame, expect) -> DataFrame:
    """``scored`` candidates with their novelty and whether a director of them is familiar."""
    return director_familiarity(novelty(scored(films, library, credits, fitted, expect), library), credits, library)


def known_of(topped: DataFrame, library: DataFrame, credits: DataFrame) -> DataFrame:
    """Novelty and familiarity of a short list of ``scored`` rows, for which no other candidate and no other director is looked at."""
    topped = topped.persist()
    directors = credits.filter("role = 'director'")
    asked = topped.select("film_id").distinct().join(directors, "film_id").select("person_id").distinct()
    return director_familiarity(novelty(topped, library), directors.join(asked, "person_id", "left_semi"), library)


def top(recommended: DataFrame, n: int, by: str = "crew_adjustment", cap: int = CAP) -> DataFrame:
    """First n by adjustment or score with at most ``cap`` a reason person: the cap by rank equals the greedy walk."""
    value: Column = F.round(by, 9)
    capped = recommended.withColumn("_in", F.row_number().over(W.partitionBy("upload_id", F.coalesce("reason_person_id", F.lit(0))).orderBy(value.desc(), "film_id"))).filter(F.col("_in") <= cap)
    return capped.withColumn("place", F.row_number().over(W.partitionBy("upload_id").orderBy(value.desc(), "film_id"))).filter(F.col("place") <= n).drop("_in")


def summary(topped: DataFrame) -> DataFrame:
    """Mean novelty percentile of the list, and the share of it, where directors are known, that no familiar director made (null if none is known)."""
    return topped.groupBy("upload_id").agg(F.avg("percentile").alias("novelty"), F.avg((~F.col("director_is_familiar")).cast("double")).alias("non_obviousness"))


def counters(films: DataFrame, library: DataFrame, recommended: DataFrame) -> DataFrame:
    """Per upload: catalog size, films already rated, scoreable films, and the share of the catalog that can be scored."""
    rated = library.join(films.select("film_id"), "film_id", "left_semi").groupBy("upload_id").agg(F.count_distinct("film_id").alias("already_rated"))
    scoreable = recommended.groupBy("upload_id").agg(F.count("*").alias("scoreable"))
    out = rated.join(scoreable, "upload_id", "left").join(films.agg(F.count("*").alias("catalog_films")), how="cross")
    return out.withColumn("scoreable", F.coalesce("scoreable", F.lit(0))).withColumn("coverage", F.when(F.col("catalog_films") > 0, F.col("scoreable") / F.col("catalog_films")).otherwise(0.0))


def directors_of(payloads: DataFrame) -> DataFrame:
    """film_id, role, person_id of the directors in stored payloads: familiarity for films whose credits are not in the tables."""
    crew_rows = payloads.select("film_id", F.explode("p.credits.crew").alias("m")).filter((F.col("m.job") == "Director") & F.col("m.id").isNotNull())
    return crew_rows.select("film_id", F.lit("director").alias("role"), F.col("m.id").cast("long").alias("person_id")).distinct()


def gaps(one: DataFrame, two: DataFrame, limit: int) -> DataFrame:
    """Where two predictors disagree most about the same films: one minus two, by size."""
    both = one.select("upload_id", "film_id", F.col("predicted").alias("one")).join(two.select("upload_id", "film_id", F.col("predicted").alias("two")), ["upload_id", "film_id"])
    both = both.withColumn("gap", F.col("one") - F.col("two"))
    w = W.partitionBy("upload_id").orderBy(F.desc(F.round(F.abs("gap"), 9)), "film_id")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
