"""Data quality: resolution report, collisions, crew coverage, audit samples and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasteplane.functions import scalar
from tasteplane.functions.text import normalize
from tasteplane.operators.roles import BELOW_THE_LINE
from tasteplane.operators.splits import shuffle_key
from tasteplane.schema import SEED

POOL_FROM, EXACT_SAMPLE = 15, 50


def resolution_report(entries: DataFrame) -> DataFrame:
    """One row an upload over (upload_id, film_id, match_method): counts and rates, 0 where a denominator is 0."""
    m = F.col("match_method")
    out = entries.groupBy("upload_id").agg(
        F.count("*").alias("entries"), F.count_if(F.col("film_id").isNotNull()).alias("resolved"), F.count_if(m == "television").alias("television"),
        F.count_if(m == "unresolved").alias("unresolved"), F.count_if(m.isin("trigram", "dominant")).alias("fuzzy"),
    )
    return out.withColumns({
        "resolution_rate": scalar.ratio(F.col("resolved"), F.col("entries")),
        "resolution_rate_excluding_television": scalar.ratio(F.col("resolved"), F.col("entries") - F.col("television")),
        "fuzzy_rate": scalar.ratio(F.col("fuzzy"), F.col("resolved")),
    })


def counts_by(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy("upload_id", *keys).agg(F.count("*").alias("n"))


def catalog_gaps(films: DataFrame) -> DataFrame:
    """Films of the whole catalog, and how many lack each column."""
    return films.agg(F.count("*").alias("films"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("year", "vote_average", "vote_count", "country")])


def diary_join_rate(ratings: DataFrame, diary: DataFrame, key: str = "film_key") -> DataFrame:
    """Distinct diary keys, how many of them a rating has, and the rate."""
    keys = diary.select("upload_id", key).distinct()
    rated = ratings.select("upload_id", key).distinct().withColumn("_r", F.lit(1))
    out = keys.join(rated, ["upload_id", key], "left").groupBy("upload_id").agg(F.count("*").alias("diary_films"), F.count("_r").alias("matched"))
    return out.withColumns({"unmatched": F.col("diary_films") - F.col("matched"), "join_rate": scalar.ratio(F.col("matched"), F.col("diary_films"))})


def collisions(entries: DataFrame) -> DataFrame:
    """Films that more than one title of an upload claims, with the claiming titles."""
    claims = entries.filter(F.col("film_id").isNotNull()).groupBy("upload_id", "film_id").agg(F.count("*").alias("claims"), F.array_sort(F.collect_list("name")).alias("names"))
    return claims.filter("claims > 1")


def role_coverage(films: DataFrame, credits: DataFrame, *groups: str) -> DataFrame:
    """Films with each role, and the share of all films, overall or by group columns of ``films``."""
    held = films.select("film_id", *groups).distinct()
    total = held.groupBy(*groups).agg(F.count("*").alias("films"))
    per = held.join(credits, "film_id").groupBy(*groups, "role").agg(F.count_distinct("film_id").alias("with_role"), F.count_distinct("person_id").alias("people"))
    both = per.join(total, list(groups)) if groups else per.join(F.broadcast(total), how="cross")  # one row
    return both.withColumn("rate", scalar.ratio(F.col("with_role"), F.col("films")))


def crew_sizes(films: DataFrame, credits: DataFrame) -> DataFrame:
    """Credit rows, exact median crew size (mean of the middle two), and films with several people in one role."""
    # smallest and largest person differ if there are several; crews are counted by size, so no task holds more than the sizes
    roles = credits.groupBy("film_id", "role").agg(F.count("*").alias("n"), (F.min("person_id") < F.max("person_id")).alias("several"))
    each = roles.groupBy("film_id").agg(F.sum("n").alias("n"), F.max(F.coalesce("several", F.lit(False)).cast("long")).alias("several"))
    sizes = each.join(films.select("film_id"), "film_id", "left_semi").groupBy("n").agg(F.count("*").alias("films"), F.sum("several").alias("several"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sizes.agg(F.sum(F.col("n") * F.col("films")).alias("credits"), F.percentile("n", F.lit(0.5), F.col("films")).alias("median_crew"), count("films").alias("films"), count("several").alias("multi_credit_films"))


def pooled_regions(films: DataFrame, least: int = POOL_FROM) -> DataFrame:
    """Countries with enough films by size; the rest pooled as 'other'."""
    n = films.groupBy(F.coalesce("country", F.lit("??")).alias("region")).agg(F.count("*").alias("films"))
    return n.groupBy(F.when(F.col("films") >= least, F.col("region")).otherwise("other").alias("region")).agg(F.sum("films").alias("films"))


def worth_traversing(library: DataFrame, credits: DataFrame, least: int = 3) -> DataFrame:
    """People with enough below-the-line credit rows on resolved films; two such roles on one film count twice. ``credits`` have their role."""
    credits = credits.filter(F.col("role").isin(*BELOW_THE_LINE))
    return library.select("upload_id", "film_id").join(credits, "film_id").groupBy("upload_id", "person_id").agg(F.count("*").alias("credit_rows")).filter(F.col("credit_rows") >= least)


def stratified_sample(entries: DataFrame, size: int = EXACT_SAMPLE, seed: int = SEED) -> DataFrame:
    """Every entry that is not exact, and ``size`` exact ones of each upload in hash order."""
    w = W.partitionBy("upload_id", "match_method").orderBy(shuffle_key(seed, "film_id"), "film_id")
    return entries.withColumn("_at", F.row_number().over(w)).filter((F.col("match_method") != "exact") | (F.col("_at") <= size)).drop("_at")


def auto_verdict(entries: DataFrame) -> DataFrame:
    """'correct' where an exact match agrees in normalised title and year, else 'review'."""
    same = (F.col("match_method") == "exact") & F.col("film_id").isNotNull() & (normalize(F.col("name")) == normalize(F.col("title"))) & (F.col("query_year") == F.col("year"))
    return entries.withColumn("verdict", F.when(F.coalesce(same, F.lit(False)), "correct").otherwise("review"))


def tally(verdicts: DataFrame) -> DataFrame:
    """Per match method: verdict counts, judged, accuracy; unsure ones are not judged. 'resolved' and 'refusals' sum methods."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    groups = F.array(F.col("match_method"), F.when(F.col("match_method").isin("exact", "trigram", "dominant"), "resolved").otherwise("refusals"))
    rows = verdicts.withColumn("method", F.explode(groups)).groupBy("method").agg(
        F.count_if(v == "correct").alias("correct"), F.count_if(v == "wrong").alias("wrong"), F.count_if(v == "unsure").alias("unsure"), F.count_if(~v.isin("correct", "wrong", "unsure")).alias("unfilled"),
    )
    judged = F.col("correct") + F.col("wrong")
    return rows.withColumns({"judged": judged, "total": judged + F.col("unsure") + F.col("unfilled"), "accuracy": scalar.ratio(F.col("correct"), judged)})
