"""Train and test blocks, their description, and deterministic permutations.

Random order comes from hashes of the film and a seed, so it is the same on any cluster layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasteplane.schema import SEED, TEMPORAL_CUT


def temporal_split(library: DataFrame, cut: str = TEMPORAL_CUT) -> DataFrame:
    """``block``: train before the cut, test from it on; undated rows go."""
    return library.filter(F.col("logged_date").isNotNull()).withColumn("block", F.when(F.col("logged_date") < F.to_date(F.lit(cut)), "train").otherwise("test"))


def dropped_undated(library: DataFrame) -> DataFrame:
    return library.groupBy("upload_id").agg(F.count_if(F.col("logged_date").isNull()).alias("dropped"))


def shuffle_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def random_split(library: DataFrame, share: float = 0.7, seed: int = SEED) -> DataFrame:
    """The first floor(share * n) films of each upload in hash order are train."""
    w = W.partitionBy("upload_id")
    place = F.row_number().over(w.orderBy(shuffle_key(seed, "film_id"), "film_id"))
    n = F.count("*").over(w)
    return library.withColumn("block", F.when(place <= F.floor(F.lit(share) * n), "train").otherwise("test"))


def shuffled_ratings(library: DataFrame, seed: int = SEED) -> DataFrame:
    """Ratings dealt anew among the films of each upload: the multiset stays, the pairing goes."""
    w = W.partitionBy("upload_id")
    rows = library.withColumn("_at", F.row_number().over(w.orderBy("film_id")))
    dealt = library.select("upload_id", F.col("rating").alias("_rating"), F.row_number().over(w.orderBy(shuffle_key(seed, "film_id"), "film_id")).alias("_at"))
    return rows.join(dealt, ["upload_id", "_at"]).withColumn("rating", F.col("_rating")).drop("_at", "_rating")


def block_stats(split: DataFrame) -> DataFrame:
    """Per upload and block: n, mean, sd, whole-star share, top share."""
    r = F.col("rating")
    return split.groupBy("upload_id", "block").agg(
        F.count("*").alias("n"),
        F.avg(r).alias("mean"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"),
        F.avg((r == F.floor(r)).cast("double")).alias("whole_star_share"),
        F.avg((r >= 5).cast("double")).alias("top_rating_share"),
    )


def drift(split: DataFrame) -> DataFrame:
    """How the test block's ratings differ from the train block's."""
    s = block_stats(split)
    side = lambda b: s.filter(F.col("block") == b).select("upload_id", *[F.col(c).alias(f"{b}_{c}") for c in ("n", "mean", "sd", "whole_star_share", "top_rating_share")])
    both = side("train").join(side("test"), "upload_id")
    return both.withColumns({"mean_shift": F.col("test_mean") - F.col("train_mean"), "top_rating_share_shift": F.col("test_top_rating_share") - F.col("train_top_rating_share")})
