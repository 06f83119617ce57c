"""Empirical-Bayes effects of people: residuals pooled by (role, person) and shrunk by a one-way random-effects fit.

Everything is keyed by upload and role, so all roles of all uploads are fitted in one plan:
group sums, one aggregate a role, and a join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tasteplane.operators.layout import partitions

REPORTABLE_FILMS = 12


def group_stats(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n, raw (mean), ssw (squares around the mean); ``residuals`` has ``residual``."""
    return residuals.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("residual").alias("raw"), (F.var_pop("residual") * F.count("*")).alias("ssw"))


def variance_components(groups: DataFrame, by: list[str]) -> DataFrame:
    """Per family: k (within over between variance; infinite if there is no sign of groups), within (pooled variance).

    k is infinite with fewer than two groups, with no more observations than groups, or when
    n0 <= 0; it is 0 when groups do not vary within. Between is floored at 1e-9.
    """
    n = F.col("n").cast("double")
    # residuals lie around 0, so squares around their mean follow from sums without loss; no family has to meet in one task
    agg = groups.groupBy(*by).agg(
        F.sum(n).alias("total"), F.count("*").alias("groups"), F.sum(n * n).alias("squares"), F.sum("ssw").alias("ssw"), F.sum(n * F.col("raw")).alias("s1"), F.sum(n * F.col("raw") * F.col("raw")).alias("s2"),
    ).withColumn("ssb", F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")))
    total, count = F.col("total"), F.col("groups")
    n0 = (total - F.col("squares") / total) / F.when(count > 1, count - 1)
    msw = F.col("ssw") / F.when(total > count, total - count)
    msb = F.col("ssb") / F.when(count > 1, count - 1)
    between = F.greatest((msb - msw) / F.when(n0 > 0, n0), F.lit(1e-9))
    k = F.when((count < 2) | (total <= count) | (n0 <= 0), F.lit(float("inf"))).when(msw <= 0, 0.0).otherwise(msw / between)
    within = F.when(total > 1, (F.col("ssw") + F.col("ssb")) / (total - 1)).otherwise(0.0)
    return agg.select(*by, k.alias("k"), within.alias("within"))


def shrunk(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups with effect = raw * n / (n + k) and its standard error."""
    out = groups.join(variance_components(groups, by), by)
    weight = F.when(F.col("k") == float("inf"), 0.0).otherwise(F.col("n") / (F.col("n") + F.col("k")))
    return out.withColumns({"effect": F.col("raw") * weight, "stderr": F.when(F.col("within") > 0, F.sqrt(F.col("within") / F.col("n"))).otherwise(0.0)}).drop("ssw", "within")


def effects(residuals: DataFrame, credits: DataFrame) -> DataFrame:
    """upload_id, role, person_id, n, raw, k, effect, stderr. ``residuals``: upload_id, film_id, residual; ``credits``: film_id, role, person_id."""
    # kept, as the groups are read for their families and again for themselves, and credits are dealt to make them
    groups = group_stats(of_people(residuals, credits, "residual"), ["upload_id", "role", "person_id"]).persist()
    return shrunk(groups, ["upload_id", "role"])


def _columns(rows: DataFrame, by: list[str], values: tuple[str, ...]) -> DataFrame:
    """One row a key: arrays of upload_id (sorted, so equal sets are equal bytes) and of ``values`` in the same order."""
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("upload_id", *values))).alias("_h"))
    return held.select(*by, *[F.col(f"_h.{c}").alias(f"_{c}") for c in ("upload_id", *values)])


def _exploded(rows: DataFrame, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    names = ("upload_id", *values)
    return rows.select(*keys, F.explode(F.arrays_zip(*[f"_{c}" for c in names])).alias("_x")).select(*keys, *[F.col(f"_x._{c}").alias(c) for c in names])


def of_people(rows: DataFrame, credits: DataFrame, *values: str) -> DataFrame:
    """upload_id, role, person_id and ``values`` of each film that a person made, dealt by person: a credit travels once for all uploads."""
    held = credits.select("film_id", "role", "person_id").join(_columns(rows, ["film_id"], values), "film_id").drop("film_id")
    return _exploded(held.repartition(partitions(rows.sparkSession), "role", "person_id"), ["role", "person_id"], values)


def of_films(fitted: DataFrame, credits: DataFrame, *values: str, uploads: DataFrame | None = None) -> DataFrame:
    """upload_id, film_id, role, person_id and ``values`` of the fitted people of each film (of ``uploads``: upload_id, film_id), dealt by film, likewise."""
    keys = ["film_id", "role", "person_id"]
    held = credits.select(*keys).join(_columns(fitted, ["role", "person_id"], values), ["role", "person_id"]).repartition(partitions(fitted.sparkSession), "film_id")
    if uploads is None:
        return _exploded(held, keys, values)
    rated = uploads.groupBy("film_id").agg(F.sort_array(F.collect_list("upload_id")).alias("_rated"))
    rows = _exploded(held.join(rated, "film_id"), [*keys, "_rated"], values)
    return rows.filter(F.array_contains("_rated", F.col("upload_id"))).drop("_rated")


def inseparability(residuals: DataFrame, credits: DataFrame) -> DataFrame:
    """upload_id, role, person_id, director_id, overlap: people all of whose films (two or more) share one director. Ties: the smallest id."""
    directors = credits.filter("role = 'director'").groupBy("film_id").agg(F.array_sort(F.collect_set("person_id")).alias("_d"))
    uploads = residuals.groupBy("film_id").agg(F.array_sort(F.collect_list("upload_id")).alias("_u"))
    people = credits.filter("role <> 'director'").select("film_id", "role", "person_id").join(uploads, "film_id").join(directors, "film_id", "left")
    people = people.select("role", "person_id", "_u", F.coalesce("_d", F.array().cast("array<long>")).alias("_d")).repartition("role", "person_id")
    # whoever directed all of a person's films is in all of their lists
    held = people.select("role", "person_id", F.explode("_u").alias("upload_id"), "_d").groupBy("upload_id", "role", "person_id").agg(F.collect_list("_d").alias("_d"))
    shared = F.aggregate(F.slice("_d", 2, F.greatest(F.size("_d") - 1, F.lit(0))), F.get("_d", 0), lambda x, y: F.array_intersect(x, y))
    director = F.when(F.size("_d") >= 2, F.array_min(shared))
    return held.select("upload_id", "role", "person_id", director.alias("director_id"), F.when(director.isNotNull(), 1.0).otherwise(0.0).alias("overlap"))


def combined(how: str) -> Column:
    if how == "mean":
        return F.avg("effect")
    if how == "max":
        return F.max_by("effect", F.struct(F.abs("effect"), -F.col("person_id")))
    if how == "weighted":
        weight = 1 / F.pow(F.greatest("stderr", F.lit(1e-6)), 2)
        return F.sum(F.col("effect") * weight) / F.sum(weight)
    raise ValueError(f"unknown combination {how}")


def across_roles(how: str) -> Column:
    if how == "max":
        return F.max_by("e", F.struct(F.abs("e"), "role"))
    if how == "sum":
        return F.sum("e")
    if how == "sum_scaled":
        return F.sum("e") / F.sqrt(F.count("*"))
    return F.avg("e")


def per_role(rows: DataFrame, credits: DataFrame, fitted: DataFrame, combine: str = "mean") -> DataFrame:
    """upload_id, film_id, role, e: the people of known effect of a role in a film of ``rows``, as one."""
    known = of_films(fitted, credits, "effect", *(("stderr",) if combine == "weighted" else ()), uploads=rows)
    return known.groupBy("upload_id", "film_id", "role").agg(combined(combine).alias("e"))


def adjustments(rows: DataFrame, credits: DataFrame, fitted: DataFrame, combine: str = "mean", across: str = "mean") -> DataFrame:
    """upload_id, film_id, adjustment for the films of ``rows`` with at least one person of known effect."""
    return per_role(rows, credits, fitted, combine).groupBy("upload_id", "film_id").agg(across_roles(across).alias("adjustment"))


def predicted(expected: DataFrame, adjustment: DataFrame) -> DataFrame:
    """Rows with ``predicted``: the expectation, moved by the adjustment where there is one."""
    return expected.join(adjustment, ["upload_id", "film_id"], "left").withColumn("predicted", F.col("expected") + F.coalesce("adjustment", F.lit(0.0))).drop("adjustment")


def ranked(fitted: DataFrame, least_films: int = REPORTABLE_FILMS) -> DataFrame:
    """Effects with their rank by size within (upload, role), and whether there are films enough to report them."""
    w = W.partitionBy("upload_id", "role").orderBy(F.abs("effect").desc(), "person_id")
    return fitted.withColumns({"rank": F.row_number().over(w), "reportable": F.col("n") >= least_films})
