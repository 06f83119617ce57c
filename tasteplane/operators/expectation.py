"""What a rating would be expected to be: least squares on the public average, and ridge on context.

Ridge is solved from its normal equations. Spark sums the products of each row's few non-zero
features per upload; only the (features x features) sums of one upload meet in a task, a number
that the vocabulary of countries, decades and genres bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasteplane.functions import scalar

CONTEXT = ("decade", "country", "genre")
ALPHA, LEAST_ROWS = 10.0, 20


def simple_fit(library: DataFrame, target: str = "rating") -> DataFrame:
    """upload_id, slope, intercept, fallback of rating on vote_average; slope 0 around the mean if it cannot be fitted."""
    x = F.col("vote_average")
    y = F.col(target)
    agg = library.groupBy("upload_id").agg(
        F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(y).alias("fallback"),
    )
    fits = (F.col("n") >= 2) & (F.col("lo") < F.col("hi"))
    return agg.select("upload_id", F.when(fits, F.col("s")).otherwise(0.0).alias("slope"), F.when(fits, F.col("i")).otherwise(F.col("fallback")).alias("intercept"), "fallback")


def simple_predict(library: DataFrame, fit: DataFrame) -> DataFrame:
    """The library with ``expected``; a film without a public average gets the fallback."""
    at = F.when(F.col("vote_average").isNull(), F.col("fallback")).otherwise(F.col("intercept") + F.col("slope") * F.col("vote_average"))
    return library.join(fit, "upload_id").withColumn("expected", at).drop("slope", "intercept", "fallback")


def cells(context: tuple[str, ...] = CONTEXT, diary: bool = False) -> Column:
    """A row's non-zero features as an array of (feature, value); the intercept is feature 1."""
    x: list[tuple[Column, Column]] = [
        (F.lit("1"), F.lit(1.0)),
        (F.lit("average"), F.coalesce("vote_average", F.lit(0.0))),
        (F.lit("votes"), F.log1p(F.coalesce("vote_count", F.lit(0)).cast("double"))),
        (F.lit("missing"), F.col("vote_average").isNull().cast("double")),
    ]
    if diary:
        x.append((F.lit("diary"), F.col("in_diary").cast("double")))
    if "country" in context:
        x.append((F.concat(F.lit("country:"), F.coalesce("country", F.lit("??"))), F.lit(1.0)))
    if "decade" in context:
        x.append((F.concat(F.lit("decade:"), scalar.decade(F.col("year")).cast("string")), F.lit(1.0)))
    out = F.array(*[F.struct(n.alias("feature"), v.cast("double").alias("value")) for n, v in x])
    if "genre" in context:
        genres = F.array_distinct(F.coalesce("genres", F.array().cast("array<string>")))
        out = F.concat(out, F.transform(genres, lambda g: F.struct(F.concat(F.lit("genre:"), g).alias("feature"), F.lit(1.0).alias("value"))))
    return F.filter(out, lambda c: c["value"] != 0)


def features(library: DataFrame, context: tuple[str, ...] = CONTEXT, diary: bool = False) -> DataFrame:
    """Long form of the design: upload_id, film_id, feature, value."""
    return library.select("upload_id", "film_id", F.explode(cells(context, diary)).alias("c")).select("upload_id", "film_id", "c.feature", "c.value")


def _within(context: tuple[str, ...]):
    """Whether a feature is one of the context: country, decade and genre have their name before a colon."""
    return lambda name: name.split(":", 1)[0] not in CONTEXT or name.split(":", 1)[0] in context


def _solve(alpha: float, least: int, context: tuple[str, ...] = CONTEXT):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["a"].map(_within(context)) & pdf["b"].map(_within(context))]
        names = sorted(set(pdf["a"]) - {"y"})
        at = {n: i for i, n in enumerate(names)}
        gram, moment = np.zeros((len(names), len(names))), np.zeros(len(names))
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"], strict=True):
            if b == "y":
                if a != "y":
                    moment[at[a]] = s
            else:
                gram[at[a], at[b]] = gram[at[b], at[a]] = s
        one = at["1"]
        coefficients = np.zeros(len(names))
        if gram[one, one] < least:  # too few rows: the mean
            coefficients[one] = moment[one] / gram[one, one]
        else:
            penalty = np.full(len(names), alpha)
            penalty[one] = 0
            coefficients = np.linalg.solve(gram + np.diag(penalty), moment)
        return pd.DataFrame({"upload_id": pdf["upload_id"].iloc[0], "feature": names, "coefficient": coefficients})

    return solve


def _sums(library: DataFrame, target: str, context: tuple[str, ...], diary: bool) -> DataFrame:
    """upload_id, a, b, s: sums of the products of features a and b, or of a and the target (b is y)."""
    # a row makes its own products; nothing but their sums is shuffled
    row = F.concat(cells(context, diary), F.array(F.struct(F.lit("y").alias("feature"), F.col(target).cast("double").alias("value"))))
    rows = library.select("upload_id", row.alias("row"))
    pairs = rows.select("upload_id", "row", F.explode("row").alias("p")).select("upload_id", "p", F.explode("row").alias("q"))
    pairs = pairs.filter((F.col("p.feature") <= F.col("q.feature")) | (F.col("q.feature") == "y"))
    return pairs.groupBy("upload_id", F.col("p.feature").alias("a"), F.col("q.feature").alias("b")).agg(F.sum(F.col("p.value") * F.col("q.value")).alias("s"))


def ridge_fit(library: DataFrame, target: str = "rating", context: tuple[str, ...] = CONTEXT, alpha: float = ALPHA, diary: bool = False, least: int = LEAST_ROWS) -> DataFrame:
    """upload_id, feature, coefficient; the intercept (feature 1) is not penalised."""
    return _sums(library, target, context, diary).groupBy("upload_id").applyInPandas(_solve(alpha, least), "upload_id string, feature string, coefficient double")


def ridge_fits(library: DataFrame, contexts: dict[str, tuple[str, ...]], target: str = "rating", alpha: float = ALPHA, least: int = LEAST_ROWS) -> DataFrame:
    """upload_id, feature, coefficients: in the order of ``contexts``, 0 where a context has no such feature. All from one pass over the library."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_solve(alpha, least, c)(pdf).set_index("feature")["coefficient"] for c in contexts.values()]
        table = pd.concat(each, axis=1).fillna(0.0)
        return pd.DataFrame({"upload_id": pdf["upload_id"].iloc[0], "feature": table.index, "coefficients": table.to_numpy().tolist()})

    return _sums(library, target, CONTEXT, False).groupBy("upload_id").applyInPandas(solve, "upload_id string, feature string, coefficients array<double>")


def ridge_predict_all(library: DataFrame, fits: DataFrame, contexts: dict[str, tuple[str, ...]]) -> DataFrame:
    """The library with what each fit of ``ridge_fits`` expects, under its name in ``contexts``; a feature is looked up once for all."""
    maps = fits.groupBy("upload_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficients"))).alias("_b"))
    known = F.filter(F.transform(cells(), lambda c: F.struct(c["value"].alias("value"), F.try_element_at("_b", c["feature"]).alias("b"))), lambda c: c["b"].isNotNull())
    rows = library.join(maps, "upload_id").withColumn("_known", known)
    term = lambda i: lambda total, c: total + c["value"] * F.get(c["b"], F.lit(i))
    return rows.select(*library.columns, *[F.aggregate("_known", F.lit(0.0), term(i)).alias(name) for i, name in enumerate(contexts)])


def ridge_predict(library: DataFrame, fit: DataFrame, context: tuple[str, ...] = CONTEXT, diary: bool = False) -> DataFrame:
    """The library with ``expected``; features that the fit has not seen count nothing."""
    # one map an upload, as large as the vocabulary
    maps = fit.groupBy("upload_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("_b"))
    term = lambda total, c: total + c["value"] * F.coalesce(F.try_element_at("_b", c["feature"]), F.lit(0.0))
    return library.join(maps, "upload_id").withColumn("expected", F.aggregate(cells(context, diary), F.lit(0.0), term)).drop("_b")


def fit_predict(train: DataFrame, rows: DataFrame, kind: str = "rich", target: str = "rating", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """``rows`` with ``expected`` from a model fitted on ``train``; kind is simple or rich."""
    if kind == "simple":
        return simple_predict(rows, simple_fit(train, target))
    diary = target == "preference"  # as a feature of ratings it would leak the split
    return ridge_predict(rows, ridge_fit(train, target, context, diary=diary), context, diary)
