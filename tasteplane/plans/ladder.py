"""The ladder of predictors: each maps train and test rows to test rows with ``predicted``."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.operators import crew, expectation, metrics, ridge_crew
from tasteplane.operators.roles import BELOW_THE_LINE

#: six variants of the crew model: expectation, combination within roles, target
VARIANTS = (("simple", "mean", "rating"), ("rich", "mean", "rating"), ("rich", "max", "rating"), ("rich", "weighted", "rating"), ("simple", "weighted", "rating"), ("rich", "mean", "preference"))
GATE_PAIRS = (("crew", "director"), ("crew", "context"), ("crew", "genre"), ("crew_ridge", "director"), ("crew", "crew_ridge"), ("genre", "director"))


#: fits of a train block that is still in use, for the rungs share them
_fits: WeakKeyDictionary = WeakKeyDictionary()


def context_fit(train: DataFrame, target: str = "rating") -> DataFrame:
    """The ridge on context of a train block: a few coefficients an upload, computed once for all rungs."""
    held = _fits.setdefault(train, {})
    if target not in held:
        held[target] = expectation.ridge_fit(train, target, diary=target == "preference").persist()
    return held[target]


def global_mean(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    return test.join(train.groupBy("upload_id").agg(F.avg("rating").alias("predicted")), "upload_id")


def popularity(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    return expectation.fit_predict(train, test, "simple").withColumnRenamed("expected", "predicted")


def context(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    return expectation.ridge_predict(test, context_fit(train)).withColumnRenamed("expected", "predicted")


def people(train: DataFrame, test: DataFrame, credits: DataFrame, kind: str = "rich", combine: str = "mean", across: str = "mean", target: str = "rating") -> DataFrame:
    """Shrunken effects of the people in ``credits`` on top of an expectation; both are fitted on train."""
    if kind == "simple":
        fit = expectation.simple_fit(train, target)
        on_train, on_test = expectation.simple_predict(train, fit), expectation.simple_predict(test, fit)
    else:
        diary = target == "preference"
        fit = context_fit(train, target)
        on_train, on_test = expectation.ridge_predict(train, fit, diary=diary), expectation.ridge_predict(test, fit, diary=diary)
    fitted = crew.effects(on_train.withColumn("residual", F.col(target) - F.col("expected")), credits)
    return crew.predicted(on_test, crew.adjustments(test, credits, fitted, combine, across))


def genres(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    """Genres as if they were people, on the simple expectation (on context they would add nothing)."""
    both = train.select("film_id", "genres").union(test.select("film_id", "genres")).distinct()
    as_people = both.select("film_id", F.lit("genre").alias("role"), F.explode(F.array_distinct("genres")).alias("person_id")).distinct()
    return people(train, test, as_people.withColumn("person_id", F.xxhash64("person_id")), "simple")


def of_role(role: str):
    return lambda train, test, credits: people(train, test, credits.filter(F.col("role") == role))


def below_the_line(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    return people(train, test, credits.filter(F.col("role").isin(*BELOW_THE_LINE)))


def ridge(train: DataFrame, test: DataFrame, credits: DataFrame) -> DataFrame:
    some = credits.filter(F.col("role").isin(*BELOW_THE_LINE))
    fit = context_fit(train)
    on_train = expectation.ridge_predict(train, fit).withColumn("residual", F.col("rating") - F.col("expected"))
    return ridge_crew.predicted(expectation.ridge_predict(test, fit), some, ridge_crew.fit(on_train, some))


LADDER = {"global_mean": global_mean, "popularity": popularity, "context": context, "genre": genres, "director": of_role("director"), "cast": of_role("actor"), "crew": below_the_line}
FULL_LADDER = {**LADDER, "crew_ridge": ridge}


def predictions(split: DataFrame, credits: DataFrame, names: dict | None = None) -> DataFrame:
    """predictor, upload_id, film_id, predicted, actual of every rung on the test block."""
    train, test = split.filter("block = 'train'"), split.filter("block = 'test'")
    out = None
    for name, rung in (names or LADDER).items():
        rows = rung(train, test, credits).select(F.lit(name).alias("predictor"), "upload_id", "film_id", "predicted", F.col("rating").alias("actual"))
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate(split: DataFrame, credits: DataFrame, names: dict | None = None) -> DataFrame:
    return metrics.score(predictions(split, credits, names), ["predictor", "upload_id"])


def gate_pairs(rows: DataFrame, pairs=GATE_PAIRS, metric: str = "gate", resamples: int = 2_000) -> DataFrame:
    """Paired bootstrap of named predictor pairs over ``predictions`` rows."""
    from tasteplane.operators.inference import compare

    out = None
    for a, b in pairs:
        side = lambda name, as_: rows.filter(F.col("predictor") == name).select("upload_id", "film_id", F.col("predicted").alias(as_), "actual")
        both = side(a, "one").join(side(b, "two").drop("actual"), ["upload_id", "film_id"])
        one = compare(both, metric, resamples).withColumns({"first": F.lit(a), "second": F.lit(b)})
        out = one if out is None else out.unionByName(one)
    return out
