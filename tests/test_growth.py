"""Steps whose cost must not outgrow the tables: what is shuffled, ranked and drawn, with the results of the plain way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteplane.operators import crew, expectation, inference, metrics, quality, recommend
from tasteplane.plans import registry
from tasteplane.plans.bench_views import Views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gate_draws_found_backwards_are_the_same():
    rng = np.random.default_rng(7)
    n, resamples = 400_000, np.arange(1, 1_001)
    hit = (rng.random(n) < 0.3).astype(float)
    orders = [inference._ranked(np.round(rng.normal(3, 1, n), 3)) for _ in range(2)]
    found = inference._gates(orders, hit, resamples, 5, 100)
    some = resamples[::250]
    places = inference.drawn(5, some[:, None], np.arange(n)[None, :]) * n // inference.PRIME
    for order, values in zip(orders, found, strict=True):
        assert values[::250].tolist() == inference._gate(order, hit, places, 100).tolist()


def test_explained_from_counts():
    rng = np.random.default_rng(8)
    actual = np.round(rng.random(500) * 9) / 2 + 0.5
    one = actual + rng.normal(0, 1, 500)
    values = inference._explained([one], actual, np.arange(4), 5)[0]
    for r in range(4):
        at = inference.drawn(5, np.int64(r), np.arange(500)) * 500 // inference.PRIME if r else np.arange(500)
        assert values[r] == pytest.approx(1 - (actual - one)[at].var() / actual[at].var())


def test_contexts_from_one_pass(spark):
    library = Views(spark, SF).library()
    contexts = {"none": (), "decade": ("decade",), "all": expectation.CONTEXT}
    rows = expectation.ridge_predict_all(library, expectation.ridge_fits(library, contexts), {f"at_{k}": c for k, c in contexts.items()}).toPandas().set_index(["upload_id", "film_id"])
    for name, context in contexts.items():
        alone = expectation.fit_predict(library, library, context=context).toPandas().set_index(["upload_id", "film_id"])["expected"]
        assert np.allclose(rows[f"at_{name}"], alone.loc[rows.index])


def test_credits_and_ratings_stay_dealt_by_film(spark):
    d = Views(spark, SF)
    assert "Exchange hashpartitioning" not in plan(d.film_credits().join(d.ratings().hint("merge"), "film_id")).split("InMemoryTableScan")[0]


def test_effects_deal_credits_once(spark):
    d = Views(spark, SF)
    fitted = crew.effects(d.ratings().withColumn("residual", F.col("rating") - 3), d.film_credits())
    assert "InMemoryTableScan" in plan(fitted) and "Generate" not in plan(fitted).split("InMemoryTableScan")[0]


def test_gate_ranks_first_rows_only(spark):
    rows = spark.range(500).select((F.col("id") % 1).cast("string").alias("upload_id"), F.col("id").alias("film_id"), (F.col("id") % 7).cast("double").alias("predicted"), (F.col("id") % 5 + 0.5).alias("actual"))
    out = metrics.gate(rows, ["upload_id"])
    assert "WindowGroupLimit" in plan(out)
    best = sorted(rows.collect(), key=lambda r: (-r.predicted, r.film_id))[:100]
    assert out.first().gate_precision == pytest.approx(sum(r.actual >= 4.5 for r in best) / 100)


def test_crew_sizes_reads_credits_once(spark):
    films = spark.createDataFrame([(1,), (2,), (2,), (3,)], "film_id long")
    credits = spark.createDataFrame([(1, "editor", 5), (1, "editor", 6), (1, "writer", 5), (2, "editor", 5), (2, "editor", 5), (9, "editor", 1)], "film_id long, role string, person_id long")
    out = quality.crew_sizes(films, credits)
    assert plan(out).count("Join") == 1
    assert tuple(out.first()) == (5, 2.5, 2, 1)


def test_novelty_of_the_listed_only(spark, monkeypatch):
    seen, novelty = [], recommend.novelty
    monkeypatch.setattr(recommend, "novelty", lambda rows, library: seen.append(rows.count()) or novelty(rows, library))
    registry.QUERIES["non_obviousness"](spark, SF)
    registry.QUERIES["catalog_counters"](spark, SF)
    assert len(seen) == 1 and seen[0] <= 100
