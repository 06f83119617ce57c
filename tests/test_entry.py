"""The driver's contract: names pair up, and every registered library query runs on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tasteplane.plans import registry

SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.ORACLES) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["library_build", "resolve_choose", "precision_grid", "recommend_top_capped", "ridge_gcv", "audit_tally"])
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_model_queries_do_the_whole_job(spark, monkeypatch):
    from tasteplane.operators import inference
    from tasteplane.plans import ladder
    from tasteplane.plans.bench_views import Views

    d, draws, permutations = Views(spark, SF), [], []
    compare, null = inference.compare, inference.permutation_null
    monkeypatch.setattr(inference, "compare", lambda pairs, metric="gate", resamples=2_000, *a: draws.append(resamples) or compare(pairs, metric, resamples, *a))
    monkeypatch.setattr(inference, "permutation_null", lambda library, credits, n=200, *a: permutations.append(n) or null(library, credits, n, *a))
    registry.QUERIES["decomposition"](spark, SF)
    assert draws == [1_000] * 2
    registry.QUERIES["bootstrap_compare"](spark, SF)
    reference = [("crew", "director"), ("crew", "context"), ("crew", "genre"), ("crew_ridge", "director"), ("crew", "crew_ridge"), ("genre", "director")]
    assert draws[2:] == [2_000] * 6 and list(ladder.GATE_PAIRS) == reference
    roles = {r.role for r in d.film_credits().select("role").distinct().collect()}
    assert {r.role for r in registry.QUERIES["significance"](spark, SF).select("role").distinct().collect()} == roles
    registry.QUERIES["permutation_null"](spark, SF)
    assert permutations == [200] * 2
    cells = registry.QUERIES["synthetic_sweep"](spark, SF).collect()
    people = d.library().select("upload_id", "film_id").join(d.film_credits().filter("role = 'editor'"), "film_id").groupBy("upload_id", "person_id").count()
    counts = {r["count"] for r in people.select("count").distinct().collect()}
    assert {(c["size"], c.n_films) for c in cells} == {(s, n) for s in (0.25, 0.5, 0.75, 1.0, 1.5) for n in counts}
    assert all(c.trials % 12 == 0 for c in cells)
