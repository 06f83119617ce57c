"""Effects, expectations, metrics, controls against numpy on small made libraries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteplane.operators import crew, expectation, inference, library, metrics, portrait, quality, recommend, ridge_crew, splits
from tasteplane.operators.roles import ALL_ROLES, BELOW_THE_LINE, PRODUCT_ROLES, with_roles

LIB = "upload_id string, film_id long, title string, year int, vote_average double, vote_count int, country string, genres array<string>, rating double, logged_date date, in_diary boolean, rewatches int, preference double"
CREDITS = "film_id long, role string, person_id long"


def planted(n=200, bonus=1.5, seed=1):
    """Every fifth film is directed by person 1 and rated higher; others have directors of their own, editors recur."""
    import datetime

    rng = np.random.default_rng(seed)
    films, credits = [], []
    for i in range(n):
        va = float(np.round(rng.uniform(4, 9), 1)) if i % 17 else None
        base = 2.0 + 0.15 * (va or 6.0) + rng.normal(0, 0.3) + (bonus if i % 5 == 0 else 0)
        rating = float(np.clip(np.round(base * 2) / 2, 0.5, 5))
        day = datetime.date(2023, 1, 1) + datetime.timedelta(days=int(i * 4))
        films.append(("u", i, f"t{i}", 1970 + i % 40 if i % 13 else None, va, int(10 ** (i % 5)), ["JP", "US", None][i % 3], ["Horror"] if i % 2 else ["Drama", "War"], rating, day if i % 29 else None, i % 2 == 0, i % 3 if i % 2 == 0 else 0, rating))
        credits += [(i, "director", 1 if i % 5 == 0 else 100 + i), (i, "editor", 500 + i % 12), (i, "actor", 900 + i % 7)]
    return films, credits


@pytest.fixture(scope="module")
def data(spark):
    films, credits = planted()
    return spark.createDataFrame(films, LIB).cache(), spark.createDataFrame(credits, CREDITS).cache(), films, credits


def numpy_shrink(groups):
    """groups: list of arrays -> (k, within, effects)"""
    n = np.array([len(g) for g in groups], float)
    every = np.concatenate(groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    ssb = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups)
    total, count = n.sum(), len(groups)
    n0 = (total - (n**2).sum() / total) / (count - 1) if count > 1 else 0
    if count < 2 or total <= count or n0 <= 0:
        k = np.inf
    else:
        msw, msb = ssw / (total - count), ssb / (count - 1)
        k = 0.0 if msw <= 0 else msw / max((msb - msw) / n0, 1e-9)
    return k, every.var(ddof=1), [g.mean() * (0 if np.isinf(k) else len(g) / (len(g) + k)) for g in groups]


def test_effects_equal_numpy(data):
    lib, credits, films, raw = data
    rows = expectation.fit_predict(lib, lib, "simple").withColumn("residual", F.col("rating") - F.col("expected"))
    got = {(r.role, r.person_id): r for r in crew.effects(rows, credits).collect()}
    usable = [(f[4], f[8]) for f in films if f[4] is not None]
    slope, intercept = np.polyfit(*map(np.array, zip(*usable, strict=True)), 1)
    mean = np.mean([f[8] for f in films])
    residual = {f[1]: f[8] - (intercept + slope * f[4] if f[4] is not None else mean) for f in films}
    for role in ("director", "editor", "actor"):
        people = {}
        for film, r, p in raw:
            if r == role:
                people.setdefault(p, []).append(residual[film])
        ids = sorted(people)
        k, within, effects = numpy_shrink([np.array(people[p]) for p in ids])
        for p, e in zip(ids, effects, strict=True):
            assert got[role, p].effect == pytest.approx(e, abs=1e-9) and got[role, p].stderr == pytest.approx(np.sqrt(within / len(people[p])))
    assert got["director", 1].effect == max(r.effect for r in got.values()) > 0.5


def test_no_spread_within_groups_means_no_shrinkage(spark):
    rows = spark.createDataFrame([("u", f, 2.0 if f < 6 else -0.5) for f in range(12)], "upload_id string, film_id long, residual double")
    credits = spark.createDataFrame([(f, "editor", 1 if f < 6 else 2) for f in range(12)], CREDITS)
    e = {r.person_id: (r.effect, r.k) for r in crew.effects(rows, credits).collect()}
    assert e == {1: (2.0, 0.0), 2: (-0.5, 0.0)}
    lone = crew.effects(rows, spark.createDataFrame([(f, "editor", f) for f in range(12)], CREDITS)).collect()
    assert all(r.effect == 0 and r.k == float("inf") for r in lone)


def test_combinations(spark):
    fitted = spark.createDataFrame([("u", "editor", 1, 1.0, 0.5), ("u", "editor", 2, -2.0, 1.0), ("u", "writer", 3, 0.5, 0.0)], "upload_id string, role string, person_id long, effect double, stderr double")
    credits = spark.createDataFrame([(9, "editor", 1), (9, "editor", 2), (9, "writer", 3), (8, "writer", 77)], CREDITS)
    rows = spark.createDataFrame([("u", 9), ("u", 8)], "upload_id string, film_id long")
    value = lambda how, across: [r.adjustment for r in crew.adjustments(rows, credits, fitted, how, across).collect()]
    assert value("mean", "mean") == [0.0] and value("max", "max") == [-2.0] and value("max", "sum") == [-1.5]
    assert value("mean", "sum_scaled") == [pytest.approx(0.0)]
    assert value("weighted", "sum") == [pytest.approx((1 / 0.25 - 2) / (1 / 0.25 + 1) + 0.5)]


def test_ridge_equals_closed_form(data):
    lib, _, films, _ = data
    got = {r.feature: r.coefficient for r in expectation.ridge_fit(lib).collect()}
    names = sorted(set(got) - {"1"})
    x = []
    for f in films:
        cell = {"average": f[4] or 0.0, "votes": np.log1p(f[5]), "missing": float(f[4] is None), f"country:{f[6] or '??'}": 1.0, f"decade:{(f[3] or 0) // 10 * 10}": 1.0} | {f"genre:{g}": 1.0 for g in f[7]}
        x.append([cell.get(n, 0.0) for n in names])
    x, y = np.array(x), np.array([f[8] for f in films])
    xc = x - x.mean(0)
    b = np.linalg.solve(xc.T @ xc + 10 * np.eye(len(names)), xc.T @ (y - y.mean()))
    assert [got[n] for n in names] == pytest.approx(b.tolist(), abs=1e-9)
    assert got["1"] == pytest.approx(y.mean() - x.mean(0) @ b)


def test_few_rows_fall_back_to_the_mean(spark, data):
    few = data[0].limit(10)
    p = expectation.fit_predict(few, few)
    assert len({round(r.expected, 9) for r in p.collect()}) == 1
    flat = few.withColumn("vote_average", F.lit(5.0))
    assert expectation.simple_fit(flat).first().slope == 0


def test_joint_ridge_equals_leave_one_out(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    y = x @ np.array([1, -1, 0.5, 0, 0, 2.0]) + rng.normal(0, 0.5, 40)
    sparse = lambda xs, ys: ridge_crew.sparse_ridge(*np.nonzero(xs), xs[np.nonzero(xs)], ys, xs.shape[1])
    alpha, b = sparse(x, y)

    def solve(a, xs, ys):
        xc = xs - xs.mean(0)
        w = np.linalg.solve(xc.T @ xc + a * np.eye(6), xc.T @ (ys - ys.mean()))
        return w, ys.mean() - xs.mean(0) @ w

    errors = {}
    for a in ridge_crew.ALPHAS:
        e = []
        for i in range(40):
            keep = np.arange(40) != i
            w, c = solve(a, x[keep], y[keep])
            e.append((y[i] - x[i] @ w - c) ** 2)
        errors[a] = np.mean(e)
    assert alpha == min(errors, key=errors.get) and b == pytest.approx(solve(alpha, x, y)[0])
    wide = np.where(rng.random((10, 30)) < 0.5, rng.random((10, 30)), 0)
    few = rng.random(10)
    alpha, b = sparse(wide, few)
    xc = wide - wide.mean(0)
    assert b == pytest.approx(np.linalg.solve(xc.T @ xc + alpha * np.eye(30), xc.T @ (few - few.mean())))
    tall = np.vstack([wide] * 4)  # both sides of the system agree
    alpha, b = sparse(tall, np.tile(few, 4))
    xc = tall - tall.mean(0)
    assert b == pytest.approx(np.linalg.solve(xc.T @ xc + alpha * np.eye(30), xc.T @ (np.tile(few, 4) - few.mean())))


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    p, a = np.round(rng.random(53), 2), np.round(rng.random(53) * 10) / 2
    rows = spark.createDataFrame([("u", i, float(p[i]), float(a[i])) for i in range(53)], "upload_id string, film_id long, predicted double, actual double")
    s = metrics.score(rows, ["upload_id"]).first()
    order = sorted(range(53), key=lambda i: (-p[i], i))
    assert s.headline_precision == pytest.approx(np.mean(a[order[:20]] >= 4)) and s.gate_precision == pytest.approx(np.mean(a >= 4.5))
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    assert s.spearman == pytest.approx(np.corrcoef(rank(p), rank(a))[0, 1]) and s.mae == pytest.approx(np.abs(p - a).mean()) and s.rmse == pytest.approx(np.sqrt(((p - a) ** 2).mean()))
    e = p - a
    assert s.mae_centred == pytest.approx(np.abs(e - e.mean()).mean())
    sizes = [r.n for r in metrics.calibration(rows, ["upload_id"]).orderBy("bin").collect()]
    assert sizes == [len(c) for c in np.array_split(np.arange(53), 5)]
    assert metrics.calibration(rows.limit(4), ["upload_id"]).count() == 0
    flat = rows.withColumn("predicted", F.lit(1.0))
    assert metrics.spearman(flat, ["upload_id"]).first().spearman == 0
    assert metrics.variance_explained(rows, ["upload_id"]).first().explained == pytest.approx(1 - (e**2).sum() / ((a - a.mean()) ** 2).sum())
    assert metrics.variance_explained(rows.withColumn("actual", F.lit(2.0)), ["upload_id"], centred=True).first().explained_centred == 0


def test_splits(data):
    lib = data[0]
    t = splits.temporal_split(lib, "2024-01-01")
    assert t.filter("block = 'train' and logged_date >= '2024-01-01'").count() == 0 and splits.dropped_undated(lib).first().dropped == lib.filter("logged_date is null").count()
    r = splits.random_split(lib)
    assert r.filter("block = 'train'").count() == int(0.7 * lib.count())
    s = splits.shuffled_ratings(lib)
    assert sorted(x.rating for x in s.collect()) == sorted(x.rating for x in lib.collect()) and s.join(lib.select("film_id", F.col("rating").alias("r0")), "film_id").filter("rating <> r0").count() > 50


def test_planted_director_is_found_and_shuffling_kills_it(data):
    lib, credits, *_ = data
    directors = credits.filter("role = 'director'")
    real = inference.shuffle_test(lib, directors, threshold=0.25).first()
    assert real.real_above == 1 and real.shuffled_above == 0 and real.collapsed
    p = inference.significance(lib, directors, permutations=30).first()
    assert p.person_id == 1 and 0 < p.p_value <= 2 / 31 and p.effect > p.critical


def test_bootstrap_sees_the_better_predictor(data):
    lib, credits, *_ = data
    split = splits.random_split(lib)
    train, test = split.filter("block = 'train'"), split.filter("block = 'test'")
    from tasteplane.plans import ladder

    rows = ladder.predictions(split, credits, {n: ladder.LADDER[n] for n in ("director", "global_mean")}).cache()
    out = ladder.gate_pairs(rows, (("director", "global_mean"),), "explained", 200).first()
    assert out.difference > 0.2 and out.ci_low > 0 and out.significant and out.p_positive > 0.95
    same = ladder.gate_pairs(rows, (("director", "director"),), "gate", 50).first()
    assert same.difference == same.ci_low == same.ci_high == 0 and not same.significant
    layers = {r.layer: r for r in inference.decomposition(split, credits, resamples=40).collect()}
    assert layers["director"].difference == max(r.difference for k, r in layers.items() if k != "combined") and layers["director"].helps
    assert test.count() and train.count()


def test_sweep_detects_large_effects_only(data):
    lib, credits, *_ = data
    cells = inference.synthetic_sweep(lib, credits, "actor", sizes=(0.0, 2.0), counts=(28, 29), trials=4, first=1)
    rates = {r.size: r.rate for r in cells.groupBy("size").agg(F.avg("rate").alias("rate")).collect()}
    assert rates[2.0] == 1 and rates[0.0] < 0.8
    assert {r.size: r.floor for r in inference.floor_for(cells).collect()}[2.0] == 28


def test_attribution(data):
    lib, credits, films, _ = data
    doubled = credits.union(credits.filter("role = 'director' and person_id = 1").select("film_id", F.lit("composer").alias("role"), F.lit(77).cast("long").alias("person_id")))
    rows = expectation.fit_predict(lib, lib, "simple").withColumn("residual", F.col("rating") - F.col("expected"))
    some = doubled.filter("role in ('composer', 'editor')")
    out = {(r.role, r.person_id): r for r in ridge_crew.attribution(crew.effects(rows, doubled).filter("role in ('composer', 'editor')"), ridge_crew.fit(rows, some, 1.0), ridge_crew.fit(rows, doubled.filter("role in ('composer', 'editor', 'director')"), 1.0)).collect()}
    r = out["composer", 77]
    assert r.ridge_with_director == pytest.approx(r.ridge_without_director / 2, rel=0.1) or r.verdict == "no effect to attribute"
    flagged = {(x.role, x.person_id): x.director_id for x in crew.inseparability(rows, doubled).collect()}
    assert flagged["composer", 77] == 1 and flagged["editor", 500] is None
    assert films


def test_recommendation_cap_and_nulls(spark, data):
    lib, credits, *_ = data
    films = lib.select("film_id", "title", "year", F.coalesce("vote_average", F.lit(6.0)).alias("vote_average"), "vote_count", "country", "genres")
    seen = lib.filter("film_id < 120")
    fit = expectation.simple_fit(seen)
    rows = expectation.simple_predict(seen, fit).withColumn("residual", F.col("rating") - F.col("expected"))
    editors = credits.filter("role = 'editor'")
    fitted = crew.effects(rows, editors)
    known = credits.filter("film_id <> 132").union(spark.createDataFrame([(127, "director", 1)], CREDITS))
    out = recommend.recommendations(films, seen, known, fitted, lambda r: expectation.simple_predict(r, fit)).cache()
    assert out.filter("film_id < 120 or vote_count < 20 or film_id = 132").count() == 0
    assert out.filter("film_id = 127").first().director_is_familiar is True and out.filter("film_id = 124").first().director_is_familiar is False
    top = recommend.top(out, 10).collect()
    assert len(top) == 10 and max(sum(1 for t in top if t.reason_person_id == p) for p in {t.reason_person_id for t in top}) <= 2
    assert all(a.crew_adjustment >= b.crew_adjustment - 1e-9 for a, b in zip(sorted(top, key=lambda t: t.place), sorted(top, key=lambda t: t.place)[1:], strict=False))
    s = recommend.summary(recommend.top(out, 10)).first()
    assert 0 <= s.novelty <= 1 and 0 <= s.non_obviousness <= 1


def test_portrait_and_quality_on_empty_libraries(spark, data):
    lib, credits, *_ = data
    none = lib.limit(0)
    for part in portrait.portrait(none, credits, none.withColumn("expected", F.lit(0.0))).values():
        assert part.count() == 0
    assert quality.resolution_report(spark.createDataFrame([], "upload_id string, film_id long, match_method string")).count() == 0
    r = quality.resolution_report(spark.createDataFrame([("u", None, "television")], "upload_id string, film_id long, match_method string")).first()
    assert r.resolution_rate == 0 and r.resolution_rate_excluding_television == 0 and r.fuzzy_rate == 0


def test_roles(spark):
    rows = spark.createDataFrame([(1, 1, "Sound", "Music"), (1, 2, "Camera", "Editor"), (1, 3, "Editing", "Editor"), (1, 4, "Writing", "Novel")], "film_id long, person_id long, department string, job string")
    assert {(r.person_id, r.role) for r in with_roles(rows, keep_unmodelled=True).collect()} == {(1, "composer"), (2, None), (3, "editor"), (4, None)}
    assert with_roles(rows).count() == 2 and len(BELOW_THE_LINE) == 11 and len(ALL_ROLES) == 12 and PRODUCT_ROLES[0] == "actor"
    m = library.crew_map(spark.createDataFrame([(1, "editor", 3), (1, "editor", 2), (1, "editor", 3)], CREDITS)).first()
    assert m.crew == {"editor": [2, 3]}


def test_ridge_by_components_equals_the_joint_design(spark, monkeypatch):
    """Blocks without a common film, and columns solved in slices, give the coefficients and the penalty of the whole design."""
    rng = np.random.default_rng(5)
    credits = [(f, "editor" if p % 2 else "writer", p) for b, (n, k) in enumerate(((30, 8), (6, 20))) for f in range(100 * b, 100 * b + n) for p in range(50 * b, 50 * b + k) if rng.random() < 0.4]
    films = {f: float(rng.normal()) for f in [*range(30), *range(100, 106), 900, 901]}
    n = {}
    for _, r, p in credits:
        n[r, p] = n.get((r, p), 0) + 1
    names, ids = sorted(k for k in n if n[k] >= 2), sorted(films)
    x = np.array([[float((f, *k) in set(credits)) for k in names] for f in ids])
    alpha, b = ridge_crew.sparse_ridge(*np.nonzero(x), x[np.nonzero(x)], np.array([films[f] for f in ids]), len(names))
    rows = spark.createDataFrame([("u", f, r) for f, r in films.items()], "upload_id string, film_id long, residual double")
    people = spark.createDataFrame(credits, "film_id long, role string, person_id long")
    assert {r.component for r in ridge_crew.components(people).collect()} == {0, 100}
    for dense in (8_000, 3):
        monkeypatch.setattr(ridge_crew, "DENSE", dense)
        got = {(r.role, r.person_id): r for r in ridge_crew.fit(rows, people).collect()}
        assert sorted(got) == names and {r.alpha for r in got.values()} == {alpha} and [got[k].n_films for k in names] == [n[k] for k in names]
        assert [got[k].coefficient for k in names] == pytest.approx(list(b), abs=1e-8)


def test_credits_travel_once_for_all_uploads(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 1, -1.0), ("a", 2, 2.0)], "upload_id string, film_id long, residual double")
    people = spark.createDataFrame([(1, "editor", 7), (2, "editor", 7), (1, "director", 9), (2, "director", 9), (3, "editor", 8)], "film_id long, role string, person_id long")
    assert sorted(map(tuple, crew.of_people(rows, people, "residual").filter("role = 'editor'").collect())) == [("editor", 7, "a", 0.5), ("editor", 7, "a", 2.0), ("editor", 7, "b", -1.0)]
    fitted = spark.createDataFrame([("a", "editor", 7, 0.1), ("b", "editor", 7, 0.2)], "upload_id string, role string, person_id long, effect double")
    assert sorted(map(tuple, crew.of_films(fitted, people, "effect", uploads=rows).collect())) == [(1, "editor", 7, "a", 0.1), (1, "editor", 7, "b", 0.2), (2, "editor", 7, "a", 0.1)]
    assert crew.of_films(fitted, people, "effect").count() == 4
    assert sorted(map(tuple, crew.inseparability(rows, people).collect())) == [("a", "editor", 7, 9, 1.0), ("b", "editor", 7, None, 0.0)]


def test_groups_are_summed_by_parts(monkeypatch):
    rng = np.random.default_rng(3)
    films = [np.sort(rng.choice(30, int(k), replace=False)) + 100 for k in rng.integers(1, 9, 12)]
    groups = inference._Groups(np.arange(100, 130), np.array(["editor", "writer"] * 6), np.arange(12), films)
    residuals = rng.normal(size=(30, 4))
    whole = groups.effects(residuals)
    monkeypatch.setattr(inference, "_CELLS", 9)
    assert np.allclose(groups.effects(residuals), whole) and inference._at_once(30) == 1 and whole.shape == (12, 4)
