"""Expectations, effects, predictions, metrics, recommendations, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteplane.operators import crew, expectation, inference, metrics, recommend, ridge_crew, splits
from tasteplane.operators.roles import BELOW_THE_LINE, with_roles
from tasteplane.plans import bench_views as v
from tasteplane.plans import ladder
from tasteplane.plans._register import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
KEYS = ["upload_id"]


def _expected(d, target: str = "rating"):
    lib = d.library()
    return expectation.fit_predict(lib, lib, "simple", target).withColumn("residual", F.col(target) - F.col("expected"))


@query("ols_expectation", f"WITH {v.LIBRARY}, {v.simple()} SELECT upload_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(fallback, 6) AS fallback FROM fit")
def _(d):
    return rounded(expectation.simple_fit(d.library()))


@query("residuals", f"WITH {v.LIBRARY}, {v.simple()} SELECT upload_id, film_id, round(expected, 6) AS expected, round(rating - expected, 6) AS residual FROM expected")
def _(d):
    return rounded(_expected(d).select("upload_id", "film_id", "expected", "residual"))


@query("preference_target", f"WITH {v.LIBRARY}, {v.simple('preference')} SELECT upload_id, film_id, round(preference - expected, 6) AS residual FROM expected")
def _(d):
    return rounded(_expected(d, "preference").select("upload_id", "film_id", "residual"))


CONSENSUS = f"""WITH {v.LIBRARY}, x AS (SELECT upload_id, vote_average AS a, ln(1 + vote_count) AS b, rating AS y FROM library),
m AS (SELECT upload_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 10 AS aa, var_pop(b) * count(*) + 10 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy FROM x GROUP BY 1),
s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT upload_id, f AS feature, round(CASE f WHEN '1' THEN my - ca * ma - cb * mb WHEN 'average' THEN ca ELSE cb END, 6) AS coefficient FROM s, (VALUES ('1'), ('average'), ('votes')) t(f)"""


@query("ridge_consensus", CONSENSUS)
def _(d):
    return rounded(expectation.ridge_fit(d.library(), context=()))


def _cells(name: str, source: str, diary: bool = False) -> str:
    """The non-zero features of the rows of ``source``: upload_id, film_id, f, v."""
    more = "{'f': 'diary', 'v': in_diary::INT::DOUBLE}, " if diary else ""
    return f"""{name}_all AS (SELECT upload_id, film_id, unnest([{more}{{'f': '1', 'v': 1.0::DOUBLE}}, {{'f': 'average', 'v': vote_average::DOUBLE}}, {{'f': 'votes', 'v': ln(1 + vote_count)}}, {{'f': 'country:' || country, 'v': 1.0}}, {{'f': 'decade:' || (year // 10 * 10), 'v': 1.0}}]
    || list_transform(list_distinct(genres), lambda g: {{'f': 'genre:' || g, 'v': 1.0::DOUBLE}})) AS c FROM {source}),
{name} AS (SELECT upload_id, film_id, c.f AS f, c.v AS v FROM {name}_all WHERE c.v <> 0)"""


def _ridge(source: str = "library", target: str = "rating", diary: bool = False) -> str:
    """CTEs that end in ridge: Gram sums over all of the context, then Gauss-Jordan steps over a matrix of lists."""
    return _cells("feats", source, diary) + f""",
names AS (SELECT upload_id, f, row_number() OVER (PARTITION BY upload_id ORDER BY f) AS i, count(*) OVER (PARTITION BY upload_id) AS p FROM (SELECT DISTINCT upload_id, f FROM feats)),
gram AS (SELECT a.upload_id, a.f AS fa, b.f AS fb, sum(a.v * b.v) AS s FROM feats a JOIN feats b USING (upload_id, film_id) GROUP BY 1, 2, 3),
moment AS (SELECT upload_id, f, sum(v * {target}) AS m FROM feats JOIN {source} USING (upload_id, film_id) GROUP BY 1, 2),
line AS (SELECT a.upload_id, a.i, a.p, list(coalesce(s, 0) + CASE WHEN a.i = b.i AND a.f <> '1' THEN 10 ELSE 0 END ORDER BY b.i) || [any_value(m)] AS r
  FROM names a JOIN names b USING (upload_id) LEFT JOIN gram g ON g.upload_id = a.upload_id AND g.fa = a.f AND g.fb = b.f JOIN moment m ON m.upload_id = a.upload_id AND m.f = a.f GROUP BY 1, 2, 3),
steps AS (SELECT 1 AS k, upload_id, i, p, r FROM line UNION ALL
  SELECT k + 1, s.upload_id, s.i, s.p, CASE WHEN s.i = k THEN list_transform(s.r, lambda x: x / s.r[k]) ELSE list_transform(list_zip(s.r, piv), lambda z: z[1] - s.r[k] * z[2] / piv[k]) END
  FROM (SELECT *, first_value(r) OVER (PARTITION BY upload_id ORDER BY (i = k) DESC) AS piv FROM steps) s WHERE k <= p),
ridge AS (SELECT s.upload_id, n.f AS feature, s.r[s.p + 1] AS coefficient FROM steps s JOIN names n ON n.upload_id = s.upload_id AND n.i = s.i WHERE s.k = s.p + 1)"""


@query("ridge_expectation", f"WITH RECURSIVE {v.LIBRARY}, {_ridge()} SELECT upload_id, feature, round(coefficient, 6) + 0.0::DOUBLE AS coefficient FROM ridge")
def _(d):
    return rounded(expectation.ridge_fit(d.library()))


@query("rich_residuals", f"WITH RECURSIVE {v.LIBRARY}, {_ridge()}, e AS (SELECT upload_id, film_id, sum(f.v * coefficient) AS expected FROM feats f JOIN ridge r USING (upload_id) WHERE r.feature = f.f GROUP BY 1, 2) SELECT upload_id, film_id, round(rating - expected, 5) + 0.0::DOUBLE AS residual FROM library JOIN e USING (upload_id, film_id)")
def _(d):
    lib = d.library()
    return rounded(expectation.fit_predict(lib, lib).withColumn("residual", F.col("rating") - F.col("expected")).select("upload_id", "film_id", "residual"), 5)


def _effect_columns(fitted, *keys):
    return rounded(fitted.select("upload_id", *keys, "n", "raw", F.when(F.col("k") != float("inf"), 1 / (1 + F.col("k"))).otherwise(0.0).alias("weight_of_one"), "effect", "stderr"), 5)


def _effect_sql(keys: str, name: str = "effect") -> str:
    return f"SELECT upload_id, {keys}, n::BIGINT AS n, round(raw, 5) + 0.0::DOUBLE AS raw, round(CASE WHEN isinf(k) THEN 0 ELSE 1 / (1 + k) END, 5) AS weight_of_one, round(effect, 5) + 0.0::DOUBLE AS effect, round(stderr, 5) AS stderr FROM {name}"


@query("crew_effects", f"WITH {v.BASE}, {v.simple()}, {v.effects()} {_effect_sql('role, person_id')}")
def _(d):
    return _effect_columns(crew.effects(_expected(d), d.film_credits()), "role", "person_id")


@query("ranked_effects", f"WITH {v.BASE}, {v.simple()}, {v.effects()} SELECT upload_id, role, person_id, row_number() OVER (PARTITION BY upload_id, role ORDER BY round(abs(effect), 9) DESC, person_id)::INT AS rank, n >= 12 AS reportable FROM effect")
def _(d):
    fitted = crew.effects(_expected(d), d.film_credits()).withColumn("effect", F.round("effect", 9))
    return crew.ranked(fitted).select("upload_id", "role", "person_id", "rank", "reportable")


@query("director_effects", f"WITH {v.BASE}, {v.simple()}, chosen AS (SELECT * FROM lib_credit WHERE role = 'director'), {v.effects(source='chosen')} {_effect_sql('role, person_id')}")
def _(d):
    return _effect_columns(crew.effects(_expected(d), d.film_credits().filter("role = 'director'")), "role", "person_id")


@query("genre_effects", f"WITH {v.LIBRARY}, {v.simple()}, chosen AS (SELECT DISTINCT upload_id, film_id, 'genre' AS role, unnest(genres) AS person_id FROM library), {v.effects(source='chosen')} {_effect_sql('role, person_id')}")
def _(d):
    genres = d.films().select("film_id", F.lit("genre").alias("role"), F.explode(F.array_distinct("genres")).alias("person_id"))
    return _effect_columns(crew.effects(_expected(d), genres), "role", "person_id")


@query("shrinkage_k", f"WITH {v.BASE}, {v.simple()}, {v.effects()} SELECT upload_id, role, round(CASE WHEN isinf(k) THEN -1 ELSE 1 / (1 + k) END, 5) AS weight_of_one, round(within, 5) AS within FROM k_effect")
def _(d):
    rows = _expected(d).select("upload_id", "film_id", "residual").join(d.film_credits(), "film_id")
    parts = crew.variance_components(crew.group_stats(rows, ["upload_id", "role", "person_id"]), ["upload_id", "role"])
    return rounded(parts.select("upload_id", "role", F.when(F.col("k") != float("inf"), 1 / (1 + F.col("k"))).otherwise(-1.0).alias("weight_of_one"), "within"), 5)


@query("inseparability", f"""WITH {v.BASE}, n AS (SELECT upload_id, role, person_id, count(*) AS n FROM lib_credit WHERE role <> 'director' GROUP BY 1, 2, 3),
t AS (SELECT p.upload_id, p.role, p.person_id, x.person_id AS director_id, count(*) AS c FROM lib_credit p JOIN lib_credit x ON p.upload_id = x.upload_id AND p.film_id = x.film_id AND x.role = 'director' WHERE p.role <> 'director' GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY upload_id, role, person_id ORDER BY c DESC, director_id) AS p FROM t)
SELECT n.upload_id, n.role, n.person_id, CASE WHEN n >= 2 AND c = n THEN director_id END AS director_id, CASE WHEN n >= 2 AND c = n THEN 1.0 ELSE 0.0 END::DOUBLE AS overlap FROM n LEFT JOIN b ON n.upload_id = b.upload_id AND n.role = b.role AND n.person_id = b.person_id AND b.p = 1""")
def _(d):
    return crew.inseparability(d.ratings(), d.film_credits())


def _combined(how: str, across: str):
    agg = {"mean": "avg(effect)", "max": "arg_max(effect, (round(abs(effect), 12), -person_id))", "weighted": "sum(effect / power(greatest(stderr, 1e-6), 2)) / sum(1 / power(greatest(stderr, 1e-6), 2))"}[how]
    over = {"mean": "avg(e)", "max": "arg_max(e, (round(abs(e), 12), role))", "sum": "sum(e)", "sum_scaled": "sum(e) / sqrt(count(*))"}[across]
    sql = f"""WITH {v.BASE}, {v.simple()}, {v.effects()}, r AS (SELECT l.upload_id, film_id, role, {agg} AS e FROM lib_credit l JOIN effect USING (upload_id, role, person_id) GROUP BY 1, 2, 3)
SELECT upload_id, film_id, round({over}, 5) + 0.0::DOUBLE AS adjustment FROM r GROUP BY 1, 2"""

    def run(d):
        credits = d.film_credits()
        return rounded(crew.adjustments(d.ratings(), credits, crew.effects(_expected(d), credits), how, across), 5)

    return sql, run


for _name, _how, _over in (("combine_mean", "mean", "mean"), ("combine_max", "max", "mean"), ("combine_weighted", "weighted", "mean"), ("across_sum", "mean", "sum"), ("across_sum_scaled", "mean", "sum_scaled"), ("across_max", "mean", "max")):
    _sql, _run = _combined(_how, _over)
    query(_name, _sql)(_run)

SPLIT = f"split AS (SELECT *, CASE WHEN logged_date < DATE '{v.CUT}' THEN 'train' ELSE 'test' END AS block FROM library WHERE logged_date IS NOT NULL), train AS (SELECT * FROM split WHERE block = 'train'), test AS (SELECT * FROM split WHERE block = 'test')"
#: crew predictions on the test block from effects of the train block, on the simple expectation
PREDICTED = f"""WITH {v.BASE}, {SPLIT}, {v.simple(train='train', rows='split')}, on_train AS (SELECT * FROM expected WHERE block = 'train'),
chosen AS (SELECT * FROM lib_credit WHERE role NOT IN ('director', 'actor')), train_credit AS (SELECT s.* FROM chosen s JOIN train t ON s.upload_id = t.upload_id AND s.film_id = t.film_id), {v.effects(source='train_credit', expected='on_train')},
r AS (SELECT s.upload_id, film_id, role, avg(effect) AS e FROM chosen s JOIN effect USING (upload_id, role, person_id) GROUP BY 1, 2, 3), adj AS (SELECT upload_id, film_id, avg(e) AS adjustment FROM r GROUP BY 1, 2),
pred AS (SELECT x.upload_id, x.film_id, round(x.expected + coalesce(adjustment, 0), 7) AS predicted, x.rating::DOUBLE AS actual FROM expected x LEFT JOIN adj USING (upload_id, film_id) WHERE block = 'test')"""


def _split(d):
    return splits.temporal_split(d.library(), v.CUT)


def _predicted(d):
    s = _split(d)
    rows = ladder.people(s.filter("block = 'train'"), s.filter("block = 'test'"), d.film_credits().filter(F.col("role").isin(*BELOW_THE_LINE)), "simple")
    return rows.select("upload_id", "film_id", F.round("predicted", 7).alias("predicted"), F.col("rating").alias("actual"))


@query("predict_crew", f"{PREDICTED} SELECT upload_id, film_id, round(predicted, 5) AS predicted, actual FROM pred")
def _(d):
    return rounded(_predicted(d), 5)


PLACED = f"{PREDICTED}, placed AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY predicted DESC, film_id) AS place FROM pred)"


@query("precision_at_k", f"{PLACED} SELECT upload_id, round(coalesce(avg((actual >= 4.5)::INT) FILTER (place <= 100), 0), 6) AS gate_precision, round(avg((actual >= 4.5)::INT), 6) AS gate_base FROM placed GROUP BY 1")
def _(d):
    return rounded(metrics.gate(_predicted(d), KEYS))


@query("precision_grid", f"{PLACED} SELECT upload_id, k::INT AS k, t::DOUBLE AS threshold, round(avg((actual >= t)::INT), 6) AS precision FROM placed, (VALUES (10), (20), (50), (100), (200)) a(k), (VALUES (4.0), (4.5), (5.0)) b(t) WHERE place <= k GROUP BY 1, 2, 3")
def _(d):
    return rounded(metrics.precision_grid(_predicted(d), KEYS))


@query("calibration_bins", f"{PREDICTED}, b AS (SELECT *, ntile(5) OVER (PARTITION BY upload_id ORDER BY predicted, film_id)::INT AS bin FROM pred) SELECT upload_id, bin, round(avg(predicted), 5) AS mean_predicted, round(avg(actual), 5) AS mean_actual, count(*)::BIGINT AS n FROM b GROUP BY 1, 2")
def _(d):
    return rounded(metrics.calibration(_predicted(d), KEYS), 5)


@query("spearman", f"""{PREDICTED}, rk AS (SELECT *, rank() OVER (PARTITION BY upload_id ORDER BY predicted) + (count(*) OVER (PARTITION BY upload_id, predicted) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY upload_id ORDER BY actual) + (count(*) OVER (PARTITION BY upload_id, actual) - 1) / 2.0 AS ra FROM pred)
SELECT upload_id, round(CASE WHEN min(predicted) = max(predicted) OR min(actual) = max(actual) THEN 0 ELSE corr(rp::DOUBLE, ra::DOUBLE) END, 5) AS spearman FROM rk GROUP BY 1""")
def _(d):
    return rounded(metrics.spearman(_predicted(d), KEYS), 5)


@query("mae_rmse_centred", f"{PREDICTED}, s AS (SELECT *, predicted - actual AS e, avg(predicted - actual) OVER (PARTITION BY upload_id) AS m FROM pred) SELECT upload_id, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e - m)), 5) AS mae_centred FROM s GROUP BY 1")
def _(d):
    return rounded(metrics.errors(_predicted(d), KEYS), 5)


@query("variance_explained", f"{PREDICTED} SELECT upload_id, round(1 - sum(power(actual - predicted, 2)) / (var_pop(actual) * count(*)), 5) AS explained FROM pred GROUP BY 1")
def _(d):
    return rounded(metrics.variance_explained(_predicted(d), KEYS), 5)


@query("variance_explained_centred", f"{PREDICTED} SELECT upload_id, round(1 - var_pop(actual - predicted) / var_pop(actual), 5) AS explained_centred FROM pred GROUP BY 1")
def _(d):
    return rounded(metrics.variance_explained(_predicted(d), KEYS, centred=True), 5)


def _train(d):
    return _split(d).filter("block = 'train'").drop("block")


UNRATED = f"{PREDICTED.split(', pred AS')[0]}, cand AS (SELECT u.upload_id, f.* FROM film f CROSS JOIN (SELECT DISTINCT upload_id FROM train) u WHERE vote_count >= 20 AND NOT EXISTS (SELECT 1 FROM train t WHERE t.upload_id = u.upload_id AND t.film_id = f.film_id))"


@query("novelty_percentile", f"{UNRATED}, v AS (SELECT upload_id, vote_count AS v, count(*) AS c FROM train GROUP BY 1, 2), w AS (SELECT x.upload_id, x.film_id, sum(CASE WHEN v.v <= x.vote_count THEN c ELSE 0 END) / sum(c) AS p FROM cand x JOIN v USING (upload_id) GROUP BY 1, 2) SELECT upload_id, film_id, round(p, 6) AS percentile FROM w")
def _(d):
    train = _train(d)
    return rounded(recommend.novelty(recommend.unrated(d.films(), train), train).select("upload_id", "film_id", "percentile"))


@query("director_familiarity", f"""{UNRATED}, dir AS (SELECT DISTINCT film_id, person_id FROM credit WHERE role = 'director'), fam AS (SELECT DISTINCT t.upload_id, person_id FROM train t JOIN dir USING (film_id)),
a AS (SELECT c.upload_id, c.film_id, bool_or(f.person_id IS NOT NULL) AS fam FROM cand c JOIN dir x USING (film_id) LEFT JOIN fam f ON f.upload_id = c.upload_id AND f.person_id = x.person_id GROUP BY 1, 2)
SELECT c.upload_id, c.film_id, a.fam AS director_is_familiar FROM cand c LEFT JOIN a USING (upload_id, film_id)""")
def _(d):
    train = _train(d)
    credits = with_roles(d.credits()).select("film_id", "role", "person_id").distinct()
    return recommend.director_familiarity(recommend.unrated(d.films(), train), credits, train).select("upload_id", "film_id", "director_is_familiar")


TOP = f"""{UNRATED.replace('chosen AS (SELECT * FROM lib_credit WHERE', 'chosen AS (SELECT upload_id, credit.film_id, role, person_id FROM (SELECT DISTINCT upload_id FROM rating) CROSS JOIN credit WHERE')}, sc AS (
  SELECT c.upload_id, c.film_id, round(adjustment, 7) AS adj FROM cand c JOIN adj USING (upload_id, film_id)),
rs AS (SELECT s.upload_id, s.film_id, s.person_id, s.role, row_number() OVER (PARTITION BY s.upload_id, s.film_id ORDER BY round(abs(effect), 9) DESC,
  list_position(['editor','cinematographer','composer','production_designer','writer'], s.role), s.person_id) AS p FROM chosen s JOIN effect USING (upload_id, role, person_id)),
j AS (SELECT sc.*, person_id, role FROM sc JOIN rs ON rs.upload_id = sc.upload_id AND rs.film_id = sc.film_id AND p = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY upload_id, person_id ORDER BY adj DESC, film_id) AS q FROM j), t AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY adj DESC, film_id)::INT AS place FROM k WHERE q <= 2)"""


def _scoring(d):
    """The train block, credits of all films, effects of people below the line, and the fit they sit on."""
    train = _train(d)
    credits = d.all_credits().filter(F.col("role").isin("director", *BELOW_THE_LINE))
    fit = expectation.simple_fit(train)
    residuals = expectation.simple_predict(train, fit).withColumn("residual", F.col("rating") - F.col("expected"))
    fitted = crew.effects(residuals, credits.filter("role <> 'director'")).withColumn("effect", F.round("effect", 9))
    return train, credits, fitted, fit


def _top(d):
    train, credits, fitted, fit = _scoring(d)
    out = recommend.scored(d.films(), train, credits, fitted, lambda rows: expectation.simple_predict(rows, fit))
    return train, credits, recommend.top(out.withColumn("crew_adjustment", F.round("crew_adjustment", 7)), 20)


@query("recommend_top_capped", f"{TOP} SELECT upload_id, place, film_id, person_id AS reason_person_id, role AS reason_role, round(adj, 5) + 0.0::DOUBLE AS crew_adjustment FROM t WHERE place <= 20")
def _(d):
    return rounded(_top(d)[2].select("upload_id", "place", "film_id", "reason_person_id", "reason_role", "crew_adjustment"), 5)


KNOWN = f"""{TOP}, nov AS (SELECT upload_id, vote_count AS v, count(*) AS c FROM train GROUP BY 1, 2), pct AS (SELECT t.upload_id, t.film_id, sum(CASE WHEN nov.v <= f.vote_count THEN c ELSE 0 END) / sum(c) AS p FROM t JOIN film f USING (film_id) JOIN nov USING (upload_id) WHERE place <= 20 GROUP BY 1, 2),
dir AS (SELECT DISTINCT film_id, person_id FROM credit WHERE role = 'director'), fam AS (SELECT DISTINCT r.upload_id, person_id FROM train r JOIN dir USING (film_id)),
fams AS (SELECT t.upload_id, t.film_id, bool_or(f.person_id IS NOT NULL) AS fam FROM t JOIN dir x USING (film_id) LEFT JOIN fam f ON f.upload_id = t.upload_id AND f.person_id = x.person_id GROUP BY 1, 2)"""


@query("non_obviousness", f"{KNOWN} SELECT t.upload_id, round(avg(p), 6) AS novelty, round(avg((NOT fam)::INT), 6) AS non_obviousness FROM t JOIN pct USING (upload_id, film_id) LEFT JOIN fams USING (upload_id, film_id) WHERE place <= 20 GROUP BY 1")
def _(d):
    train, credits, topped = _top(d)
    return rounded(recommend.summary(recommend.known_of(topped, train, credits)))


@query("catalog_counters", f"{UNRATED.replace('chosen AS (SELECT * FROM lib_credit WHERE', 'chosen AS (SELECT upload_id, credit.film_id, role, person_id FROM (SELECT DISTINCT upload_id FROM rating) CROSS JOIN credit WHERE')}, total AS (SELECT count(*)::BIGINT AS films FROM film), rated AS (SELECT upload_id, count(DISTINCT film_id)::BIGINT AS already_rated FROM train GROUP BY 1), scored AS (SELECT c.upload_id, count(*)::BIGINT AS scoreable FROM cand c JOIN adj USING (upload_id, film_id) GROUP BY 1) SELECT rated.upload_id, already_rated, coalesce(scoreable, 0)::BIGINT AS scoreable, films AS catalog_films, round(coalesce(scoreable, 0) / films, 6) AS coverage FROM rated LEFT JOIN scored USING (upload_id), total")
def _(d):
    train, credits, fitted, _ = _scoring(d)
    return rounded(recommend.counters(d.films(), train, recommend.scoreable(d.films(), train, credits, fitted)))


BELOW, DIRECTORS = "role NOT IN ('director', 'actor')", "role = 'director'"


def _simple_people(who: str) -> str:
    """Predictions on the simple expectation of the people of ``who``, as a derived table."""
    return f"({PREDICTED.replace(BELOW, who)} SELECT upload_id, film_id, predicted FROM pred)"


@query("simple_gaps", f"SELECT upload_id, film_id, round(one, 5) AS one, round(two, 5) AS two, round(gap, 5) + 0.0::DOUBLE AS gap, place FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY round(abs(gap), 9) DESC, film_id)::INT AS place FROM (SELECT a.upload_id, a.film_id, a.predicted AS one, b.predicted AS two, a.predicted - b.predicted AS gap FROM {_simple_people(BELOW)} a JOIN {_simple_people(DIRECTORS)} b USING (upload_id, film_id))) WHERE place <= 20")
def _(d):
    s, credits = _split(d), d.film_credits()
    side = lambda who: ladder.people(s.filter("block = 'train'"), s.filter("block = 'test'"), credits.filter(who), "simple").withColumn("predicted", F.round("predicted", 7))
    return rounded(recommend.gaps(side(F.col("role").isin(*BELOW_THE_LINE)), side("role = 'director'"), 20), 5)


def _expectations(kind: str, target: str = "rating") -> str:
    """CTEs from the tables to expected: the rows of both blocks with what a fit on the train block expects."""
    head = f"WITH RECURSIVE {v.BASE}, {SPLIT}, "
    if kind == "simple":
        return head + v.simple(target, train="train", rows="split")
    diary = target == "preference"
    return f"{head}{_ridge('train', target, diary)}, {_cells('own', 'split', diary)}, told AS (SELECT upload_id, film_id, sum(o.v * coefficient) AS expected FROM own o JOIN ridge r USING (upload_id) WHERE r.feature = o.f GROUP BY 1, 2), expected AS (SELECT split.*, told.expected FROM split JOIN told USING (upload_id, film_id))"


def _rung(kind: str, who: str = "", how: str = "mean", target: str = "rating", source: str = "lib_credit") -> str:
    """upload_id, film_id, predicted, actual of one predictor on the test block, as a derived table: an expectation, or the people of ``who`` on top of it."""
    if not who:
        return f"({_expectations(kind, target)} SELECT upload_id, film_id, round(expected, 7) AS predicted, rating::DOUBLE AS actual FROM expected WHERE block = 'test')"
    agg = {"mean": "avg(effect)", "max": "arg_max(effect, (round(abs(effect), 12), -person_id))", "weighted": "sum(effect / power(greatest(stderr, 1e-6), 2)) / sum(1 / power(greatest(stderr, 1e-6), 2))"}[how]
    return f"""({_expectations(kind, target)}, on_train AS (SELECT * REPLACE ({target} AS rating) FROM expected WHERE block = 'train'), chosen AS (SELECT * FROM {source} WHERE {who}),
train_credit AS (SELECT s.* FROM chosen s JOIN train t ON s.upload_id = t.upload_id AND s.film_id = t.film_id), {v.effects(source='train_credit', expected='on_train')},
per_role AS (SELECT s.upload_id, film_id, role, {agg} AS e FROM chosen s JOIN effect USING (upload_id, role, person_id) GROUP BY 1, 2, 3), adj AS (SELECT upload_id, film_id, avg(e) AS adjustment FROM per_role GROUP BY 1, 2)
SELECT upload_id, film_id, round(expected + coalesce(adjustment, 0), 7) AS predicted, rating::DOUBLE AS actual FROM expected LEFT JOIN adj USING (upload_id, film_id) WHERE block = 'test')"""


def _scored(rungs: dict[str, str]) -> str:
    """The headline metrics of derived tables by predictor."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS predictor, * FROM {sql}" for name, sql in rungs.items())
    return f"""WITH preds AS ({rows}), placed AS (SELECT *, row_number() OVER (PARTITION BY predictor, upload_id ORDER BY predicted DESC, film_id) AS place, avg(predicted - actual) OVER (PARTITION BY predictor, upload_id) AS shift,
  rank() OVER (PARTITION BY predictor, upload_id ORDER BY predicted) + (count(*) OVER (PARTITION BY predictor, upload_id, predicted) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY predictor, upload_id ORDER BY actual) + (count(*) OVER (PARTITION BY predictor, upload_id, actual) - 1) / 2.0 AS ra FROM preds),
m AS (SELECT predictor, upload_id, count(*)::BIGINT AS n, coalesce(avg((actual >= 4)::INT) FILTER (place <= 20), 0) AS headline_precision, avg((actual >= 4)::INT) AS headline_base, coalesce(avg((actual >= 4.5)::INT) FILTER (place <= 100), 0) AS gate_precision, avg((actual >= 4.5)::INT) AS gate_base,
  CASE WHEN min(predicted) = max(predicted) OR min(actual) = max(actual) THEN 0 ELSE corr(rp::DOUBLE, ra::DOUBLE) END AS spearman, avg(abs(predicted - actual)) AS mae, sqrt(avg(power(predicted - actual, 2))) AS rmse, avg(abs(predicted - actual - shift)) AS mae_centred FROM placed GROUP BY 1, 2)
SELECT predictor, upload_id, n, round(headline_precision, 5) AS headline_precision, round(headline_base, 5) AS headline_base, round(gate_precision, 5) AS gate_precision, round(gate_base, 5) AS gate_base, round(CASE WHEN headline_base > 0 THEN headline_precision / headline_base ELSE 0 END, 5) AS headline_lift,
  round(CASE WHEN gate_base > 0 THEN gate_precision / gate_base ELSE 0 END, 5) AS gate_lift, round(spearman, 5) + 0.0::DOUBLE AS spearman, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(mae_centred, 5) AS mae_centred FROM m"""


def _scores(d, credits, rungs: dict):
    rows = ladder.predictions(_split(d), credits, rungs).withColumn("predicted", F.round("predicted", 7))
    return rounded(metrics.score(rows, ["predictor", "upload_id"]), 5)


@query("disagreement_gaps", f"SELECT upload_id, film_id, round(one, 5) AS one, round(two, 5) AS two, round(gap, 5) + 0.0::DOUBLE AS gap, place FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY round(abs(gap), 9) DESC, film_id)::INT AS place FROM (SELECT a.upload_id, a.film_id, a.predicted AS one, b.predicted AS two, a.predicted - b.predicted AS gap FROM {_rung('rich', BELOW)} a JOIN {_rung('rich', DIRECTORS)} b USING (upload_id, film_id))) WHERE place <= 20")
def _(d):
    s = _split(d)
    train, test = s.filter("block = 'train'"), s.filter("block = 'test'")
    credits = d.film_credits()
    side = lambda rung: rung(train, test, credits).withColumn("predicted", F.round("predicted", 7))
    return rounded(recommend.gaps(side(ladder.below_the_line), side(ladder.of_role("director")), 20), 5)


GENRES = "(SELECT DISTINCT upload_id, film_id, 'genre' AS role, unnest(genres) AS person_id FROM library)"
RUNGS = {
    "global_mean": f"(WITH {v.LIBRARY}, {SPLIT} SELECT test.upload_id, film_id, round(m, 7) AS predicted, rating::DOUBLE AS actual FROM test JOIN (SELECT upload_id, avg(rating) AS m FROM train GROUP BY 1) USING (upload_id))",
    "popularity": _rung("simple"), "context": _rung("rich"), "genre": _rung("simple", "true", source=GENRES), "director": _rung("rich", DIRECTORS), "cast": _rung("rich", "role = 'actor'"), "crew": _rung("rich", BELOW),
}


@query("ladder_scores", _scored(RUNGS))
def _(d):
    return _scores(d, d.film_credits(), ladder.LADDER)


@query("evaluate_ladder")
def _(d):
    return rounded(ladder.evaluate(_split(d), d.film_credits(), ladder.FULL_LADDER))


def _pairs(d):
    return ladder.predictions(_split(d), d.film_credits(), {n: ladder.FULL_LADDER[n] for n in sorted({x for pair in ladder.GATE_PAIRS for x in pair})}).persist()


def _drawn(name: str, seed: int, *names: str) -> str:
    """Select items that end in ``name``: ``inference.drawn`` of the expressions ``names``."""
    p, items, last = inference.PRIME, [], str(seed % inference.PRIME)
    for i, n in enumerate(names):
        x, s, y = f"{name}_x{i}", f"{name}_s{i}", name if i + 1 == len(names) else f"{name}_y{i}"
        items += [f"({last}::BIGINT + {n}) % {p} AS {x}", f"{x} * {x} % {p} AS {s}", f"{s} * {s} % {p} * {x} % {p} AS {y}"]
        last = y
    return ", ".join(items)


PAIRED = f"""{PREDICTED}, pairs AS (SELECT p.upload_id, p.film_id, p.predicted AS one, round(x.expected, 7) AS two, actual FROM pred p JOIN expected x USING (upload_id, film_id)),
ranked AS (SELECT *, (actual >= 4.5)::INT AS hit, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY upload_id) AS n, row_number() OVER (PARTITION BY upload_id ORDER BY one DESC, film_id) AS r1, row_number() OVER (PARTITION BY upload_id ORDER BY two DESC, film_id) AS r2 FROM pairs WINDOW w AS (PARTITION BY upload_id ORDER BY film_id)),
point AS (SELECT upload_id, avg(hit) FILTER (r1 <= 100) AS value_one, avg(hit) FILTER (r2 <= 100) AS value_two FROM ranked GROUP BY 1),
draws AS (SELECT upload_id, r, place AS draw, n, {_drawn('u', inference.SEED, 'r', 'place')} FROM ranked, range(1, {inference.RESAMPLES + 1}) t(r)),
sample AS (SELECT d.upload_id, r, draw, hit, r1, r2 FROM draws d JOIN ranked k ON d.upload_id = k.upload_id AND d.u * d.n // {inference.PRIME} = k.place),
placed AS (SELECT upload_id, r, hit, row_number() OVER (PARTITION BY upload_id, r ORDER BY r1, draw) AS p1, row_number() OVER (PARTITION BY upload_id, r ORDER BY r2, draw) AS p2 FROM sample),
each AS (SELECT upload_id, r, avg(hit) FILTER (p1 <= 100) - avg(hit) FILTER (p2 <= 100) AS d FROM placed GROUP BY 1, 2),
spread AS (SELECT upload_id, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, avg((d > 0)::INT) AS p FROM each GROUP BY 1)
SELECT upload_id, round(value_one, 6) AS value_one, round(value_two, 6) AS value_two, round(low, 6) + 0.0::DOUBLE AS ci_low, round(high, 6) + 0.0::DOUBLE AS ci_high, round(p, 6) AS p_positive, round(value_one - value_two, 6) + 0.0::DOUBLE AS difference, low > 0 OR high < 0 AS significant FROM point JOIN spread USING (upload_id)"""


@query("paired_bootstrap", PAIRED)
def _(d):
    s = _split(d)
    credits = d.film_credits().filter(F.col("role").isin(*BELOW_THE_LINE))
    rows = ladder.people(s.filter("block = 'train'"), s.filter("block = 'test'"), credits, "simple")
    return rounded(inference.compare(rows.select("upload_id", "film_id", F.round("predicted", 7).alias("one"), F.round("expected", 7).alias("two"), F.col("rating").alias("actual"))))


@query("bootstrap_compare")
def _(d):
    return rounded(ladder.gate_pairs(_pairs(d)))


@query("decomposition")
def _(d):
    layers = inference.decomposition(_split(d), d.film_credits())
    return rounded(layers)


NULL = f"""WITH {v.BASE}, own AS (SELECT upload_id, film_id, vote_average, row_number() OVER (PARTITION BY upload_id ORDER BY film_id) AS place FROM library),
keyed AS (SELECT upload_id, film_id, rating, p, {_drawn('key', inference.SEED, 'p', 'film_id')} FROM library, range(1, {inference.PERMUTATIONS + 1}) t(p)),
dealt AS (SELECT upload_id, p, rating, row_number() OVER (PARTITION BY upload_id, p ORDER BY key, film_id) AS place FROM keyed),
perm AS (SELECT upload_id || '#' || p AS upload_id, film_id, vote_average, rating FROM dealt JOIN own USING (upload_id, place)),
{v.simple(train='perm', rows='perm')}, chosen AS (SELECT upload_id, film_id, role, person_id FROM perm JOIN credit USING (film_id)), {v.effects(source='chosen')}
SELECT split_part(upload_id, '#', 1) AS upload_id, split_part(upload_id, '#', 2)::INT AS permutation, role, max(abs(effect)) AS largest FROM effect WHERE n >= 12 GROUP BY ALL"""
STRONGEST = f"WITH {v.BASE}, {v.simple()}, {v.effects()} SELECT upload_id, role, arg_max(person_id, (abs(effect), -person_id)) AS person_id, max(abs(effect)) AS effect FROM effect WHERE n >= 12 GROUP BY 1, 2"


@query("permutation_null", f"SELECT upload_id, permutation, role, round(largest, 6) AS largest FROM ({NULL})")
def _(d):
    return rounded(inference.permutation_null(d.library(), d.film_credits()))


@query("significance", f"SELECT b.upload_id, b.role, b.person_id, round(b.effect, 6) AS effect, round(quantile_cont(largest, 0.95), 6) AS critical, round((count_if(largest >= b.effect) + 1) / {inference.PERMUTATIONS + 1}, 6) AS p_value FROM ({STRONGEST}) b LEFT JOIN ({NULL}) n USING (upload_id, role) GROUP BY ALL")
def _(d):
    return rounded(inference.significance(d.library(), d.film_credits()))


def _fitted(rows: str, prefix: str) -> str:
    """Largest effect, reportable people and those at 0.05 or more, of the library ``rows``, as a derived table."""
    return f"""(WITH {v.BASE}, {rows}, {v.simple(train='mine', rows='mine')}, chosen AS (SELECT * FROM lib_credit WHERE role NOT IN ('director', 'actor')), {v.effects(source='chosen')}
SELECT upload_id, role, max(abs(effect)) AS {prefix}_max, count(*)::BIGINT AS {prefix}_reportable, count_if(abs(effect) >= 0.05)::BIGINT AS {prefix}_above FROM effect WHERE n >= 12 GROUP BY 1, 2)"""


DEALT = "own AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY film_id) AS place FROM library), moved AS (SELECT upload_id, rating AS r, row_number() OVER (PARTITION BY upload_id ORDER BY md5('20260726|' || film_id), film_id) AS place FROM library), mine AS (SELECT own.* REPLACE (r AS rating) FROM own JOIN moved USING (upload_id, place))"
SHUFFLED = f"""SELECT upload_id, role, round(real_max, 6) AS real_max, real_reportable, real_above, round(shuffled_max, 6) AS shuffled_max, shuffled_reportable, shuffled_above,
round(CASE WHEN real_max > 0 THEN shuffled_max / real_max ELSE 1 END, 6) AS max_ratio, round(CASE WHEN real_above > 0 THEN shuffled_above / real_above ELSE 1 END, 6) AS count_ratio, CASE WHEN real_above > 0 THEN shuffled_above / real_above ELSE 1 END <= 0.1 AS collapsed
FROM {_fitted('mine AS (SELECT * FROM library)', 'real')} JOIN {_fitted(DEALT, 'shuffled')} USING (upload_id, role)"""


@query("shuffle_test", SHUFFLED)
def _(d):
    return rounded(inference.shuffle_test(d.library(), d.film_credits().filter(F.col("role").isin(*BELOW_THE_LINE)), threshold=0.05))


#: every cell (size, n_films, trial) of every upload: its planted person, its ratings, the effects fitted to them
SWEEP = f"""WITH {v.BASE}, {v.simple()}, ed AS (SELECT DISTINCT upload_id, film_id, person_id FROM lib_credit WHERE role = 'editor'), noise AS (SELECT upload_id, stddev_samp(rating - expected) AS sd FROM expected GROUP BY 1),
able AS (SELECT upload_id, person_id, count(*)::INT AS n_films FROM ed GROUP BY 1, 2), drawn AS (SELECT *, {_drawn('u', inference.SEED, 't', 'person_id')} FROM able, range(0, 12) x(t)),
planted AS (SELECT upload_id, n_films, t, arg_min(person_id, (u, person_id)) AS planted FROM drawn GROUP BY 1, 2, 3), cell AS (SELECT * FROM planted, (VALUES (0, 0.25), (1, 0.5), (2, 0.75), (3, 1.0), (4, 1.5)) s(s, size)),
draws AS (SELECT e.upload_id || '#' || n_films || '#' || s || '#' || t AS cell, e.upload_id, e.film_id, vote_average, expected, n_films, s, t, size, planted, {_drawn('u1', inference.SEED + 1, 's', 't', 'n_films', 'e.film_id')}, {_drawn('u2', inference.SEED + 2, 's', 't', 'n_films', 'e.film_id')} FROM expected e JOIN cell USING (upload_id)),
made AS (SELECT d.cell AS upload_id, d.film_id, vote_average, d.planted, d.n_films, d.size, greatest(0.5, least(5.0, round_even((expected + CASE WHEN ed.film_id IS NULL THEN 0 ELSE size END + sqrt(-2 * ln(1 - u1 / {inference.PRIME})) * cos(2 * pi() * (u2 / {inference.PRIME})) * sd) * 2, 0) / 2))::DOUBLE AS rating
  FROM draws d JOIN noise USING (upload_id) LEFT JOIN ed ON ed.upload_id = d.upload_id AND ed.film_id = d.film_id AND ed.person_id = d.planted)"""
SWEPT = f"""WITH made AS ({SWEEP} SELECT * FROM made), people AS (WITH {v.BASE} SELECT DISTINCT upload_id, film_id, person_id FROM lib_credit WHERE role = 'editor'), {v.simple(train='made', rows='made')},
lib_of AS (SELECT m.upload_id, m.film_id, 'editor' AS role, p.person_id FROM made m JOIN people p ON p.upload_id = split_part(m.upload_id, '#', 1) AND p.film_id = m.film_id), {v.effects(source='lib_of')},
cells AS (SELECT DISTINCT upload_id, planted, n_films, size FROM made), own AS (SELECT c.*, abs(effect) AS own FROM cells c JOIN effect e ON e.upload_id = c.upload_id AND e.person_id = c.planted),
placed AS (SELECT o.upload_id, any_value(o.n_films) AS n_films, any_value(o.size) AS size, count_if(abs(e.effect) > own OR (abs(e.effect) = own AND e.person_id < planted)) < 3 AS hit FROM own o JOIN effect e USING (upload_id) GROUP BY 1),
summed AS (SELECT size::DOUBLE AS size, n_films::INT AS n_films, count(*)::BIGINT AS trials, count_if(hit)::BIGINT AS recovered FROM placed GROUP BY 1, 2)
SELECT *, recovered / trials AS rate, recovered / trials >= 0.8 AS detected FROM summed"""


@query("synthetic_sweep", SWEPT)
def _(d):
    # people of these tables have other numbers of films than the default's
    return inference.synthetic_sweep(d.library(), d.film_credits(), "editor", counts=None)


@query("ridge_gcv")
def _(d):
    return rounded(ridge_crew.fit(_expected(d), d.film_credits().filter(F.col("role").isin(*BELOW_THE_LINE))))


@query("ridge_attribution")
def _(d):
    residuals, credits = _expected(d), d.film_credits().filter(F.col("role").isin("director", *BELOW_THE_LINE))
    below = credits.filter("role <> 'director'")
    return rounded(ridge_crew.attribution(crew.effects(residuals, below), ridge_crew.fit(residuals, below), ridge_crew.fit(residuals, credits)))


@query("crew_variants", _scored({"_".join(x): _rung(x[0], BELOW, x[1], x[2]) for x in ladder.VARIANTS}))
def _(d):
    credits = d.film_credits().filter(F.col("role").isin(*BELOW_THE_LINE))
    rungs = {"_".join(x): (lambda train, test, c, x=x: ladder.people(train, test, c, x[0], x[1], "mean", x[2])) for x in ladder.VARIANTS}
    return _scores(d, credits, rungs)
